"""Kept summaries of groups, and exact quantiles from them with one more pass.

A summary holds the count, the moments, the extremes and a quantile sketch of each column of a group. Summaries are small,
combine before the exchange, can be stored, and merge to summaries of coarser groups. The sketch bounds where each wanted
quantile lies. One pass over the rows then counts every value outside the bounds by stretch and keeps those inside, which gives
the exact ranks. The sketch steers and never touches the result: a bound that proves wrong costs another pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, named
from skyqa.functions.frames import broadcast_if_small, cut, join_on

#: Size of a sketch. Its rank error (99 %) is about 2.296 / k^0.9021 of the rows.
SKETCH_K = 1024
#: Ranks on either side of a quantile between which it is looked for: twice that error.
MARGIN = 2 * 2.296 / SKETCH_K**0.9021
#: Groups of so few values are kept whole; the margin would be narrower than the ranks to interpolate.
WHOLE_GROUP = int(4 / MARGIN) + 1
_EVEN_CUTS = [i / 32 for i in range(1, 32)]
_ACCURACY = 10_000


@dataclass(frozen=True)
class Request:
    """Quantiles ``probs`` of ``columns`` by ``keys``, over the rows that ``where`` holds for, and their summaries."""

    keys: Sequence[str]
    columns: Sequence[str]
    probs: Sequence[float]
    summaries: DataFrame
    where: Column | None = None


def clean_value(column: str) -> Column:
    return finite_or_null(named(column).cast("double"))


def summarise(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], where: Column | None = None, sketched: Sequence[str] | None = None
) -> DataFrame:
    """``keys..., metric, rows, count, mean, m2, min, max, sketch`` of every group and column, in one combinable pass.

    ``rows`` counts all rows of the group, the others the values that are filled in rows ``where`` holds for; ``m2`` is the sum of squared
    distances from the mean. ``sketched`` names the columns that get a sketch (default: all).
    """
    sketched = set(columns if sketched is None else sketched)
    ids = [named(k) for k in keys]
    values = [clean_value(c) if where is None else F.when(where, clean_value(c)) for c in columns]
    rows = df.select(*ids, *[v.alias(f"__v{i}") for i, v in enumerate(values)])
    aggregates, entries = [F.count(F.lit(1)).alias("__rows")], []
    for i, c in enumerate(columns):
        v = F.col(f"__v{i}")
        sketch = F.kll_sketch_agg_double(v, F.lit(SKETCH_K)) if c in sketched else F.lit(None).cast("binary")
        fields = {
            "count": F.count(v),
            "mean": F.avg(v),
            "m2": F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)),
            "min": F.min(v),
            "max": F.max(v),
            "sketch": sketch if c in sketched else F.first(sketch),
        }
        aggregates += [made.alias(f"{name}|{i}") for name, made in fields.items()]
        entries.append(
            F.struct(F.lit(c).alias("metric"), F.col("__rows").alias("rows"), *[F.col(f"`{name}|{i}`").alias(name) for name in fields])
        )
    return rows.groupBy(*ids).agg(*aggregates).select(*ids, F.inline(F.array(*entries)))


def merged(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries by fewer keys: counts add up, moments combine, sketches merge, all before the exchange."""
    ids = [named(k) for k in keys]
    group = [*keys, "metric"]
    n, mean = F.col("count"), F.col("mean")
    whole = summaries.groupBy(*ids, "metric").agg((F.sum(n * mean) / F.nullif(F.sum(n), F.lit(0))).alias("__mean"))
    return (
        join_on(summaries, broadcast_if_small(cut(whole)), group)
        .groupBy(*ids, "metric")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum(n).alias("count"),
            F.first("__mean").alias("mean"),
            F.sum(F.col("m2") + F.coalesce(n * (mean - F.col("__mean")) * (mean - F.col("__mean")), F.lit(0.0))).alias("m2"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"),
        )
    )


def sample_std() -> Column:
    """Sample standard deviation from the moments of a summary."""
    return F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1)))


def refine(df: DataFrame, requests: Sequence[Request], limit: int) -> list[DataFrame]:
    """``keys..., metric, q`` for each request: exact linear quantiles of the groups that hold values.

    All requests share one pass over ``df``, whatever their keys. Every value is placed in a stretch by the bounds of its group's quantiles;
    values outside all bounds become one count per stretch, before the exchange. A stretch between bounds that still holds more than ``limit``
    distinct values is divided further without reading ``df`` again.
    """
    keys = list(dict.fromkeys(k for r in requests for k in r.keys))
    group = ["__set", *keys, "metric"]
    by_group = [named(g) for g in group]
    width = max(len(r.probs) for r in requests)
    cells = _cells(df, requests, keys)
    bounds = cut(reduce(DataFrame.unionByName, [_bounds(df, r, i, keys, width) for i, r in enumerate(requests)]))
    v = F.col("value")
    lo, hi = ([F.col(name)[i] for i in range(width)] for name in ("__lo", "__hi"))
    stretch = sum((((v >= a).cast("int") + (v > b).cast("int")) for a, b in zip(lo, hi, strict=True)), F.lit(0))
    inside = reduce(lambda a, b: a | b, [(v >= a) & (v <= b) for a, b in zip(lo, hi, strict=True)])
    placed = join_on(cells, broadcast_if_small(bounds), group).select(
        *by_group, stretch.cast("long").alias("__part"), "value", inside.alias("__inside")
    )
    kept = cut(
        placed.groupBy(*by_group, "__part", F.when(F.col("__inside"), v).alias("value")).agg(F.count(F.lit(1)).alias("__copies"))
    )
    sizes = kept.groupBy(*by_group, "__part").agg(F.sum("__copies").alias("__n"), F.bool_or(F.col("value").isNull()).alias("__outside"))
    before = F.sum("__n").over(W.partitionBy(*by_group).orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    sizes = cut(sizes.withColumn("__before", before))
    found = cut(_targets(sizes, by_group, requests).where("__rank >= __before and __rank < __before + __n"))
    targets = found.select(*by_group, "__part", "__i", (F.col("__rank") - F.col("__before")).alias("__rank"), "__weight")
    part = [*group, "__part"]
    wanted = broadcast_if_small(cut(found.select(*by_group, "__part").distinct()))
    rows = join_on(kept.where(F.col("value").isNotNull()), wanted, part, "left_semi")
    missed = found.where("__outside").select(*by_group, "__part").distinct()
    if not missed.isEmpty():  # a bound was wrong: these stretches are read whole
        again = join_on(placed, broadcast_if_small(cut(missed)), part, "left_semi")
        rows = rows.unionByName(again.groupBy(*by_group, "__part", "value").agg(F.count(F.lit(1)).alias("__copies")))
    picked = cut(pick(cut(rows), targets, group, limit, width))
    out = []
    for i, r in enumerate(requests):
        names = F.array(*[F.lit(c) for c in r.columns])
        out.append(
            picked.where(F.col("__set") == i).select(
                *[named(k) for k in r.keys], names[F.col("metric")].alias("metric"), F.slice("q", 1, len(r.probs)).alias("q")
            )
        )
    return out


def _cells(df: DataFrame, requests: Sequence[Request], keys: Sequence[str]) -> DataFrame:
    """One row per request, column and row that holds a value: ``__set, keys..., metric (number), value``."""
    columns = list(dict.fromkeys(c for r in requests for c in r.columns))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    holds = [F.lit(True) if r.where is None else r.where for r in requests]
    rows = df.select(
        *[named(k) for k in keys],
        *[clean_value(c).alias(f"__v{i}") for i, c in enumerate(columns)],
        *[h.alias(f"__w{i}") for i, h in enumerate(holds)],
    )
    entries = []
    for i, r in enumerate(requests):
        ids = [(named(k) if k in r.keys else F.lit(None).cast(kinds[k])).alias(k) for k in keys]
        for m, c in enumerate(r.columns):
            value = F.when(F.col(f"__w{i}"), F.col(f"__v{columns.index(c)}"))
            entries.append(F.struct(F.lit(i).alias("__set"), *ids, F.lit(m).alias("metric"), value.alias("value")))
    return rows.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())


def _bounds(df: DataFrame, r: Request, i: int, keys: Sequence[str], width: int) -> DataFrame:
    """``__set, keys..., metric (number), __lo, __hi``: between which values each quantile lies, as the sketch says."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    n = F.col("count")
    edge = float("inf")

    def at(side: int, every: float) -> Column:
        ranks = F.array(*[F.lit(min(max(p + side * MARGIN, 0.0), 1.0)) for p in r.probs])
        whole = F.array(*[F.lit(every)] * len(r.probs))
        kept = F.when(n <= WHOLE_GROUP, whole).otherwise(F.kll_sketch_get_quantile_double("sketch", ranks))
        return F.concat(kept, F.array(*[F.lit(edge)] * (width - len(r.probs)))) if width > len(r.probs) else kept

    number = F.array_position(F.array(*[F.lit(c) for c in r.columns]), F.col("metric")) - 1
    ids = [(named(k) if k in r.keys else F.lit(None).cast(kinds[k])).alias(k) for k in keys]
    held = r.summaries.where((n > 0) & F.col("metric").isin(list(r.columns)))
    return held.select(F.lit(i).alias("__set"), *ids, number.cast("int").alias("metric"), at(-1, -edge).alias("__lo"), at(1, edge).alias("__hi"))


def _targets(sizes: DataFrame, by_group: Sequence[Column], requests: Sequence[Request]) -> DataFrame:
    """The stretches of each group beside the two neighbouring ranks of every quantile, with their interpolation weights."""
    total = F.sum("__n").over(W.partitionBy(*by_group))

    def pairs(probs: Sequence[float]) -> Column:
        out = []
        for i, p in enumerate(probs):
            at = F.lit(float(p)) * (F.col("__total") - 1)
            low = F.floor(at)
            for up, weight in ((0, 1 - (at - low)), (1, at - low)):
                out.append(F.struct(F.lit(i).alias("__i"), (low + up).alias("__rank"), weight.alias("__weight")))
        return F.array(*out)

    wanted = pairs(requests[0].probs)
    for i, r in list(enumerate(requests))[1:]:
        wanted = F.when(F.col("__set") == i, pairs(r.probs)).otherwise(wanted)
    rows = sizes.withColumn("__total", total).withColumn("__t", F.explode(wanted))
    return rows.select(*sizes.columns, "__t.*").where(F.col("__weight") > 0)


def pick(rows: DataFrame, targets: DataFrame, group: Sequence[str], limit: int, n_probs: int) -> DataFrame:
    """``group..., q`` from the values around the wanted ranks.

    ``rows``: ``group..., __part, value, __copies``; ``targets``: ``group..., __part, __i, __rank (inside the part), __weight``. Parts of more than
    ``limit`` distinct values are divided until none is left.
    """
    by_group = [named(g) for g in group]
    part = [*group, "__part"]
    by_part = [named(g) for g in part]
    while True:
        widest = rows.groupBy(*by_part).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if widest is None or widest <= limit:
            break
        sketch = cut(rows.groupBy(*by_part).agg(F.percentile_approx("value", _EVEN_CUTS, _ACCURACY).alias("__cuts")))
        rows, targets = _narrow(rows, targets, part, sketch, len(_EVEN_CUTS))
    upto = F.sum("__copies").over(W.partitionBy(*by_part).orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("__upto", upto)
    near = join_on(placed, broadcast_if_small(targets), part).where(
        (F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__copies"))
    )
    at = [F.sum(F.when(F.col("__i") == i, F.col("value") * F.col("__weight"))) for i in range(n_probs)]
    return near.groupBy(*by_group).agg(F.array(*at).alias("q"))


def _narrow(
    rows: DataFrame, targets: DataFrame, part: Sequence[str], sketch: DataFrame, n_cuts: int
) -> tuple[DataFrame, DataFrame]:
    """Split every part at its cut points and keep the chunks that hold a wanted rank."""
    by_part = [named(g) for g in part]
    above = [(F.col("value") >= F.col("__cuts")[i]).cast("int") for i in range(n_cuts)]
    # NaN never reaches this point, so the chunk number is monotone in the value
    chunked = join_on(rows, broadcast_if_small(sketch), part).withColumn(
        "__chunk", reduce(lambda a, b: a + b, above)
    )
    before = F.sum("__n").over(
        W.partitionBy(*by_part).orderBy("__chunk").rowsBetween(W.unboundedPreceding, 0)
    ) - F.col("__n")
    sizes = (
        chunked.groupBy(*by_part, "__chunk")
        .agg(F.sum("__copies").alias("__n"))
        .withColumn("__before", before)
    )
    child = (F.col("__part") * (n_cuts + 1) + F.col("__chunk")).alias("__part")
    columns = [named(g) for g in part[:-1]]
    placed = cut(
        join_on(targets, sizes, part).where(
            (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__n"))
        )
    )
    new_targets = placed.select(
        *columns, child, "__i", (F.col("__rank") - F.col("__before")).alias("__rank"), "__weight"
    )
    wanted = placed.select(*by_part, "__chunk").distinct()
    kept = (
        join_on(chunked, broadcast_if_small(wanted), [*part, "__chunk"], "left_semi")
        .select(*columns, child, "value", "__copies")
        .groupBy(*columns, "__part", "value")
        .agg(F.sum("__copies").alias("__copies"))
    )
    return cut(kept), new_targets
