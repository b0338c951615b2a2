"""Descriptive statistics, ranges and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, is_complete, named
from skyqa.functions.frames import cut, join_on
from skyqa.functions.quantiles import (
    ARRAY_CELLS,
    MAX_GROUP_ROWS,
    array_quantiles,
    describe_columns,
    describe_values,
    no_quantiles,
    quantiles,
)
from skyqa.functions.summaries import Request, clean_value, merged, refine, sample_std, summarise
from skyqa.operators.filters import FilterState
from skyqa.operators.schema import flag_columns, numeric_columns

# Percentiles of a statistics table.
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)

# Percentiles of the short form.
SHORT_PERCENTILES = (0.25, 0.5, 0.75)


def percentile_label(p: float) -> str:
    """``0.05 -> "5%"``."""
    return f"{100 * p:.10g}%"


def describe_by_key(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    percentiles: Sequence[float] = PERCENTILES,
    max_group_rows: int = MAX_GROUP_ROWS,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Statistics table: ``keys..., statistic`` and one column per numeric column.

    A row takes part only if **all** its columns hold a value, flags included. Statistics
    are count, mean, std (sample), min, the percentiles (exact, linear) and max. A key
    without one complete row is kept, with count 0. ``summaries`` are the :func:`key_summaries`
    of these keys, if kept: the rows are then read once, and no key is brought together.
    """
    columns = numeric_columns(df, skip=keys) if columns is None else sorted(columns)
    others = [c for c in df.columns if c not in keys]
    held = None if summaries is None else summaries.where("complete").drop("complete")
    long = describe_columns(
        df, keys, columns, percentiles, is_complete(df, others), max_group_rows, summaries=held
    )
    return statistics_rows(long, keys, columns, percentiles)


@dataclass(frozen=True)
class KeySet:
    """One of several statistics tables: its keys, columns and percentiles, and which columns must be filled
    for a row to take part (``None``: all but the keys)."""

    keys: Sequence[str]
    columns: Sequence[str]
    percentiles: Sequence[float] = PERCENTILES
    complete: Sequence[str] | None = None

    def filled(self, df: DataFrame) -> tuple[str, ...]:
        return tuple(c for c in df.columns if c not in self.keys) if self.complete is None else tuple(self.complete)


def _masked_summaries(
    df: DataFrame, keys: Sequence[str], masks: Sequence[tuple[str, ...]], pairs: Sequence[tuple[int, str]]
) -> DataFrame:
    """Summaries of (mask, column) pairs, ``mask`` being the number of the columns that must be filled; one pass."""
    ids = [named(k) for k in keys]
    held = df.select(*ids, *[named(c) for c in df.columns if c not in keys], *[is_complete(df, m).alias(f"__m{i}") for i, m in enumerate(masks)])
    values = [F.when(F.col(f"__m{m}"), clean_value(c)).alias(f"{m}|{c}") for m, c in pairs]
    rows = summarise(held.select(*ids, *values), keys, [f"{m}|{c}" for m, c in pairs])
    mask, column = F.split_part("metric", F.lit("|"), F.lit(1)), F.expr("substring(metric, instr(metric, '|') + 1)")
    return rows.withColumns({"mask": mask.cast("int"), "metric": column})


def key_summaries(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Kept summaries of each key and column: counts, moments, extremes and a quantile sketch, in one combinable pass.

    There are two of each: of complete rows, as a statistics table counts them, and of all values (``complete`` says which).
    They are stored beside the statistics table, merge over keys, and save later jobs the first of two passes.
    """
    columns = numeric_columns(df, skip=keys) if columns is None else sorted(columns)
    masks = [tuple(c for c in df.columns if c not in keys), ()]
    made = _masked_summaries(df, keys, masks, [(m, c) for m in (0, 1) for c in columns])
    return made.withColumn("complete", F.col("mask") == 0).drop("mask")


def describe_sets(
    df: DataFrame,
    sets: Mapping[str, KeySet],
    max_group_rows: int = MAX_GROUP_ROWS,
    array_cells: int = ARRAY_CELLS,
    summaries: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Several statistics tables of one table from one pass over its rows, and one before it that counts.

    The keys of the sets are nested: each set's keys are among those of the next larger one. If all groups are small,
    rows are exchanged once by the smallest set of keys; finer groups become arrays, and coarser ones join the arrays of theirs. If only the groups of
    some sets are small, these become arrays, and the values of the other sets are written beside them and read again for summaries and quantiles.
    Otherwise, the counting pass makes :func:`key_summaries` instead, from which one more pass finds the quantiles of all
    sets; with ``summaries`` kept by the finest keys there is only that pass.
    """
    order = sorted(sets, key=lambda n: len(sets[n].keys))
    for a, b in zip(order, order[1:], strict=False):
        if not set(sets[a].keys) <= set(sets[b].keys):
            raise ValueError(f"keys of {a} are not among those of {b}")
    finest, coarsest = list(sets[order[-1]].keys), list(sets[order[0]].keys)
    masks = list(dict.fromkeys(s.filled(df) for s in sets.values()))
    pairs = list(dict.fromkeys((masks.index(s.filled(df)), c) for s in sets.values() for c in s.columns))
    if summaries is not None:
        return _sets_refined(df, sets, _kept(df, sets, summaries, finest), finest, max_group_rows)
    if finest:
        sizes = cut(df.groupBy(*[named(k) for k in finest]).agg(F.count(F.lit(1)).alias("n")))
        for keys in dict.fromkeys(tuple(sets[n].keys) for n in order if sets[n].keys):
            whole = sizes.groupBy(*[named(k) for k in keys]).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
            if whole * len(pairs) <= array_cells and whole <= max_group_rows:
                return _sets_as_arrays(df, sets, masks, pairs, len(keys), max_group_rows)
    held = cut(_masked_summaries(df, finest, masks, pairs))
    own = {name: held.where(F.col("mask") == masks.index(s.filled(df))) for name, s in sets.items()}
    return _sets_refined(df, sets, own, finest, max_group_rows)


def _kept(
    df: DataFrame, sets: Mapping[str, KeySet], summaries: DataFrame, finest: Sequence[str]
) -> dict[str, DataFrame]:
    """The kept summaries that each set merges. Where rows must fill the finer keys too, groups without those hold nothing."""
    out = {}
    for name, s in sets.items():
        others = [c for c in df.columns if c not in finest]
        finer = [k for k in finest if k not in s.keys]
        if set(s.filled(df)) not in ({*others, *finer}, set(others), set()):
            raise ValueError(f"kept summaries do not tell which rows fill the columns of {name}")
        own = summaries.where(F.col("complete") == bool(s.filled(df)))
        if s.filled(df) and set(finer) <= set(s.filled(df)):
            there = reduce(lambda a, b: a & b, [named(k).isNotNull() for k in finer], F.lit(True))
            none = {"count": F.lit(0), "m2": F.lit(0.0)}
            own = own.withColumns({c: F.when(there, F.col(c)).otherwise(none.get(c)) for c in ("count", "mean", "m2", "min", "max", "sketch")})
        out[name] = own
    return out


def _sets_refined(
    df: DataFrame, sets: Mapping[str, KeySet], held: Mapping[str, DataFrame], finest: Sequence[str], limit: int
) -> dict[str, DataFrame]:
    summaries, requests = {}, []
    for name, s in sets.items():
        own = held[name].where(F.col("metric").isin(list(s.columns)))
        summaries[name] = own if set(s.keys) == set(finest) else cut(merged(own, s.keys))
        requests.append(Request(s.keys, sorted(s.columns), s.percentiles, summaries[name], is_complete(df, s.filled(df))))
    found = refine(df, requests, limit)
    out = {}
    for (name, s), q in zip(sets.items(), found, strict=True):
        moments = summaries[name].withColumn("std", sample_std())
        long = join_on(moments, q, [*s.keys, "metric"], "left").withColumn("q", F.coalesce("q", no_quantiles(s.percentiles)))
        out[name] = statistics_rows(long, s.keys, sorted(s.columns), s.percentiles)
    return out


def _sets_as_arrays(
    df: DataFrame, sets: Mapping[str, KeySet], masks: Sequence[tuple[str, ...]], pairs: Sequence[tuple[int, str]], fewest: int, limit: int
) -> dict[str, DataFrame]:
    """One exchange by the coarsest keys, ``fewest`` or more; groups of a set are arrays joined from those of the next finer set.

    Sets of fewer keys have groups too large for arrays: their values leave the last level as they are, and are read again.
    """
    large = {name: s for name, s in sets.items() if len(s.keys) < fewest}
    levels = sorted({tuple(s.keys) for s in sets.values() if len(s.keys) >= fewest}, key=len, reverse=True)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    ids = [named(k) for k in levels[0]]
    flagged = df.select("*", *[is_complete(df, m).alias(f"__m{i}") for i, m in enumerate(masks)])
    values = [F.when(F.col(f"__m{m}"), clean_value(c)).alias(f"__v{i}") for i, (m, c) in enumerate(pairs)]
    rows = flagged.select(*ids, *values).repartition(*[named(k) for k in levels[-1]])
    numbers = range(len(pairs))
    held = rows.groupBy(*ids).agg(
        *[F.collect_list(f"__v{i}").alias(f"__v{i}") for i in numbers],
        *[F.array(F.struct(F.count(f"__v{i}").alias("n"), F.avg(f"__v{i}").alias("mean"), F.coalesce(F.var_pop(f"__v{i}") * F.count(f"__v{i}"), F.lit(0.0)).alias("m2"))).alias(f"__s{i}") for i in numbers],
    )
    for k, keys in enumerate(levels):
        if k:
            held = held.groupBy(*[named(c) for c in keys]).agg(
                *[F.flatten(F.collect_list(c)).alias(c) for c in held.columns if c not in levels[0]]
            )
        found = []
        for name, s in sets.items():
            if tuple(s.keys) == keys:
                own = [pairs.index((masks.index(s.filled(df)), c)) for c in sorted(s.columns)]
                key = [(named(c) if c in keys else F.lit(None).cast(kinds[c])).alias(c) for c in levels[0]]
                found.append(_array_rows(name, key, sorted(s.columns), own, s.percentiles))
        held = held.withColumn("__out", F.concat(*[F.col("__out")] * (k > 0), *found))
    # what is found travels along to the last level, so that there is one plan and one exchange
    out = {}
    if large:
        ids = [named(k) for k in levels[-1]]
        again = list(dict.fromkeys(pairs.index((masks.index(s.filled(df)), c)) for s in large.values() for c in s.columns))
        kept = cut(held.select(*ids, "__out", *[f"__v{i}" for i in again]))
        whole = kept.select(F.inline("__out"))
        for name, s in large.items():
            values = F.arrays_zip(*[F.col(f"__v{pairs.index((masks.index(s.filled(df)), c))}").alias(c) for c in s.columns])
            raw = kept.select(*[named(k) for k in s.keys], F.inline_outer(values))
            long = describe_values(raw, s.keys, sorted(s.columns), s.percentiles, limit)
            out[name] = statistics_rows(long, s.keys, sorted(s.columns), s.percentiles)
    else:
        whole = cut(held.select(F.inline("__out")))
    out |= {
        name: statistics_rows(whole.where(F.col("__set") == name), s.keys, sorted(s.columns), s.percentiles)
        for name, s in sets.items() if name not in large
    }
    return {name: out[name] for name in sets}


def _array_rows(name: str, ids: Sequence[Column], columns: Sequence[str], numbers: Sequence[int], probs: Sequence[float]) -> Column:
    """An array of a struct per column with all statistics, from arrays of values and of the moments of their parts."""
    held = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.sort_array(f"__v{i}").alias("v"), F.filter(f"__s{i}", lambda x: x["n"] > 0).alias("s"))
            for c, i in zip(columns, numbers, strict=True)
        ]
    )

    def with_mean(e: Column) -> Column:
        total = F.aggregate(e["s"], F.lit(0.0), lambda a, x: a + x["n"] * x["mean"])
        mean = total / F.nullif(F.size(e["v"]), F.lit(0))
        return F.struct(*[e[c].alias(c) for c in ("metric", "v", "s")], mean.alias("mean"))

    def with_all(e: Column) -> Column:
        n, v = F.size(e["v"]).cast("long"), e["v"]
        m2 = F.aggregate(e["s"], F.lit(0.0), lambda a, x: a + x["m2"] + x["n"] * (x["mean"] - e["mean"]) * (x["mean"] - e["mean"]))
        return F.struct(
            F.lit(name).alias("__set"), *ids, e["metric"].alias("metric"), n.alias("count"), e["mean"].alias("mean"),
            F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"), F.get(v, F.lit(0)).alias("min"), F.get(v, F.size(v) - 1).alias("max"),
            array_quantiles(probs, v).alias("q"),
        )

    return F.transform(F.transform(held, with_mean), with_all)


def statistics_rows(
    long: DataFrame, keys: Sequence[str], columns: Sequence[str], percentiles: Sequence[float]
) -> DataFrame:
    """Reshape one row per (key, metric) into one row per (key, statistic)."""
    named_stats = [("count", F.col("count").cast("double"))]
    named_stats += [(s, F.col(s)) for s in ("mean", "std", "min")]
    named_stats += [(percentile_label(p), F.col("q")[i]) for i, p in enumerate(percentiles)]
    named_stats.append(("max", F.col("max")))
    entries = F.array(
        *[F.struct(F.lit(s).alias("statistic"), v.alias("value")) for s, v in named_stats]
    )
    ids = [named(k) for k in keys]
    return (
        long.select(*ids, "metric", F.inline(entries))
        .groupBy(*ids, "statistic")
        .agg(*[F.max(F.when(F.col("metric") == c, F.col("value"))).alias(c) for c in columns])
    )


def summary_table(
    df: DataFrame, columns: Sequence[str], state: FilterState | None = None
) -> DataFrame:
    """Count, mean and std of some columns after a filter: one row per statistic."""
    rows = df if state is None else df.where(state.predicate())
    values = {c: finite_or_null(named(c).cast("double")) for c in columns}
    one_row = rows.agg(
        *[
            F.array(F.count(v).cast("double"), F.avg(v), F.stddev_samp(v)).alias(c)
            for c, v in values.items()
        ]
    )
    entries = [
        F.struct(F.lit(s).alias("statistic"), *[named(c)[i].alias(c) for c in columns])
        for i, s in enumerate(("count", "mean", "std"))
    ]
    return one_row.select(F.inline(F.array(*entries)))


def selection_title(df: DataFrame, column: str, state: FilterState | None = None) -> DataFrame:
    """Mean, std and number of selected rows, and the text shown above a plot."""
    rows = df if state is None else df.where(state.predicate())
    value = finite_or_null(named(column).cast("double"))
    return rows.agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n")
    ).withColumn(
        "title", F.format_string("mean = %.3f, std = %.3f (%d)", F.col("mean"), F.col("std"), F.col("n"))
    )


def union_stats(tables: Mapping[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Stack statistics tables under a ``dataset`` label; columns sorted, gaps NULL."""
    labelled = [t.withColumn(name, F.lit(label)) for label, t in tables.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
    return whole.select(*[named(c) for c in sorted(whole.columns)])


def extent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of each column: one row per column."""
    one_row = df.agg(*[f(finite_or_null(named(c).cast("double"))).alias(f"{c}__{n}")
                       for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    entries = [
        F.struct(F.lit(c).alias("column"), named(f"{c}__lo").alias("lo"), named(f"{c}__hi").alias("hi"))
        for c in columns
    ]
    return one_row.select(F.inline(F.array(*entries)))


def colour_range(
    df: DataFrame,
    column: str,
    position: Sequence[str] = ("ra", "dec"),
    override: Mapping[str, tuple[float, float]] | None = None,
    percentiles: tuple[float, float] = (0.005, 0.995),
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Colour limits of a metric over the whole table (0.5 % to 99.5 %) and the position
    extents, one row per column. A caller's own limits win."""
    override = dict(override or {})
    plain = [c for c in position if c not in override]
    wanted = [] if column in override else [column]
    rows = []
    if wanted or plain:  # extents come with the summary of the metric
        held = cut(summarise(df, [], list(dict.fromkeys([*wanted, *plain])), sketched=wanted))
        if wanted:
            (q,) = refine(df, [Request([], wanted, percentiles, held.where(F.col("metric") == column))], max_group_rows)
            held = held.join(q, "metric", "left")
        else:
            held = held.withColumn("q", no_quantiles(percentiles))
        inner = F.col("metric").isin(wanted)
        lo, hi = (F.when(inner, F.col("q")[i]).otherwise(F.col(c)) for i, c in enumerate(("min", "max")))
        rows.append(held.select(F.col("metric").alias("column"), lo.alias("lo"), hi.alias("hi")))
    if override:
        given = [F.struct(F.lit(c).alias("column"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
                 for c, (lo, hi) in override.items()]
        rows.append(df.sparkSession.range(1).select(F.inline(F.array(*given))))
    return reduce(lambda a, b: a.unionByName(b), rows)


def dimension_ranges(
    df: DataFrame,
    stats: DataFrame,
    metrics: Sequence[str],
    position: Sequence[str] = ("ra", "dec", "psfMag"),
    percentiles: tuple[float, float] | None = (0.01, 0.99),
    available: Sequence[str] = tuple(percentile_label(p) for p in PERCENTILES),
    max_group_rows: int = MAX_GROUP_ROWS,
    summaries: DataFrame | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Display range of each dimension, one row per column.

    Positions take the least ``min`` and greatest ``max`` over the statistics rows; metrics
    take the least low percentile and the greatest high percentile. Metrics or percentiles
    that the statistics table lacks are computed from the data: in one pass if ``summaries``
    (:func:`key_summaries`) were kept, in none if ``totals``, statistics of the whole table over
    all values, hold them.
    """
    labels = ("min", "max") if percentiles is None else tuple(percentile_label(p) for p in percentiles)
    known = set(available) | {"min", "max"}
    from_stats = [m for m in metrics if m in stats.columns and set(labels) <= known]
    from_data = [m for m in metrics if m not in from_stats]
    wanted = {c: ("min", "max") for c in position} | {m: labels for m in from_stats}

    def picked(c: str, label: str) -> Column:
        return F.when(F.col("statistic") == label, named(c))

    one_row = stats.agg(
        *[F.min(picked(c, lo)).alias(f"{c}__lo") for c, (lo, _) in wanted.items()],
        *[F.max(picked(c, hi)).alias(f"{c}__hi") for c, (_, hi) in wanted.items()],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), named(f"{c}__lo").alias("lo"), named(f"{c}__hi").alias("hi"))
        for c in wanted
    ]
    ranges = one_row.select(F.inline(F.array(*entries)))
    if not from_data:
        return ranges
    if percentiles is None:
        return ranges.unionByName(extent(df, from_data))
    given = [] if totals is None else [m for m in from_data if m in totals.columns]
    if given:
        ranges = ranges.unionByName(_label_rows(totals, given, labels))
    if not (rest := [m for m in from_data if m not in given]):
        return ranges
    if summaries is not None:
        whole = cut(merged(summaries.where(~F.col("complete") & F.col("metric").isin(rest)), []))
        (q,) = refine(df, [Request([], rest, percentiles, whole)], max_group_rows)
        q = whole.select("metric").join(q, "metric", "left").withColumn("q", F.coalesce("q", no_quantiles(percentiles)))
    else:
        q = quantiles(df, [], rest, percentiles, max_group_rows)
    computed = q.select(F.col("metric").alias("column"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return ranges.unionByName(computed)


def _label_rows(stats: DataFrame, columns: Sequence[str], labels: tuple[str, str]) -> DataFrame:
    """``column, lo, hi`` from the rows of two statistics."""
    lo, hi = ([F.max(F.when(F.col("statistic") == label, named(c))) for c in columns] for label in labels)
    one_row = stats.agg(*[x.alias(f"lo|{c}") for x, c in zip(lo, columns, strict=True)], *[x.alias(f"hi|{c}") for x, c in zip(hi, columns, strict=True)])
    entries = [F.struct(F.lit(c).alias("column"), named(f"lo|{c}").alias("lo"), named(f"hi|{c}").alias("hi")) for c in columns]
    return one_row.select(F.inline(F.array(*entries)))


def dimension_values(
    df: DataFrame, categories: Sequence[str] = ("filter", "patch", "tract"), flags: Sequence[str] | None = None
) -> DataFrame:
    """The values of each categorical dimension, one row per value; flags are true and false."""
    flags = flag_columns(df) if flags is None else list(flags)
    present = [c for c in categories if c in df.columns]
    found = (
        df.select(*[named(c).cast("string").alias(c) for c in present])
        .unpivot([], [named(c) for c in present], "dimension", "value")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    if not flags:
        return found
    fixed = F.array(
        *[F.struct(F.lit(f).alias("dimension"), F.lit(v).alias("value")) for f in flags for v in ("true", "false")]
    )
    return found.unionByName(df.sparkSession.range(1).select(F.inline(fixed)))


def info_counts(
    coadd_stats: DataFrame,
    visit_stats: DataFrame,
    objects: DataFrame | None,
    active_tracts: Sequence[int] = (),
    tract_name: str = "tract",
    visit_name: str = "visit",
) -> DataFrame:
    """One row: number of tracts (active, else all), distinct visits and selected objects."""
    visits = visit_stats.where(named(tract_name).isin(list(active_tracts))) if active_tracts else visit_stats
    tracts = (
        F.lit(len(active_tracts)).cast("long")
        if active_tracts
        else coadd_stats.agg(F.count_distinct(named(tract_name))).scalar()
    )
    n_objects = F.lit(0).cast("long") if objects is None else objects.agg(F.count(F.lit(1))).scalar()
    return coadd_stats.sparkSession.range(1).select(
        tracts.alias("tract_count"),
        visits.agg(F.count_distinct(named(visit_name))).scalar().alias("visit_count"),
        n_objects.alias("object_count"),
    )


def patch_count(
    df: DataFrame,
    filters: Sequence[str] = (),
    tracts: Sequence[int] = (),
    filter_name: str = "filter",
    tract_name: str = "tract",
    patch_name: str = "patch",
) -> DataFrame:
    """Number of distinct patches (a patch name is unique within its tract)."""
    rows = df
    if filters:
        rows = rows.where(named(filter_name).isin(list(filters)))
    if tracts:
        rows = rows.where(named(tract_name).isin(list(tracts)))
    return rows.agg(F.count_distinct(named(tract_name), named(patch_name)).alias("patch_count"))
