"""Exact grouped quantiles and moments over groups of any size.

``percentile`` keeps the distinct values of a group in one task's memory. A key that
holds a third of a large table would not fit there, so groups are split by size first:

* if every group is small, each becomes a sorted array per column, which is fastest;
* ordinary groups are ranked by one sorted window. The sort spills, there is one
  exchange, and the moments ride along in the same aggregate;
* groups above ``max_group_rows`` are never brought together. Kept summaries (see
  :mod:`skyqa.functions.summaries`) bound where the quantiles lie and one more pass
  finds them exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, named
from skyqa.functions.frames import broadcast_if_small, cut, join_on
from skyqa.functions.summaries import Request, refine, sample_std, summarise

#: Rows of one key that a single task may rank.
MAX_GROUP_ROWS = 1_000_000

#: Values (rows times columns) of one key that may be held as arrays. Spark holds the arrays
#: of up to 128 keys before it sorts instead, so this bounds the memory of a task.
ARRAY_CELLS = 200_000


def _value(column: str) -> Column:
    return finite_or_null(named(column).cast("double"))


def to_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (row, column): ``keys..., metric, value``; non-finite values are NULL."""
    return df.select(
        *[named(k) for k in keys], *[_value(c).alias(c) for c in columns]
    ).unpivot([named(k) for k in keys], [named(c) for c in columns], "metric", "value")


def describe_columns(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    where: Column | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    array_cells: int = ARRAY_CELLS,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Count, mean, sample std, min, max and exact linear quantiles per key and column.

    Returns ``keys..., metric, count, mean, std, min, max, q`` with ``q`` an array in the
    order of ``probs``. Rows for which ``where`` does not hold add nothing, yet their
    keys still appear (with ``count = 0`` when no other row has that key).

    ``summaries`` are those of the same keys, columns and condition, if they were kept: the rows
    are then read once, and no group is brought together but small ones.
    """
    probs = [float(p) for p in probs]
    if not probs:
        return _moments(df, keys, columns, where).withColumn("q", no_quantiles(probs))
    if summaries is not None:
        sizes = summaries.where(F.col("metric") == list(columns)[0]).select(*[named(k) for k in keys], F.col("rows").alias("__n"))
        widest = sizes.agg(F.max("__n")).first()[0] if keys else None
        if widest is not None and widest * len(columns) <= array_cells and widest <= max_group_rows:
            return _describe_arrays(df, keys, columns, probs, where, sizes)
        return _describe_split(df, keys, columns, probs, where, max_group_rows, summaries)
    n_keys, n_large, widest, sizes = _group_sizes(df, keys, max_group_rows)
    if widest * len(columns) <= array_cells and widest <= max_group_rows:
        return _describe_arrays(df, keys, columns, probs, where, sizes)
    if n_large == 0:
        return _describe_ranked(df, keys, columns, probs, where, n_keys, sizes)
    if n_large == n_keys:
        return _describe_split(df, keys, columns, probs, where, max_group_rows)
    marked = broadcast_if_small(sizes.where(F.col("__n") > max_group_rows).drop("__n"))
    small, large = (join_on(df, marked, keys, how) for how in ("left_anti", "left_semi"))
    few = sizes.where(F.col("__n") <= max_group_rows)
    return _describe_ranked(small, keys, columns, probs, where, n_keys, few).unionByName(
        _describe_split(large, keys, columns, probs, where, max_group_rows)
    )


def describe_values(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """:func:`describe_columns` of a frame that is cheap to read twice and has large groups: they are never brought together."""
    probs = [float(p) for p in probs]
    return _describe_split(df, keys, columns, probs, None, max_group_rows) if probs else _moments(df, keys, columns, None).withColumn("q", no_quantiles(probs))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``keys..., metric, q``: exact linear quantiles of the non-missing values."""
    return describe_columns(df, keys, columns, probs, max_group_rows=max_group_rows).select(
        *[named(k) for k in keys], "metric", "q"
    )


def _group_sizes(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[int, int, int, DataFrame]:
    """Number of keys, number of keys with more than ``limit`` rows, most rows of a key, and
    the rows per key.

    Reads the key columns only, which for a partitioned table are not even in the files.
    """
    sizes = cut(df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n")))
    n_keys, n_large, widest = sizes.agg(
        F.count(F.lit(1)), F.count_if(F.col("__n") > limit), F.coalesce(F.max("__n"), F.lit(0))
    ).first()
    return n_keys, n_large, widest, sizes


def _moments(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    where: Column | None,
) -> DataFrame:
    """``keys..., metric, count, mean, std, min, max``.

    One aggregate over whole rows that combines before the exchange, whatever the size of
    a group. Keys whose rows all fail ``where`` are there with a count of 0.
    """
    fields = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    ids = [named(k) for k in keys]
    values = [_value(c) if where is None else F.when(where, _value(c)) for c in columns]
    rows = df.select(*ids, *[v.alias(f"__v{i}") for i, v in enumerate(values)])
    aggregates, entries = [], []
    for i, c in enumerate(columns):
        aggregates += [make(F.col(f"__v{i}")).alias(f"{name}|{i}") for name, make in fields.items()]
        entries.append(
            F.struct(F.lit(c).alias("metric"), *[F.col(f"`{name}|{i}`").alias(name) for name in fields])
        )
    return rows.groupBy(*ids).agg(*aggregates).select(*ids, F.inline(F.array(*entries)))


def _complete_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], where: Column | None, sizes: DataFrame
) -> DataFrame:
    """Keys and clean values of the rows that count, and one row without values per key,
    which keeps the keys that have no row left."""
    ids = [named(k) for k in keys]
    rows = (df if where is None else df.where(where)).select(*ids, *[_value(c).alias(c) for c in columns])
    if keys and where is not None:
        rows = rows.unionByName(sizes.select(*ids), allowMissingColumns=True)
    return rows


def _describe_arrays(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    where: Column | None,
    sizes: DataFrame,
) -> DataFrame:
    """Exchange whole rows once, sort every column of a key as an array and pick positions."""
    ids = [named(k) for k in keys]
    rows = _complete_rows(df, keys, columns, where, sizes)
    aggregates, entries = [], []
    for i, c in enumerate(columns):
        aggregates += [
            F.collect_list(named(c)).alias(f"__v{i}"),
            F.avg(named(c)).alias(f"__mean{i}"),
            F.stddev_samp(named(c)).alias(f"__std{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(c).alias("metric"),
                F.sort_array(F.col(f"__v{i}")).alias("v"),
                F.col(f"__mean{i}").alias("mean"),
                F.col(f"__std{i}").alias("std"),
            )
        )
    grouped = (rows.repartition(*ids) if keys else rows).groupBy(*ids).agg(*aggregates)
    n = F.size("v").cast("long")
    return grouped.select(*ids, F.inline(F.array(*entries))).select(
        *ids,
        "metric",
        n.alias("count"),
        "mean",
        "std",
        F.get("v", F.lit(0)).alias("min"),
        F.get("v", F.size("v") - 1).alias("max"),
        array_quantiles(probs).alias("q"),
    )


def array_quantiles(probs: Sequence[float], v: Column | None = None) -> Column:
    """Exact linear quantiles of a sorted array (default: the column ``v``)."""
    v = F.col("v") if v is None else v
    n = F.size(v).cast("long")

    def quantile(p: float) -> Column:
        at = F.lit(p) * (n - 1)
        low = F.floor(at).cast("int")
        here, after = F.get(v, low), F.get(v, low + 1)
        return here + F.coalesce((after - here) * (at - low), F.lit(0.0))

    return F.array(*[quantile(p) for p in probs])


def _describe_ranked(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    where: Column | None,
    n_keys: int,
    sizes: DataFrame,
) -> DataFrame:
    """Rank the cells of every group in one sorted window.

    With many keys the rows are exchanged whole and taken apart afterwards, which moves each
    key once instead of once per column. With few keys the cells are exchanged, so that
    the columns of one key can be sorted by different tasks.
    """
    ids = [named(k) for k in keys]
    rows = _complete_rows(df, keys, columns, where, sizes)
    if n_keys >= 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(*ids)
    cells = [F.struct(F.lit(i).alias("metric"), named(c).alias("value")) for i, c in enumerate(columns)]
    ranked = _rank(rows.select(*ids, F.inline(F.array(*cells))), [*keys, "metric"], probs)
    names = F.array(*[F.lit(c) for c in columns])
    return ranked.withColumn("metric", names[F.col("metric")])


def _rank(cells: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    by_group = [named(g) for g in group]
    ranked = cells.select(
        *by_group,
        "value",
        (F.row_number().over(W.partitionBy(*by_group).orderBy(F.asc_nulls_last("value"))) - 1).alias("__at"),
        F.count("value").over(W.partitionBy(*by_group)).alias("__n"),
    )

    def quantile(p: float) -> Column:
        # linear interpolation: the two rows next to the wanted position share weight 1
        gap = F.abs(F.col("__at") - F.lit(p) * (F.col("__n") - 1))
        return F.sum(F.when(gap < 1, F.col("value") * (1 - gap)))

    return ranked.groupBy(*by_group).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.array(*[quantile(p) for p in probs]).alias("q"),
    )


def _describe_split(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    where: Column | None,
    limit: int,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Moments from kept summaries and quantiles by one more pass between the bounds of their sketches."""
    held = cut(summarise(df, keys, columns, where)) if summaries is None else summaries
    (q,) = refine(df, [Request(keys, columns, probs, held, where)], limit)
    moments = held.where(F.col("metric").isin(list(columns))).select(
        *[named(k) for k in keys], "metric", "count", "mean", sample_std().alias("std"), "min", "max"
    )
    return join_on(moments, q, [*keys, "metric"], "left").withColumn("q", F.coalesce("q", no_quantiles(probs)))


def no_quantiles(probs: Sequence[float]) -> Column:
    return F.array(*[F.lit(None) for _ in probs]).cast("array<double>")
