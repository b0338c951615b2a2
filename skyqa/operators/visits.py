"""Per-visit series, normalised summaries and box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, named
from skyqa.functions.frames import broadcast_if_small, cut, join_on
from skyqa.functions.quantiles import MAX_GROUP_ROWS, describe_columns, quantiles


def visit_series(
    stats: DataFrame,
    filter_value: str,
    metrics: Sequence[str],
    statistic: str = "mean",
    filter_name: str = "filter",
    visit_name: str = "visit",
) -> DataFrame:
    """One statistic of one filter as a series: per visit, the median over its tracts.

    The input is a statistics table, so a visit has at most one row per tract of the sky.
    """
    chosen = stats.where((named(filter_name) == F.lit(filter_value)) & (F.col("statistic") == statistic))
    return (
        chosen.groupBy(named(visit_name))
        .agg(*[F.median(named(m)).alias(m) for m in metrics])
        .orderBy(named(visit_name))
    )


def visit_series_long(
    stats: DataFrame,
    filter_value: str,
    metrics: Sequence[str],
    statistic: str = "mean",
    filter_name: str = "filter",
    visit_name: str = "visit",
) -> tuple[DataFrame, list[str]]:
    """Several series stacked as ``visit, series, value``, and the metrics that do not exist.

    Series are called ``<metric>_<statistic>``. Rows are in numeric visit order; the visit
    itself is a label, hence a string.
    """
    present = [m for m in metrics if m in stats.columns]
    missing = [m for m in metrics if m not in stats.columns]
    if not present:
        empty = stats.where(F.lit(False)).select(named(visit_name).cast("string").alias(visit_name))
        return empty.select("*", F.lit("").alias("series"), F.lit(0.0).alias("value")), missing
    wide = visit_series(stats, filter_value, present, statistic, filter_name, visit_name)
    renamed = wide.withColumnsRenamed({m: f"{m}_{statistic}" for m in present})
    long = renamed.unpivot(
        [named(visit_name)], [named(f"{m}_{statistic}") for m in present], "series", "value"
    )
    return long.orderBy(named(visit_name), "series").withColumn(
        visit_name, named(visit_name).cast("string")
    ), missing


def visit_mean_std(
    df: DataFrame, metrics: Sequence[str], visit_name: str = "visit", keys: Sequence[str] = ()
) -> DataFrame:
    """``visit, metric, n, mean, std`` over the rows where the metric has a value."""
    group = [*[named(k) for k in keys], named(visit_name)]
    values = {m: finite_or_null(named(m).cast("double")) for m in metrics}
    wide = df.groupBy(*group).agg(
        *[F.struct(F.count(v), F.avg(v), F.stddev_samp(v)).alias(m) for m, v in values.items()]
    )
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            named(m)["col1"].alias("n"),
            named(m)["col2"].alias("mean"),
            named(m)["col3"].alias("std"),
        )
        for m in metrics
    ]
    return wide.select(*group, F.inline(F.array(*entries))).where(F.col("n") > 0)


def visit_normalized(
    df: DataFrame,
    metrics: Sequence[str],
    normalizer: str | None = "minmax",
    visit_name: str = "visit",
    max_group_rows: int = MAX_GROUP_ROWS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``visit, metric, n, mean, std`` of metrics normalised over the whole table.

    ``minmax`` maps each metric to [0, 1]; ``robust`` subtracts the median and divides by the
    interquartile range; None leaves it alone. A metric without spread is divided by 1.
    With ``keys`` (a filter and a tract, say) every key is normalised by itself.
    Both maps are linear, so they are applied to the per-visit results: the table is
    scanned once for the visits (``robust`` needs its quartiles besides) and never rewritten.
    """
    values = {m: finite_or_null(named(m).cast("double")) for m in metrics}
    group = [*[named(k) for k in keys], named(visit_name)]
    wide = df.groupBy(*group).agg(
        *[
            F.struct(F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)).alias(m)
            for m, v in values.items()
        ]
    )
    fields = ("n", "mean", "std", "lo", "hi")
    per_visit = wide.select(
        *group,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        *[named(m)[f"col{i}"].alias(f) for i, f in enumerate(fields, 1)],
                    )
                    for m in metrics
                ]
            )
        ),
    )
    scaled = _with_scale(per_visit, df, metrics, normalizer, keys, max_group_rows)
    return scaled.where(F.col("n") > 0).select(
        *group,
        "metric",
        "n",
        ((F.col("mean") - F.col("__centre")) / F.col("__scale")).alias("mean"),
        (F.col("std") / F.col("__scale")).alias("std"),
    )


def _with_scale(
    per_visit: DataFrame,
    df: DataFrame,
    metrics: Sequence[str],
    normalizer: str | None,
    keys: Sequence[str],
    max_group_rows: int,
) -> DataFrame:
    """Add ``__centre`` and ``__scale`` of each key and metric; ``lo`` and ``hi`` are a visit's extremes."""
    if normalizer == "robust":
        q = quantiles(df, keys, metrics, (0.25, 0.5, 0.75), max_group_rows)
        if keys:
            per_visit = join_on(per_visit, q, [*keys, "metric"], "left")
        else:  # one row per metric: as many as there are columns
            per_visit = per_visit.join(F.broadcast(q), "metric", "left")
        centre, spread = F.col("q")[1], F.col("q")[2] - F.col("q")[0]
    elif normalizer == "minmax":
        # the extremes of a key are the extremes of its visits
        of_metric = W.partitionBy(*[named(k) for k in keys], "metric")
        centre = F.min("lo").over(of_metric)
        spread = F.max("hi").over(of_metric) - centre
    elif normalizer is None:
        centre, spread = F.lit(0.0), F.lit(1.0)
    else:
        raise ValueError(f"unknown normalizer {normalizer!r}")
    return per_visit.withColumn("__centre", centre).withColumn(
        "__scale", F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    )


def visit_minmax_median(
    df: DataFrame,
    metrics: Sequence[str],
    visit_name: str = "visit",
    max_group_rows: int = MAX_GROUP_ROWS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``visit, metric, median`` of metrics scaled to [0, 1] over the whole table, or over each key."""
    group = [*keys, visit_name]
    per_visit = describe_columns(df, group, metrics, (0.5,), max_group_rows=max_group_rows)
    per_visit = per_visit.withColumnsRenamed({"min": "lo", "max": "hi"})
    scaled = _with_scale(per_visit, df, metrics, "minmax", keys, max_group_rows).where(F.col("count") > 0)
    median = (F.col("q")[0] - F.col("__centre")) / F.col("__scale")
    return scaled.select(*[named(k) for k in group], "metric", median.alias("median"))


def visit_box_whisker(
    df: DataFrame,
    metrics: Sequence[str],
    visit_name: str = "visit",
    max_group_rows: int = MAX_GROUP_ROWS,
    normalizer: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Box statistics: ``visit, metric, q1, median, q3, lower, upper, n_outliers, n``.

    Whiskers end at the furthest values within 1.5 interquartile ranges of the box. With ``by`` there is a
    box for each visit of each key. ``normalizer`` is as in :func:`visit_normalized`, over the whole table
    or each key; being linear it is applied to the boxes.
    """
    keys = [*by, visit_name]
    visit = [named(k) for k in keys]
    box = cut(
        quantiles(df, keys, metrics, (0.25, 0.5, 0.75), max_group_rows)
        .where(F.col("q")[0].isNotNull())
        .select(
            *visit,
            "metric",
            F.col("q")[0].alias("q1"),
            F.col("q")[1].alias("median"),
            F.col("q")[2].alias("q3"),
        )
    )
    # one row of limits per visit, so that the table is joined and aggregated in whole rows
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    bounds = {"lo": F.col("q1") - reach, "hi": F.col("q3") + reach}
    limits = box.groupBy(*visit).agg(
        *[
            F.max(F.when(F.col("metric") == m, bound)).alias(f"__{name}{i}")
            for i, m in enumerate(metrics)
            for name, bound in bounds.items()
        ]
    )
    values = [finite_or_null(named(m).cast("double")).alias(f"__v{i}") for i, m in enumerate(metrics)]
    aggregates, entries = [], []
    for i, m in enumerate(metrics):
        value = F.col(f"__v{i}")
        inside = value.between(F.col(f"__lo{i}"), F.col(f"__hi{i}"))
        ends = {
            "lower": F.min(F.when(inside, value)),
            "upper": F.max(F.when(inside, value)),
            "n_outliers": F.count_if(~inside),
            "n": F.count(value),
            "lo_value": F.min(value),
            "hi_value": F.max(value),
        }
        aggregates += [a.alias(f"__{name}{i}") for name, a in ends.items()]
        entries.append(
            F.struct(F.lit(m).alias("metric"), *[F.col(f"__{name}{i}").alias(name) for name in ends])
        )
    found = (
        join_on(df.select(*visit, *values), broadcast_if_small(limits), keys)
        .groupBy(*visit)
        .agg(*aggregates)
        .select(*visit, F.inline(F.array(*entries)))
    )
    boxes = join_on(box, found, [*keys, "metric"]).withColumnsRenamed({"lo_value": "lo", "hi_value": "hi"})
    scaled = _with_scale(boxes, df, metrics, normalizer, by, max_group_rows)
    ends = ("q1", "median", "q3", "lower", "upper")
    return scaled.select(
        *visit,
        "metric",
        *[((F.col(c) - F.col("__centre")) / F.col("__scale")).alias(c) for c in ends],
        "n_outliers",
        "n",
    )
