"""Two-dimensional binning: sky maps, scatter density and layered density.

Every raster is a combinable aggregate on the bin numbers. What is shuffled is at most one
row per bin and input task, whatever the number of objects or the crowding of one bin.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, named
from skyqa.operators.filters import FilterState

# Fixed value: default raster size.
SAMPLING = 5000


@dataclass(frozen=True)
class Axis:
    """One raster axis. Without limits, or with limits that are not finite, the extent of
    the table is used; with limits, rows outside them are left out."""

    column: str
    bins: int = SAMPLING
    lo: float | None = None
    hi: float | None = None

    @property
    def has_viewport(self) -> bool:
        return None not in (self.lo, self.hi) and math.isfinite(self.lo) and math.isfinite(self.hi)

    def value(self) -> Column:
        return finite_or_null(named(self.column).cast("double"))

    def limits(self, df: DataFrame) -> tuple[Column, Column]:
        """Viewport limits as literals, else the extent of ``df`` as a scalar subquery."""
        if self.has_viewport:
            return F.lit(float(self.lo)), F.lit(float(self.hi))
        found = df.agg(F.struct(F.min(self.value()).alias("lo"), F.max(self.value()).alias("hi"))).scalar()
        return found["lo"], found["hi"]

    def bin(self, limits: tuple[Column, Column]) -> Column:
        """``floor((v - lo) / (hi - lo) * bins)``, the top edge in the last bin, NULL outside."""
        lo, hi = limits
        v = self.value()
        place = F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(self.bins))
        index = F.least(F.coalesce(place, F.lit(0)), F.lit(self.bins - 1)).cast("int")
        return F.when((v >= lo) & (v <= hi), index)

    def centre(self, index: Column, limits: tuple[Column, Column]) -> Column:
        lo, hi = limits
        return lo + (index + F.lit(0.5)) * (hi - lo) / F.lit(self.bins)


def _viewport(axis: Axis) -> Column:
    # a plain range on the raw column, so that the Parquet scan can use it
    return named(axis.column).between(axis.lo, axis.hi) if axis.has_viewport else F.lit(True)


def _aggregate(aggregator: str, column: str | None) -> Column:
    if aggregator == "count":
        return F.count(F.lit(1))
    if column is None:
        raise ValueError(f"aggregator {aggregator!r} needs a value column")
    value = finite_or_null(named(column).cast("double"))
    if aggregator == "mean":
        return F.avg(value)
    if aggregator == "std":
        return F.stddev_pop(value)
    raise ValueError(f"unknown aggregator {aggregator!r}")


def raster(
    df: DataFrame,
    x: Axis,
    y: Axis,
    aggregates: dict[str, Column],
    state: FilterState | None = None,
) -> DataFrame:
    """``ix, iy`` and the given aggregates. Extents come from ``df`` before the state applies,
    so that a selection does not change the grid."""
    rows = df.where(_viewport(x) & _viewport(y))
    if state is not None:
        rows = rows.where(state.predicate())
    ix, iy = x.bin(x.limits(df)).alias("ix"), y.bin(y.limits(df)).alias("iy")
    return (
        rows.groupBy(ix, iy)
        .agg(*[a.alias(n) for n, a in aggregates.items()])
        .where(F.col("ix").isNotNull() & F.col("iy").isNotNull())
    )


def sky_raster(
    df: DataFrame,
    value: str | None,
    aggregator: str = "mean",
    x: Axis = Axis("ra"),
    y: Axis = Axis("dec"),
    state: FilterState | None = None,
) -> DataFrame:
    """Sky map of one metric: ``ix, iy, n, value`` with the mean, std or count per bin."""
    return raster(
        df, x, y, {"n": F.count(F.lit(1)), "value": _aggregate(aggregator, value)}, state
    )


def scatter_density(
    df: DataFrame,
    x: Axis,
    y: Axis,
    ra: Axis = Axis("ra"),
    dec: Axis = Axis("dec"),
    state: FilterState | None = None,
) -> DataFrame:
    """Two rasters from one scan and one exchange: ``layer, ix, iy, n, value``.

    ``scatter`` counts points over (x, y); ``sky`` is the mean of y over (ra, dec). As in every
    raster, ``n`` counts the rows placed in a bin and ``value`` is over those of them that have one.
    """
    rows = df.where((_viewport(x) & _viewport(y)) | (_viewport(ra) & _viewport(dec)))
    if state is not None:
        rows = rows.where(state.predicate())

    def layer(name: str, a: Axis, b: Axis) -> Column:
        return F.struct(
            F.lit(name).alias("layer"),
            a.bin(a.limits(df)).alias("ix"),
            b.bin(b.limits(df)).alias("iy"),
        )

    placed = rows.select(
        y.value().alias("__y"), F.inline(F.array(layer("scatter", x, y), layer("sky", ra, dec)))
    ).where(F.col("ix").isNotNull() & F.col("iy").isNotNull())
    return placed.groupBy("layer", "ix", "iy").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("layer") == "sky", F.col("__y"))).alias("value")
    )


def raster_layers(df: DataFrame, x: Axis, y: Axis, state: FilterState) -> DataFrame:
    """Density of all rows and of the selected rows on one grid: ``ix, iy, n_all, n_selected``."""
    return raster(df, x, y, {"n_all": F.count(F.lit(1)), "n_selected": F.count_if(state.predicate())})


def sky_raster_multi(
    df: DataFrame,
    values: Sequence[str],
    x: Axis = Axis("ra"),
    y: Axis = Axis("dec"),
    state: FilterState | None = None,
) -> DataFrame:
    """Sky means of many metrics from one group-by: ``metric, ix, iy, value``."""
    wide = raster(df, x, y, {v: _aggregate("mean", v) for v in values}, state)
    return wide.unpivot(["ix", "iy"], [named(v) for v in values], "metric", "value").where(
        F.col("value").isNotNull()
    )


def scatter_density_multi(
    df: DataFrame,
    x: Axis,
    values: Sequence[Axis],
    ra: Axis = Axis("ra"),
    dec: Axis = Axis("dec"),
    state: FilterState | None = None,
) -> DataFrame:
    """The scatter and sky rasters of every value column: ``metric, layer, ix, iy, n, value``.

    Scatter bins of all metrics share one scan; sky bins share another. Each metric has the rows
    that :func:`scatter_density` gives for it.
    """
    rows = df.where(_viewport(x) & reduce(operator.or_, [_viewport(v) for v in values]))
    if state is not None:
        rows = rows.where(state.predicate())
    x_limits = x.limits(df)
    points = rows.select(
        x.bin(x_limits).alias("ix"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v.column).alias("metric"), v.bin(v.limits(df)).alias("iy"))
                    for v in values
                ]
            )
        ),
    ).where(F.col("ix").isNotNull() & F.col("iy").isNotNull())
    scatter = points.groupBy("metric", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    sky = raster(
        df,
        ra,
        dec,
        {"n": F.count(F.lit(1))} | {f"__{v.column}": F.avg(v.value()) for v in values},
        state,
    ).select(
        "ix",
        "iy",
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v.column).alias("metric"), named(f"__{v.column}").alias("value"))
                    for v in values
                ]
            )
        ),
    )
    columns = ["metric", "layer", "ix", "iy", "n", "value"]
    return (
        scatter.withColumn("layer", F.lit("scatter"))
        .withColumn("value", F.lit(None).cast("double"))
        .select(*columns)
        .unionByName(sky.withColumn("layer", F.lit("sky")).select(*columns))
    )


def adaptive_points(
    df: DataFrame,
    value: str,
    aggregator: str = "mean",
    x: Axis = Axis("ra"),
    y: Axis = Axis("dec"),
    state: FilterState | None = None,
    *,
    points: bool,
) -> DataFrame:
    """Points or a raster, as the caller says: ``x, y, n, value`` either way.

    A point has ``n = 1``; a bin has its centre, its count and its aggregate. Rows without a position are in neither.
    """
    if points:
        placed = x.value().isNotNull() & y.value().isNotNull()
        rows = df.where(_viewport(x) & _viewport(y)).where(placed)
        if state is not None:
            rows = rows.where(state.predicate())
        return rows.select(
            x.value().alias("x"),
            y.value().alias("y"),
            F.lit(1).cast("long").alias("n"),
            finite_or_null(named(value).cast("double")).alias("value"),
        )
    bins = sky_raster(df, value, aggregator, x, y, state)
    return bins.select(
        x.centre(F.col("ix"), x.limits(df)).alias("x"),
        y.centre(F.col("iy"), y.limits(df)).alias("y"),
        "n",
        F.col("value").cast("double").alias("value"),
    )
