"""Raster pyramids: bins of a catalogue stored on levels that double, so that a viewport reads its tiles only.

The finest level has ``2**levels`` bins on each side. A bin holds the number of its rows and, for each value column, count, mean and sum
of squared distances from the mean. A bin of the next level is made of at most four bins of this one, so levels roll
up exactly and cost a third of the finest level together. Bins are stored by level and tile.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyqa.functions.clean import named
from skyqa.functions.summaries import clean_value
from skyqa.operators.raster import Axis
from skyqa.sources.readers import is_complete


@dataclass(frozen=True)
class Grid:
    """The area of a pyramid, its finest level, and the level within a tile at which bins are stored together.

    ``by`` names key columns that have pyramids of their own, such as the filter.
    """

    x: str
    y: str
    x_range: tuple[float, float]
    y_range: tuple[float, float]
    levels: int = 12
    tile_levels: int = 8
    by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for lo, hi in (self.x_range, self.y_range):
            if not (math.isfinite(lo) and math.isfinite(hi) and lo < hi):
                raise ValueError("a pyramid needs a finite area")
        if not 0 <= self.levels <= 30 or self.tile_levels < 0:
            raise ValueError("0 to 30 levels, tiles of 0 or more")

    def axes(self) -> tuple[Axis, Axis]:
        bins = 1 << self.levels
        return Axis(self.x, bins, *self.x_range), Axis(self.y, bins, *self.y_range)


@dataclass(frozen=True)
class View:
    """A viewport in whole bins of one level: ``x_bins`` and ``y_bins`` are first bin and bin after the last."""

    level: int
    x_bins: tuple[int, int]
    y_bins: tuple[int, int]


def write_pyramid(df: DataFrame, path: str, grid: Grid, values: Sequence[str]) -> None:
    """Write the pyramid of ``df`` below ``path``: ``tiles`` by level and tile, and what the grid is.

    The rows are read once, for the finest level; each further level is made from the stored one below it. Rows without a position, or
    outside the area, are in no bin. A pyramid that was written only in part is not readable and is written anew.
    """
    spark = df.sparkSession
    x, y = grid.axes()
    keys = [named(k) for k in grid.by]
    rows = df.where(named(grid.x).between(*grid.x_range) & named(grid.y).between(*grid.y_range))
    limits = [(F.lit(float(lo)), F.lit(float(hi))) for lo, hi in (grid.x_range, grid.y_range)]
    placed = rows.select(
        *keys, x.bin(limits[0]).alias("ix"), y.bin(limits[1]).alias("iy"), *[clean_value(v).alias(f"__{v}") for v in values]
    ).where(F.col("ix").isNotNull() & F.col("iy").isNotNull())
    made = placed.groupBy(*keys, "ix", "iy").agg(F.count(F.lit(1)).alias("n"), *[_moments(f"__{v}").alias(v) for v in values])
    _write_level(made, path, grid, grid.levels)
    schema = _tiled(made, 0).schema
    for level in range(grid.levels - 1, -1, -1):
        finer = spark.read.schema(schema).parquet(f"{path}/tiles/level={level + 1}")
        half = [F.shiftright(c, 1).alias(c) for c in ("ix", "iy")]
        grouped = finer.select(*keys, *half, "n", *[named(v) for v in values]).groupBy(*keys, "ix", "iy")
        # at most four bins each
        parts = grouped.agg(F.sum("n").alias("n"), *[F.collect_list(named(v)).alias(v) for v in values])
        _write_level(parts.select(*keys, "ix", "iy", "n", *[_rolled_up(named(v)).alias(v) for v in values]), path, grid, level)
    about = [(json.dumps(asdict(grid)), schema.json())]
    spark.createDataFrame(about, "grid string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def _moments(column: str) -> Column:
    v = named(column)
    return F.struct(F.count(v).alias("count"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def _rolled_up(parts: Column) -> Column:
    """Moments of a bin from those of the bins that it is made of."""
    held = F.filter(parts, lambda p: p["count"] > 0)
    count = F.aggregate(held, F.lit(0).cast("long"), lambda a, p: a + p["count"])
    mean = F.aggregate(held, F.lit(0.0), lambda a, p: a + p["count"] * p["mean"]) / F.nullif(count, F.lit(0))
    m2 = F.aggregate(held, F.lit(0.0), lambda a, p: a + p["m2"] + p["count"] * (p["mean"] - mean) * (p["mean"] - mean))
    return F.struct(count.alias("count"), mean.alias("mean"), F.when(count > 0, m2).alias("m2"))


def _write_level(bins: DataFrame, path: str, grid: Grid, level: int) -> None:
    """Store the bins of a level by tile. Tiles without a bin have no file; a tile with many bins may have several."""
    tiled = _tiled(bins, min(grid.tile_levels, level))
    folders = [*grid.by, "tx", "ty"]
    order = [named(c) for c in folders]
    tiled.hint("rebalance", *order).sortWithinPartitions(*order, "ix", "iy").write.mode("overwrite").partitionBy(*folders).parquet(
        f"{path}/tiles/level={level}"
    )


def _tiled(bins: DataFrame, shift: int) -> DataFrame:
    return bins.withColumns({"tx": F.shiftright("ix", shift), "ty": F.shiftright("iy", shift)})


def open_pyramid(spark: SparkSession, path: str) -> Grid:
    """The grid of a pyramid that was written whole."""
    if not is_complete(spark, f"{path}/grid"):
        raise ValueError(f"{path} holds no complete pyramid")
    held = json.loads(spark.read.parquet(f"{path}/grid").first()["grid"])
    return Grid(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})


def view_of(grid: Grid, x_range: tuple[float, float], y_range: tuple[float, float], max_bins: int) -> View:
    """The finest level on which a viewport has at most ``max_bins`` bins on each side, and its bins there.

    The viewport is widened to whole bins and cut to the area; limits that are not finite mean the whole axis.
    """
    if max_bins < 1:
        raise ValueError("a viewport needs a bin")

    def bins(level: int, wanted: tuple[float, float], area: tuple[float, float]) -> tuple[int, int]:
        lo, hi = wanted if all(map(math.isfinite, wanted)) else area
        n = 1 << level
        first = math.floor((lo - area[0]) / (area[1] - area[0]) * n)
        last = math.ceil((hi - area[0]) / (area[1] - area[0]) * n)
        first = min(max(first, 0), n)
        return first, max(min(last, n), first)

    for level in range(grid.levels, -1, -1):
        view = View(level, bins(level, x_range, grid.x_range), bins(level, y_range, grid.y_range))
        if max(b - a for a, b in (view.x_bins, view.y_bins)) <= max_bins:
            return view
    return view


def view_edges(grid: Grid, view: View) -> tuple[tuple[float, float], tuple[float, float]]:
    """The limits of a view in the units of the axes."""
    n = 1 << view.level
    return tuple(
        tuple(lo + (hi - lo) * b / n for b in bins)
        for (lo, hi), bins in ((grid.x_range, view.x_bins), (grid.y_range, view.y_bins))
    )


def read_view(spark: SparkSession, path: str, grid: Grid, view: View, value: str | None, aggregator: str = "mean") -> DataFrame:
    """``by..., ix, iy, n, value`` of a view, as :func:`skyqa.operators.raster.sky_raster` gives them for its limits.

    Bins count from the corner of the view. Level and tiles are partition columns, so that only files of the view's tiles are opened.
    """
    shift = min(grid.tile_levels, view.level)
    tiles = [F.col(t).between(a >> shift, max(b - 1, a) >> shift) for t, (a, b) in (("tx", view.x_bins), ("ty", view.y_bins))]
    inside = [(F.col(c) >= a) & (F.col(c) < b) for c, (a, b) in (("ix", view.x_bins), ("iy", view.y_bins))]
    # stored, as an empty level has no file to tell it
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/grid").first()["schema"]))
    bins = spark.read.schema(schema).parquet(f"{path}/tiles/level={view.level}").where(tiles[0] & tiles[1] & inside[0] & inside[1])
    if aggregator == "count":
        made = F.col("n")
    elif value is None:
        raise ValueError(f"aggregator {aggregator!r} needs a value column")
    elif aggregator == "mean":
        made = named(value)["mean"]
    elif aggregator == "std":
        made = F.sqrt(named(value)["m2"] / F.nullif(named(value)["count"], F.lit(0)))
    else:
        raise ValueError(f"unknown aggregator {aggregator!r}")
    corner = [(F.col(c) - a).alias(c) for c, (a, _) in (("ix", view.x_bins), ("iy", view.y_bins))]
    return bins.select(*[named(k) for k in grid.by], *corner, "n", made.alias("value"))
