"""Tract boxes on the sky: tract metrics on a map, polygon rings, points in boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, named
from skyqa.functions.frames import BROADCAST_ROWS, broadcast_if_small, cut

BOX = ("x0", "x1", "y0", "y1")


def with_boxes(metrics: DataFrame, skymap: DataFrame, tract: str = "tract") -> DataFrame:
    """Tract metrics with the box of their tract; tracts without a box keep NULLs."""
    boxes = skymap.select(named(tract), *BOX)
    return metrics.join(broadcast_if_small(boxes), tract, "left")


def tract_map(
    metrics: DataFrame,
    skymap: DataFrame,
    filter_value: str,
    metric: str,
    active_tracts: Sequence[int] = (),
    filter_name: str = "filter",
    tract: str = "tract",
) -> DataFrame:
    """One filter and one metric on the map: ``tract, metric, x0, x1, y0, y1``.

    With no active tracts all of them are shown.
    """
    where = named(filter_name) == F.lit(filter_value)
    if active_tracts:
        where = where & named(tract).isin(list(active_tracts))
    rows = metrics.where(where).select(named(tract), named(metric).alias("metric"))
    return with_boxes(rows, skymap, tract)


def skymap_right_join(skymap: DataFrame, data: DataFrame, tract: str = "tract") -> DataFrame:
    """Boxes joined to tract data, keeping every data row."""
    return broadcast_if_small(skymap).join(data, tract, "right")


def box_ring() -> Column:
    """Closed ring of the box corners: five points, counter-clockwise from lower right."""
    x0, x1, y0, y1 = (F.col(c) for c in BOX)
    corners = [(x1, y0), (x1, y1), (x0, y1), (x0, y0), (x1, y0)]
    return F.when(
        x0.isNotNull() & x1.isNotNull() & y0.isNotNull() & y1.isNotNull(),
        F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]),
    )


def tract_polygons(mapped: DataFrame, tract: str = "tract", metric: str = "metric") -> DataFrame:
    """One polygon per row of a tract map: ``tract, metric, ring``."""
    return mapped.select(named(tract), named(metric), box_ring().alias("ring"))


def map_extent(mapped: DataFrame, padding: float = 0.0) -> DataFrame:
    """The limits of the shown boxes: one row ``xmin, xmax, ymin, ymax``."""
    return mapped.agg(
        (F.min("x0") - padding).alias("xmin"),
        (F.max("x1") + padding).alias("xmax"),
        (F.min("y0") - padding).alias("ymin"),
        (F.max("y1") + padding).alias("ymax"),
    )


def points_in_tracts(
    points: DataFrame, skymap: DataFrame, x: str = "ra", y: str = "dec", tract: str = "tract"
) -> DataFrame:
    """Every (point, tract) with ``x0 <= x < x1`` and ``y0 <= y < y1``.

    A box with ``x0 > x1`` lies across RA 0: it holds ``x0 <= x < 360`` and ``0 <= x < x1``.
    A tract with a missing limit has no box. A box without area raises :class:`ValueError`.

    This is an equi-join on grid cells. Each box lies on a grid as fine as its own sides,
    rounded up to powers of two, so that it touches at most four cells or so; a point looks
    up one cell for each pair of side lengths on the map, which are few. On a map too large to
    broadcast the grid is finer, so that most points of the cells that a box touches are in it.
    """
    pieces, n, levels = _checked(skymap, tract)
    small = n * _TOUCHED <= BROADCAST_ROWS
    laid = _laid(pieces, 0 if small else _HALVINGS)
    placed = points.select("*", _on_grids(levels, 0 if small else _HALVINGS))
    placed = placed.withColumns({"__cx": _cell(named(x), F.col("__lx")), "__cy": _cell(named(y), F.col("__ly"))})
    inside = (
        (named(x) >= F.col("__x0")) & (named(x) < F.col("__x1"))
        & (named(y) >= F.col("__y0")) & (named(y) < F.col("__y1"))
    )
    # Spark would broadcast by the size of the map as stored, before boxes are laid on cells
    found = placed.join(F.broadcast(laid) if small else laid.hint("merge"), _CELL).where(inside)
    return found.drop(*_CELL, "__x0", "__x1", "__y0", "__y1")


# cells that a box touches on its own grid, and the exponent of the finest grid (about an arcsecond)
_TOUCHED = 4
_FINEST = -12
# halvings of the cells on large maps, of a round that looks for taken boxes, and how many such rounds there are
_HALVINGS = 3
_STEP = 2
_ROUNDS = 3
_CELL = ["__lx", "__ly", "__cx", "__cy"]


def _checked(skymap: DataFrame, tract: str) -> tuple[DataFrame, int, list]:
    """The pieces of the boxes, how many there are and the pairs of their sides; no box is without area."""
    pieces = _pieces(skymap, tract)
    on_map = pieces.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or("__bad"), F.lit(False)).alias("bad"),
        F.collect_set(F.when(~F.col("__bad"), F.struct("__lx", "__ly"))).alias("levels"),
    ).first()
    if on_map["bad"]:
        raise ValueError("a tract box has no area, or crosses RA 0 outside [0, 360]")
    return pieces.drop("__bad"), on_map["n"], on_map["levels"]


def _on_grids(levels: Sequence, halvings: int) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(a - halvings).alias("__lx"), F.lit(b - halvings).alias("__ly")) for a, b in levels or [(0, 0)]]))


def _laid(pieces: DataFrame, halvings: int) -> DataFrame:
    """Pieces on the cells that they touch, whose sides are halved so often."""

    def cells(lo: str, hi: str, level: str) -> Column:
        return F.explode(F.sequence(_cell(F.col(lo), F.col(level)), _cell(F.col(hi), F.col(level))))

    laid = pieces.withColumns({"__lx": F.col("__lx") - halvings, "__ly": F.col("__ly") - halvings})
    return laid.withColumn("__cx", cells("__x0", "__x1", "__lx")).withColumn("__cy", cells("__y0", "__y1", "__ly"))


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level))


def _pieces(skymap: DataFrame, tract: str) -> DataFrame:
    """Boxes as ``tract, __x0, __x1, __y0, __y1`` in two pieces across RA 0, with the exponents of their sides."""
    x0, x1, y0, y1 = (F.col(f"__{c}") for c in BOX)
    boxes = skymap.select(
        named(tract), *[finite_or_null(F.col(c).cast("double")).alias(f"__{c}") for c in BOX]
    ).where(x0.isNotNull() & x1.isNotNull() & y0.isNotNull() & y1.isNotNull())
    bad = (x0 == x1) | (y0 >= y1) | ((x0 > x1) & ((x0 >= 360) | (x1 < 0)))

    # both pieces lie on the grid of the whole box
    width = F.when(x0 > x1, x1 - x0 + 360.0).otherwise(x1 - x0)

    def piece(lo: Column, hi: Column) -> Column:
        return F.struct(lo.alias("__x0"), hi.alias("__x1"))

    spans = F.when(x0 > x1, F.array(piece(x0, F.lit(360.0)), piece(F.lit(0.0), x1))).otherwise(F.array(piece(x0, x1)))
    pieces = boxes.select(named(tract), "__y0", "__y1", bad.alias("__bad"), width.alias("__width"), F.inline(spans))

    def level(side: Column) -> Column:
        return F.greatest(F.ceil(F.log2(side)), F.lit(_FINEST)).cast("int")

    return pieces.where(F.col("__bad") | (x0 < x1)).withColumns({"__lx": level(F.col("__width")), "__ly": level(y1 - y0)}).drop("__width")


def tracts_at(
    taps: DataFrame, skymap: DataFrame, x: str = "x", y: str = "y", tract: str = "tract"
) -> DataFrame:
    """Distinct tracts hit by any of the tapped points.

    Points are not paired with boxes. Each cell of a grid finer than the boxes has the extent of its points, which lies in a box, beside it, or across its
    border. Only cells of the last kind are halved further, for tracts that no cell lies in. What is left after some rounds is compared point by point.
    """
    pieces, _, levels = _checked(skymap, tract)
    at = taps.select(finite_or_null(named(x).cast("double")).alias("__px"), finite_or_null(named(y).cast("double")).alias("__py"))
    at = at.where("__px is not null and __py is not null")
    x0, x1, y0, y1 = (F.col(f"__{c}") for c in BOX)
    open_cells, found = _laid(pieces, _STEP), None
    for k in range(1, _ROUNDS + 2):
        placed = at.select("*", _on_grids(levels, min(k, _ROUNDS) * _STEP))
        placed = placed.withColumns({"__cx": _cell(F.col("__px"), F.col("__lx")), "__cy": _cell(F.col("__py"), F.col("__ly"))})
        if k > 1:  # points elsewhere need no cells
            placed = placed.join(broadcast_if_small(open_cells.select(_CELL).distinct()), _CELL, "left_semi")
        if k > _ROUNDS:
            inside = (F.col("__px") >= x0) & (F.col("__px") < x1) & (F.col("__py") >= y0) & (F.col("__py") < y1)
            return found.unionByName(placed.join(open_cells, _CELL).where(inside).select(named(tract))).distinct()
        extents = placed.groupBy(*_CELL).agg(
            F.min("__px").alias("__left"), F.max("__px").alias("__right"), F.min("__py").alias("__low"), F.max("__py").alias("__high")
        )
        left, right, low, high = (F.col(c) for c in ("__left", "__right", "__low", "__high"))
        apart = (right < x0) | (left >= x1) | (high < y0) | (low >= y1)
        within = (left >= x0) & (right < x1) & (low >= y0) & (high < y1)
        met = open_cells.join(extents, _CELL).where(~apart).withColumn("__within", within).drop("__left", "__right", "__low", "__high")
        # cells of a tract that has one inside are of no further use
        kept = met.withColumn("__taken", F.bool_or("__within").over(W.partitionBy(named(tract))))
        kept = cut(kept.where(~F.col("__taken")).drop("__within", "__taken").withColumn("__hit", F.lit(False)).unionByName(
            met.where("__within").select(named(tract)).distinct().withColumn("__hit", F.lit(True)), allowMissingColumns=True
        ))
        hit = kept.where("__hit").select(named(tract))
        found = hit if found is None else found.unionByName(hit)
        open_cells = kept.where(~F.col("__hit")).drop("__hit")
        if open_cells.isEmpty():
            return found.distinct()
        if k < _ROUNDS:
            wanted = open_cells.select("__lx", "__ly").distinct().collect()
            levels = [(r[0] + k * _STEP, r[1] + k * _STEP) for r in wanted]
            parts = F.sequence(F.lit(0), F.lit((1 << _STEP) - 1))
            for c in ("__cx", "__cy"):
                open_cells = open_cells.withColumn("__sub", F.explode(parts)).withColumn(c, F.col(c) * (1 << _STEP) + F.col("__sub")).drop("__sub")
            open_cells = open_cells.withColumns({c: F.col(c) - _STEP for c in ("__lx", "__ly")})


def polygons_of(selected: DataFrame, polygons: DataFrame, tract: str = "tract") -> DataFrame:
    """The polygons of the selected tracts."""
    return polygons.join(selected.select(named(tract)).distinct(), tract, "left_semi")
