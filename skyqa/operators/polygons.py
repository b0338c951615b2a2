"""Points in polygons with holes, by ray crossing after an equi-join on grid cells.

A polygon lies on a grid whose cells are about a sixteenth of its extent. In each row of cells, the cells that edges touch fall into stretches;
between two stretches all cells are inside or all are outside. Inside ones hold their points without a test, outside ones are dropped. Cells of a stretch
carry its own edges and whether the cells to its right are inside: a point there counts how many of these edges lie to its right.

Where only counts and sums of the points are wanted, inside cells take them from sums by cell, and each run of inside cells in a row is made of few
blocks of 2, 4, 8... cells. So only the points in cells on a border are compared with polygons one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, named
from skyqa.functions.frames import broadcast_if_small, cut, scratch_path

#: Cells along the longer extent of a polygon; sides are powers of two, so there are up to twice as many.
CELLS = 16
# exponent of the finest grid (about a hundredth of an arcsecond)
_FINEST = -18
#: Edges of a cell that are tested as plain columns; cells with more of them are joined apart.
SLOTS = 3
#: Points in a cell, on average, that sums by cell aim at: fewer mean more cells of polygons, more mean more points beside borders.
POINTS_PER_CELL = 128
# cells along the longer extent of a polygon for sums, at most
_MOST_CELLS = 4096


def rings_of(ring: str = "ring", holes: str | None = "holes") -> Column:
    """All rings of a polygon as one array; holes may be NULL."""
    outer = F.array(named(ring))
    return outer if holes is None else F.concat(outer, F.coalesce(named(holes), F.array_remove(outer, named(ring))))


def unwrapped(ring: Column) -> Column:
    """A ring whose neighbouring points are never more than 180 degrees apart: 359, 1 becomes 359, 361."""
    first = F.array(F.struct(F.get(ring, F.lit(0))["x"].alias("x"), F.get(ring, F.lit(0))["y"].alias("y")))

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)["x"]
        turns = F.floor((p["x"] - last + 180.0) / 360.0)
        return F.concat(done, F.array(F.struct((p["x"] - 360.0 * turns).alias("x"), p["y"].alias("y"))))

    return F.aggregate(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), first, step)


def polygon_edges(polygons: DataFrame, ids: Sequence[str], ring: str = "ring", holes: str | None = "holes", wrap: bool = True) -> DataFrame:
    """``ids..., x0, y0, x1, y1`` of every edge.

    Rings are closed if they are not. A ring with a point that is missing or not finite has no edges, nor does a NULL ring. With ``wrap`` x is a
    longitude: rings are unwrapped, and a ring that leaves [0, 360] lies there a second time, a turn further.
    """
    return _edges(polygons, ids, ring, holes, wrap).drop("turn")


def _edges(polygons: DataFrame, ids: Sequence[str], ring: str, holes: str | None, wrap: bool) -> DataFrame:
    """:func:`polygon_edges` with the number of turns that a ring was moved by."""
    every = F.explode(F.filter(rings_of(ring, holes), lambda r: F.size(r) > 2)).alias("r")
    rows = polygons.where(named(ring).isNotNull()).select(*[named(i) for i in ids], every)
    good = F.forall("r", lambda p: finite_or_null(p["x"].cast("double")).isNotNull() & finite_or_null(p["y"].cast("double")).isNotNull())
    points = F.transform("r", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    rows = rows.where(good).select(*[named(i) for i in ids], points.alias("r"))
    if not wrap:
        rows = rows.withColumn("turn", F.lit(0).cast("long"))
    else:
        rows = rows.withColumn("r", unwrapped(F.col("r")))
        lo, hi = (f(F.transform("r", lambda p: p["x"])) for f in (F.array_min, F.array_max))
        turns = F.sequence(-F.floor(hi / 360.0), -F.floor(lo / 360.0))
        rows = rows.withColumn("turn", F.explode(turns)).withColumn(
            "r", F.transform("r", lambda p: F.struct((p["x"] + 360.0 * F.col("turn")).alias("x"), p["y"].alias("y")))
        )
    last = F.size("r") - 1
    after = F.concat(F.slice("r", 2, last), F.slice("r", 1, 1))
    edge = F.inline(F.zip_with("r", after, lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))))
    return rows.select(*[named(i) for i in ids], "turn", edge).where("x0 <> x1 or y0 <> y1")


def crosses(x: Column, y: Column, e: Column) -> Column:
    """Whether the ray from (x, y) to larger x meets an edge. Each edge has its lower end and not its upper one, a level edge neither."""
    spans = (e["y0"] <= y) != (e["y1"] <= y)
    height = e["y1"] - e["y0"]
    return spans & (x < e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / F.when(height == 0, F.lit(1.0)).otherwise(height))


def odd_crossings(x: Column, y: Column, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: crosses(x, y, e))) % 2 == 1


def _levels(edges: DataFrame, ids: Sequence[str], cells: int, aim: int | None = None) -> DataFrame:
    """``ids..., level, bx0, bx1, by0, by1``: ``2**level`` is the side of the cells of that polygon, a finer one if ``aim`` is finer."""
    names = [named(i) for i in ids]
    turned = [c for c in ("turn",) if c in edges.columns]
    box = edges.groupBy(*names, *turned).agg(
        F.min(F.least("x0", "x1")).alias("bx0"), F.max(F.greatest("x0", "x1")).alias("bx1"),
        F.min(F.least("y0", "y1")).alias("by0"), F.max(F.greatest("y0", "y1")).alias("by1"),
    )
    longest = F.max(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")))
    level = F.ceil(F.log2(longest / cells))
    if aim is not None:
        level = F.greatest(F.least(level, F.lit(aim)), F.ceil(F.log2(longest / _MOST_CELLS)))
    return box.groupBy(*names).agg(
        F.greatest(level, F.lit(_FINEST)).cast("int").alias("level"), *[f(c).alias(c) for c, f in (("bx0", F.min), ("bx1", F.max), ("by0", F.min), ("by1", F.max))]
    )


def polygon_rows(edges: DataFrame, ids: Sequence[str], cells: int = CELLS, aim: int | None = None) -> DataFrame:
    """``ids..., level, cy, first, last, edges, odd, after``: the stretches of cells in a row that edges of a polygon touch.

    ``edges`` are the edges of the stretch that are not level, and ``odd`` tells whether the cells to its right are inside. The ``after`` cells to its left,
    up to the stretch before, are inside; 0 if they are not. Edges are dealt to the rows of cells that they span, so that no polygon is gathered whole.
    """
    names = [named(i) for i in ids]
    levels = cut(_levels(edges, ids, cells, aim))
    same = [edges[i].eqNullSafe(F.col(f"b_{k}")) for k, i in enumerate(ids)]
    held = edges.join(broadcast_if_small(levels.withColumnsRenamed({i: f"b_{k}" for k, i in enumerate(ids)})), same)
    side = F.pow(F.lit(2.0), F.col("level"))
    # cells that an edge only just misses count as touched
    slack = side * 1e-6 + 1e-14 * F.greatest(*[F.abs(c) for c in ("x0", "y0", "x1", "y1")])
    held = held.withColumns({"side": side, "slack": slack, "lowest": F.least("y0", "y1"), "highest": F.greatest("y0", "y1")})

    def cell(value: Column) -> Column:
        return _cell(value, F.col("level"))

    # no point outside the box of a polygon is inside
    low, high = F.greatest(cell(F.col("lowest") - F.col("slack")), cell(F.col("by0"))), F.least(cell(F.col("highest") + F.col("slack")), cell(F.col("by1")))
    rows = held.withColumn("cy", F.explode(F.sequence(low, high)))
    ends = (F.greatest(F.col("cy") * F.col("side") - F.col("slack"), "lowest"), F.least((F.col("cy") + 1) * F.col("side") + F.col("slack"), "highest"))
    slope = (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))
    a, b = (F.coalesce(F.col("x0") + (y - F.col("y0")) * slope, F.col(x)) for y, x in zip(ends, ("x0", "x1"), strict=True))
    middle = (F.col("cy") + 0.5) * F.col("side")
    rows = rows.select(
        *names, "level", "cy", "x0", "y0", "x1", "y1",
        F.greatest(cell(F.least(a, b) - F.col("slack")), cell(F.col("bx0"))).alias("first"),
        F.least(cell(F.greatest(a, b) + F.col("slack")), cell(F.col("bx1"))).alias("last"),
        ((F.col("y0") <= middle) != (F.col("y1") <= middle)).cast("int").alias("crossed"),
    )
    row = W.partitionBy(*names, "level", "cy")
    along = row.orderBy("first", "last")
    reached = F.max("last").over(along.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int"))
    rows = rows.withColumn("stretch", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    made = rows.groupBy(*names, "level", "cy", "stretch").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("crossed").alias("crossed"),
        F.collect_list(F.when(F.col("y0") != F.col("y1"), F.struct("x0", "y0", "x1", "y1"))).alias("edges"),
    )
    back = row.orderBy(F.desc("stretch"))
    beyond = F.coalesce(F.sum("crossed").over(back.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    gap = F.col("first") - F.lead("last").over(back) - 1
    return made.select(*names, "level", "cy", "first", "last", "edges", "crossed", beyond.alias("beyond"), gap.alias("gap")).select(
        *names, "level", "cy", "first", "last", "edges", (F.col("beyond") % 2 == 1).alias("odd"),
        F.when((F.col("beyond") + F.col("crossed")) % 2 == 1, F.coalesce("gap", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("after"),
    )


def polygon_cells(edges: DataFrame, ids: Sequence[str], cells: int = CELLS) -> DataFrame:
    """``ids..., level, cx, cy, edges, odd`` of the cells that hold points of a polygon; ``edges`` is NULL where all are inside.

    ``2**level`` is the side of a cell of that polygon. In the others a point is inside if the number of edges to its right, and one if ``odd``, is odd.
    """
    rows = polygon_rows(edges, ids, cells)
    return _border(rows, ids).unionByName(_inside(rows, ids))


def _border(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The cells of :func:`polygon_rows` on a border. Without edges but level ones all points of a cell are inside, or none."""
    some = F.size("edges") > 0
    each = rows.where(some | F.col("odd")).withColumn("cx", F.explode(F.sequence("first", "last")))
    return each.select(*[named(i) for i in ids], "level", "cx", "cy", F.when(some, F.col("edges")).alias("edges"), "odd")


def _inside(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    each = rows.where("after > 0").withColumn("cx", F.explode(F.sequence(F.col("first") - F.col("after"), F.col("first") - 1)))
    return each.select(*[named(i) for i in ids], "level", "cx", "cy", F.lit(None).cast(rows.schema["edges"].dataType).alias("edges"), F.lit(True).alias("odd"))


def _blocks(rows: DataFrame, ids: Sequence[str], doublings: int) -> DataFrame:
    """``ids..., level, cy, size, cx`` of blocks of ``2**size`` cells that make up the inside cells of a row, few for each run.

    No run is of ``2**(doublings + 1)`` cells or more.
    """
    run = rows.where("after > 0").select(*[named(i) for i in ids], "level", "cy", (F.col("first") - F.col("after")).alias("a"), F.col("first").alias("b"))
    blocks = []
    for k in range(doublings + 1):
        # whole blocks of this size lie from a to b; the first and the last one may be in no block of the next size
        a, b = F.shiftright(F.col("a") + ((1 << k) - 1), k), F.shiftright("b", k)
        for alone, at in ((a.bitwiseAND(F.lit(1)) == 1, a), (b.bitwiseAND(F.lit(1)) == 1, b - 1)):
            blocks.append(F.when((a < b) & alone, F.struct(F.lit(k).alias("size"), at.alias("cx"))))
    few = run.withColumn("x", F.explode(F.array(*blocks))).where(F.col("x").isNotNull())
    return few.select(*[named(i) for i in ids], "level", "cy", F.col("x.size").alias("size"), F.col("x.cx").alias("cx"))


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def _beside(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """Points that lie inside by the edges of their cell: ``placed`` with ``__polygon``."""
    on = ["__level", "__cx", "__cy"]
    there = cells.select("__polygon", F.col("level").alias("__level"), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("edges").alias("__edges"), F.col("odd").alias("__odd"))
    point = (F.col("__px"), F.col("__py"))
    # a slot without an edge is a level one, which no ray meets; no NULLs keep the compiled test short
    flat = {f"__{c}{k}": F.coalesce(F.get("__edges", F.lit(k))[c], F.lit(0.0)) for k in range(SLOTS) for c in ("x0", "y0", "x1", "y1")}
    few = there.where(F.coalesce(F.size("__edges"), F.lit(0)) <= SLOTS).withColumns(flat).drop("__edges")
    edge = [{c: F.col(f"__{c}{k}") for c in ("x0", "y0", "x1", "y1")} for k in range(SLOTS)]
    met = [F.coalesce(crosses(*point, e), F.lit(False)) for e in edge]
    # cells on the left: a merge goes through the points of a cell polygon by polygon, so that sums by polygon find their group at hand
    found = broadcast_if_small(few).join(placed, on).where(reduce(lambda a, b: a != b, met, F.col("__odd"))).drop(*flat, "__odd")
    many = there.where(F.size("__edges") > SLOTS)
    if many.isEmpty():
        return found.drop(*on)
    crowded = broadcast_if_small(many).join(placed, on).where(odd_crossings(*point, F.col("__edges")) != F.col("__odd"))
    return found.unionByName(crowded.drop("__edges", "__odd")).drop(*on)


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    x: str = "ra",
    y: str = "dec",
    ring: str = "ring",
    holes: str | None = "holes",
    wrap: bool = True,
    cells: int = CELLS,
    by: Sequence[str] | None = None,
    sums: Sequence[str] = (),
) -> DataFrame:
    """Every (point, polygon) where the point lies in the ring and in no hole, with the polygon's other columns.

    Rings are arrays of ``struct<x, y>``, open or closed, of either direction; a polygon is one row. A border point belongs to the polygon
    to its right (above, on a level edge), so that polygons that share a border share no point. With ``wrap`` x is a longitude in
    degrees, of points in [0, 360); a polygon may lie across 0, but not around a pole. Points without a position are in no polygon. Polygons that repeat all their
    columns are one polygon.

    With ``by`` the points of a polygon are added up instead, by these columns: ``by..., n, sums...`` and the polygon's other columns, one row for each
    polygon and combination that has points. Their number is ``n`` and each of ``sums`` the sum of that column.
    """
    ids = [c for c in polygons.columns if c not in (ring, holes)]
    if clash := set(ids) & set(points.columns):
        raise ValueError(f"points and polygons both have {sorted(clash)}")
    marked = polygons.select(*[named(i) for i in ids], named(ring), *([] if holes is None else [named(holes)])).dropDuplicates()
    own = cut(marked.withColumn("__polygon", F.monotonically_increasing_id()))
    edges = cut(_edges(own, ["__polygon"], ring, holes, wrap))
    px, py = (finite_or_null(named(c).cast("double")) for c in (x, y))
    named_polygons = broadcast_if_small(cut(own.select("__polygon", *[named(i) for i in ids])))
    if by is not None:
        found = _added_up(points, edges, px, py, by, sums, cells)
        return found.join(named_polygons, "__polygon").select(*[named(c) for c in by], "n", *[named(c) for c in sums], *[named(i) for i in ids])
    laid = cut(polygon_cells(edges, ["__polygon"], cells))
    found = _beside(_placed(points, px, py, laid), laid)
    return found.join(named_polygons, "__polygon").select(*[named(c) for c in points.columns], *[named(i) for i in ids])


def _placed(points: DataFrame, px: Column, py: Column, laid: DataFrame) -> DataFrame:
    """Points with their cell on the grid of each size of polygons: as many as there are sizes by powers of two."""
    levels = [r[0] for r in laid.select("level").distinct().collect()] or [0]
    placed = points.withColumns({"__px": px, "__py": py}).where("__px is not null and __py is not null")
    placed = placed.withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels])))
    return placed.withColumns({"__cx": _cell(F.col("__px"), F.col("__level")), "__cy": _cell(F.col("__py"), F.col("__level"))})


def _added_up(
    points: DataFrame, edges: DataFrame, px: Column, py: Column, by: Sequence[str], sums: Sequence[str], cells: int
) -> DataFrame:
    """``__polygon, by..., n, sums...``: points on a border one by one, the others by the sums of their cells."""
    group, adds = [named(c) for c in by], [F.sum(named(c)).alias(c) for c in sums]
    again = [F.sum("n").alias("n"), *adds]
    at = points.select(px.alias("px"), py.alias("py")).where("px is not null and py is not null")
    n, *limits = at.agg(F.count(F.lit(1)), F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    area = max(limits[1] - limits[0], 1e-9) * max(limits[3] - limits[2], 1e-9) if n else 1.0
    aim = max(round(math.log2(POINTS_PER_CELL * area / max(n, 1)) / 2), _FINEST)
    spark = points.sparkSession
    path = scratch_path(spark, "polygon-rows")
    polygon_rows(edges, ["__polygon"], cells, aim).write.parquet(path)
    rows = spark.read.parquet(path)
    needed = points.select(*[named(c) for c in dict.fromkeys([*by, *sums])], px.alias("__x"), py.alias("__y"))
    placed = _placed(needed, F.col("__x"), F.col("__y"), rows).drop("__x", "__y")
    tested = _beside(placed, _border(rows, ["__polygon"])).groupBy("__polygon", *group).agg(F.count(F.lit(1)).alias("n"), *adds)
    cell = ["__level", "__cy", "__cx"]
    by_cell = placed.groupBy(*cell, *group).agg(F.count(F.lit(1)).alias("n"), *adds)
    doublings = int(rows.agg(F.max("after")).first()[0] or 1).bit_length() - 1
    by_block = by_cell.withColumn("__size", F.explode(F.array(*[F.lit(k) for k in range(doublings + 1)])))
    by_block = by_block.withColumn("__cx", F.expr("shiftright(__cx, __size)")).groupBy("__level", "__cy", "__size", "__cx", *group).agg(*again)
    blocks = _blocks(rows, ["__polygon"], doublings).toDF("__polygon", "__level", "__cy", "__size", "__cx")
    whole = by_block.join(blocks, ["__level", "__cy", "__size", "__cx"]).groupBy("__polygon", *group).agg(*again)
    return tested.unionByName(whole).groupBy("__polygon", *group).agg(*again)
