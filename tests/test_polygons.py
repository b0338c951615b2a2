"""Points in polygons against a plain ray crossing over all edges."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from skyqa.operators.polygons import points_in_polygons, polygon_cells, polygon_edges
from skyqa.operators.tracts import box_ring, points_in_tracts
from skyqa.sources.readers import read_geojson

SHAPE = "id int, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def unwrap(points):
    out = [points[0]]
    for x, y in points[1:]:
        out.append((x - 360 * math.floor((x - out[-1][0] + 180) / 360), y))
    return out


def inside(rings, x, y):
    n = 0
    for r in rings:
        r = unwrap(r)
        for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1], strict=True):
            for turn in (-360, 0, 360):
                if (y0 <= y) != (y1 <= y) and x < x0 + turn + (y - y0) * (x1 - x0) / (y1 - y0):
                    n += turn == 0 or min(p[0] for p in r) + turn < 360 and max(p[0] for p in r) + turn > 0
    return n % 2 == 1


STAR = [(10 + (5 if k % 2 else 2) * math.cos(k * math.pi / 7), 3 + (5 if k % 2 else 2) * math.sin(k * math.pi / 7)) for k in range(14)]
OUTLINE = [(0, 0), (20, 0), (20, 12), (14, 4), (8, 12), (3, 5)]
POLYGONS = {
    1: [OUTLINE, [(8, 2), (9, 5), (6, 3)], [(15, 1), (16, 1), (16, 2), (15, 2)]],
    2: [STAR],
    3: [[(350, -5), (4, -5), (8, 3), (355, 6), (352, 1)], [(358, -2), (2, -2), (0.5, 2)]],  # across 0, with a hole across 0
    4: [[(100, 0), (100, 0), (130, 0.0), (130, 1e-5), (100, 1e-5)]],  # a sliver, and a repeated point
    5: [[(40, -10), (60, -10), (60, 10), (40, 10), (40, -10)]],  # closed
    6: [[(60, 10), (60, -10), (80, -10), (80, 10)]],  # the other way round, beside it
    7: [[(200.001, 1.001), (200.002, 1.001), (200.0015, 1.003)]],
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(i, ring(r[0]), [ring(h) for h in r[1:]] or None) for i, r in POLYGONS.items()]
    rows += [(20, None, None), (21, ring([(1, 1), (2, 2)]), []), (22, ring([(1, 1), (math.nan, 2), (3, 3)]), []), rows[0]]
    return spark.createDataFrame(rows, SHAPE)


@pytest.mark.parametrize("cells", [16, 1, 200])
def test_against_all_edges(spark, shapes, cells):
    draw = random.Random(3)
    points = [(draw.uniform(0, 25), draw.uniform(-6, 14)) for _ in range(2000)]
    points += [(draw.choice([draw.uniform(345, 360), draw.uniform(0, 10)]), draw.uniform(-7, 8)) for _ in range(1500)]
    points += [(draw.uniform(38, 82), draw.uniform(-11, 11)) for _ in range(500)] + [(draw.uniform(99, 131), draw.uniform(-1e-5, 2e-5)) for _ in range(300)]
    points += [(200 + draw.uniform(0, 0.003), 1 + draw.uniform(0, 0.004)) for _ in range(300)]
    points += [(float(x), float(y)) for r in POLYGONS.values() for part in r for x, y in part]  # corners
    points += [(60.0, 0.0), (40.0, 0.0), (80.0, 0.0), (50.0, 10.0), (50.0, -10.0), (0.0, 0.0), (359.999999, 0.0)]
    rows = [(k, x, y) for k, (x, y) in enumerate(points)] + [(-1, None, 1.0), (-2, math.nan, 1.0), (-3, 5.0, math.inf)]
    df = spark.createDataFrame(rows, "point int, ra double, dec double")
    got = [(r.point, r.id) for r in points_in_polygons(df, shapes, cells=cells).collect()]
    want = {(k, i) for k, (x, y) in enumerate(points) for i, r in POLYGONS.items() if inside(r, x, y)}
    assert len(got) == len(set(got)) and set(got) == want
    assert {i for _, i in want} == set(POLYGONS)
    on_border = len(points) - 7
    assert (on_border, 6) in want and (on_border, 5) not in want  # a shared border belongs to the polygon on its right


def test_boxes_are_those_of_the_box_join(spark):
    boxes = spark.range(40).select(
        F.col("id").cast("int").alias("tract"), (F.col("id") * 9 % 351).cast("double").alias("x0"), (F.col("id") * 9 % 351 + 9.0).alias("x1"),
        (F.col("id") % 5 * 4.0).alias("y0"), (F.col("id") % 5 * 4.0 + 4).alias("y1"),
    )
    points = spark.range(20_000).select("id", (F.col("id") * 7919 % 36000 / 100).alias("ra"), (F.col("id") * 104729 % 2000 / 100).alias("dec"))
    a = points_in_tracts(points, boxes).select("id", "tract")
    b = points_in_polygons(points, boxes.select("tract", box_ring().alias("ring")), holes=None).select("id", "tract")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() > 1000


def test_most_points_need_no_edges(spark, shapes):
    edges = polygon_edges(shapes.where("id = 5").limit(1), ["id"])
    cells = polygon_cells(edges, ["id"]).collect()
    whole = [c for c in cells if c.edges is None]
    assert len(whole) > len(cells) / 2 and max(len(c.edges) for c in cells if c.edges) <= 3


def test_nothing_and_clashes(spark, shapes):
    points = spark.createDataFrame([(1, 2.0, 3.0)], "point int, ra double, dec double")
    assert points_in_polygons(points, shapes.limit(0)).count() == 0
    assert points_in_polygons(points.limit(0), shapes).count() == 0
    with pytest.raises(ValueError, match="both have"):
        points_in_polygons(points.withColumnRenamed("point", "id"), shapes)
    flat = points_in_polygons(points, shapes.where("id = 3"), wrap=False)  # without turns, 350..4 is a wide ring
    assert flat.count() == inside_flat(POLYGONS[3], 2.0, 3.0)


def inside_flat(rings, x, y):
    return sum((y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) for r in rings for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1], strict=True)) % 2


def test_geojson_with_holes(spark, tmp_path):
    rings = [[list(p) for p in r] + [list(r[0])] for r in POLYGONS[1]]
    features = [{"type": "Feature", "properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": rings}}]
    features.append({"type": "Feature", "properties": {"n": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [rings[:1], rings]}})
    features.append({"type": "Feature", "properties": {"n": "c"}, "geometry": None})
    path = tmp_path / "shapes.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = read_geojson(spark, str(path), {"n": "string"}, holes=True)
    assert [(r.n, r.part, r.holes and len(r.holes)) for r in got.where("ring is not null").orderBy("feature", "part").collect()] == [("a", 0, 2), ("b", 0, []), ("b", 1, 2)]
    points = spark.createDataFrame([(1, 7.8, 3.4), (2, 4.0, 1.0)], "point int, ra double, dec double")
    found = {(r.point, r.n, r.part) for r in points_in_polygons(points, got.drop("feature")).collect()}
    assert found == {(1, "b", 0), (2, "a", 0), (2, "b", 0), (2, "b", 1)}


def test_sums_by_cell_equal_those_of_the_pairs(spark, shapes):
    draw = random.Random(5)
    circle = [(150 + 7 * math.cos(t / 60 * math.tau), 3 + 5 * math.sin(t / 60 * math.tau)) for t in range(60)]  # cells with many edges
    many = shapes.unionByName(spark.createDataFrame([(30, ring(circle), None), (31, ring([(-9, -60), (300, -60), (300, 60), (-9, 60)]), None)], SHAPE))
    places = [(draw.uniform(0, 360), draw.uniform(-65, 65)) for _ in range(3000)] + [(draw.uniform(0, 25), draw.uniform(-6, 14)) for _ in range(3000)]
    places += [(draw.uniform(142, 158), draw.uniform(-3, 9)) for _ in range(1500)] + [(200 + draw.uniform(0, 0.003), 1 + draw.uniform(0, 0.004)) for _ in range(300)]
    rows = [(draw.choice(["A", "B", None]), draw.choice([1.0, 2.5, None]), x, y) for x, y in places] + [("A", 1.0, None, 2.0), ("B", 1.0, math.nan, 2.0)]
    points = spark.createDataFrame(rows, "band string, flux double, ra double, dec double")
    pairs = points_in_polygons(points, many).groupBy("id", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("flux").alias("flux"))
    key = lambda r: (r.id, r.band or "")
    for cells in (16, 2):  # without a finer aim too
        sums = points_in_polygons(points, many, cells=cells, by=["band"], sums=["flux"]).select("id", "band", "n", "flux")
        assert sorted(sums.collect(), key=key) == sorted(pairs.collect(), key=key)
    assert pairs.count() > 20 and points_in_polygons(points.limit(0), many, by=["band"]).isEmpty()
    assert points_in_polygons(points, many.limit(0), by=["band"], sums=["flux"]).isEmpty()
