import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyqa.operators.filters import FilterState
from skyqa.operators.raster import (
    Axis,
    adaptive_points,
    raster_layers,
    scatter_density,
    scatter_density_multi,
    sky_raster,
    sky_raster_multi,
)
from skyqa.operators import tracts
from skyqa.operators.tracts import (
    map_extent,
    points_in_tracts,
    polygons_of,
    skymap_right_join,
    tract_map,
    tract_polygons,
    tracts_at,
)
from skyqa.operators.visits import (
    visit_box_whisker,
    visit_minmax_median,
    visit_normalized,
    visit_series,
    visit_series_long,
)


@pytest.fixture(scope="module")
def sky(spark):
    rng = np.random.default_rng(2)
    n = 4000
    pdf = pd.DataFrame(
        {
            # a third of the points in one bin
            "ra": np.where(rng.random(n) < 0.33, 5.0, rng.uniform(0, 10, n)),
            "dec": rng.uniform(-5, 5, n),
            "m": rng.normal(size=n),
            "used": rng.random(n) < 0.6,
        }
    )
    return spark.createDataFrame(pdf).cache(), pdf


RA, DEC = Axis("ra", 10), Axis("dec", 8)


def test_raster_matches_numpy(sky):
    df, pdf = sky
    got = sky_raster(df, "m", "mean", RA, DEC).collect()
    ranges = [[pdf.ra.min(), pdf.ra.max()], [pdf.dec.min(), pdf.dec.max()]]
    n, _, _ = np.histogram2d(pdf.ra, pdf.dec, bins=(10, 8), range=ranges)
    total, _, _ = np.histogram2d(pdf.ra, pdf.dec, bins=(10, 8), range=ranges, weights=pdf.m)
    assert sum(r.n for r in got) == len(pdf)
    for r in got:
        assert r.n == n[r.ix, r.iy] and r.value == pytest.approx(total[r.ix, r.iy] / r.n)


def test_std_is_of_the_population(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 3.0)], "ra double, dec double, m double")
    got = sky_raster(df, "m", "std", RA, DEC).collect()
    # no extent: everything in bin 0
    assert [(r.ix, r.iy, r.value) for r in got] == [(0, 0, 1.0)]


def test_selection_keeps_the_grid_and_layers_nest(sky):
    df, pdf = sky
    state = FilterState({"ra": (2.0, 4.0)}, ("used",))
    layers = raster_layers(df, RA, DEC, state).collect()
    assert all(r.n_selected <= r.n_all for r in layers)
    chosen = pdf[(pdf.ra >= 2) & (pdf.ra < 4) & pdf.used]
    assert sum(r.n_selected for r in layers) == len(chosen)
    alone = {(r.ix, r.iy): r.n for r in sky_raster(df, None, "count", RA, DEC, state).collect()}
    assert alone == {(r.ix, r.iy): r.n_selected for r in layers if r.n_selected}


def test_viewport_is_closed_and_drops_outside(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(11)], "ra double, dec double")
    got = {r.ix: r.n for r in sky_raster(df, None, "count", Axis("ra", 4, 2.0, 6.0), DEC).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}


def test_density_layers_agree_with_single_rasters(sky):
    df, _ = sky
    state = FilterState(flags=("used",))
    m = Axis("m", 6)
    both = scatter_density(df, RA, m, RA, DEC, state)
    sky_layer = both.where("layer = 'sky'").drop("layer")
    assert sky_layer.exceptAll(sky_raster(df, "m", "mean", RA, DEC, state)).count() == 0
    multi = scatter_density_multi(df, RA, [m], RA, DEC, state).drop("metric")
    assert multi.select(both.columns).exceptAll(both).count() == 0 and multi.count() == both.count()
    one = sky_raster_multi(df, ["m"], RA, DEC, state).select("ix", "iy", F.round("value", 9))
    assert one.exceptAll(sky_layer.select("ix", "iy", F.round("value", 9))).count() == 0


def test_points_or_raster_as_asked(sky):
    df, pdf = sky
    assert adaptive_points(df, "m", x=RA, y=DEC, points=True).count() == len(pdf)
    bins = adaptive_points(df, "m", x=RA, y=DEC, points=False)
    assert bins.count() == 80 and bins.agg(F.sum("n")).first()[0] == len(pdf)
    assert bins.schema == adaptive_points(df, "m", x=RA, y=DEC, points=True).schema


BOXES = [(1, 0.0, 10.0, 0.0, 10.0), (2, 9.0, 20.0, 0.0, 10.0), (3, -30.0, 40.0, -20.0, 30.0)]


@pytest.fixture(scope="module")
def skymap(spark):
    return spark.createDataFrame(BOXES, "tract int, x0 double, x1 double, y0 double, y1 double")


def test_points_in_overlapping_boxes(spark, skymap):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-35, 45, (300, 2)))]
    pts += [(300, 0.0, 0.0), (301, 10.0, 5.0), (302, 9.0, 10.0)]
    want = sorted((i, t) for i, x, y in pts for t, x0, x1, y0, y1 in BOXES if x0 <= x < x1 and y0 <= y < y1)
    df = spark.createDataFrame(pts, "id int, ra double, dec double")
    got = points_in_tracts(df, skymap)
    assert sorted((r.id, r.tract) for r in got.collect()) == want
    nothing = points_in_tracts(df, skymap.limit(0))
    assert nothing.count() == 0 and nothing.columns == got.columns


def test_boxes_across_zero_and_of_mixed_sizes(spark):
    boxes = [(1, 359.0, 1.0, -1.0, 1.0), (2, 358.0, 0.0, 0.0, 5.0), (3, 0.0, 360.0, 0.0, 0.01)]
    # many tiny boxes beside large ones, and one that is not placed
    boxes += [(10 + i, 0.1 + i * 1e-4, 0.1 + i * 1e-4 + 1e-4, 0.0, 1e-4) for i in range(200)]
    boxes += [(900, None, 1.0, 0.0, 1.0)]
    skymap = spark.createDataFrame(boxes, "tract int, x0 double, x1 double, y0 double, y1 double")
    rng = np.random.default_rng(3)
    xs = np.r_[rng.uniform(0, 2, 200), rng.uniform(357, 360, 200), rng.uniform(0.1, 0.12, 200), 0.0, 1.0, 359.0, 359.999]
    ys = np.r_[rng.uniform(-2, 6, 400), rng.uniform(0, 2e-4, 200), 0.0, 0.0, -1.0, 0.5]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))]

    def holds(x0, x1, x):
        return x0 <= x < x1 if x0 < x1 else x >= x0 or x < x1

    want = sorted(
        (i, t) for i, x, y in pts for t, x0, x1, y0, y1 in boxes if x0 is not None and holds(x0, x1, x) and y0 <= y < y1
    )
    got = points_in_tracts(spark.createDataFrame(pts, "id int, ra double, dec double"), skymap)
    assert sorted((r.id, r.tract) for r in got.collect()) == want
    for flat in ((1, 2.0, 2.0, 0.0, 1.0), (1, 1.0, 2.0, 1.0, 1.0), (1, 10.0, -10.0, 0.0, 1.0)):
        with pytest.raises(ValueError, match="area"):
            points_in_tracts(got.select("id", "ra", "dec"), spark.createDataFrame([flat], skymap.schema))


def test_layers_count_placed_rows_alike(spark):
    rows = [(1.0, 1.0, 5.0, 2.0), (1.0, 1.0, 5.0, None), (9.0, 9.0, None, None), (None, 1.0, 5.0, 3.0)]
    df = spark.createDataFrame(rows, "ra double, dec double, x double, m double")
    ra, dec, x, m = Axis("ra", 4), Axis("dec", 4), Axis("x", 4), Axis("m", 4)
    one = scatter_density(df, x, m, ra, dec)
    many = scatter_density_multi(df, x, [m], ra, dec).select(one.columns)
    assert one.exceptAll(many).count() == 0 == many.exceptAll(one).count()
    sky = {(r.ix, r.iy): (r.n, r.value) for r in one.where("layer = 'sky'").collect()}
    assert sky == {(0, 0): (2, 2.0), (3, 3): (1, None)}
    assert sky == {(r.ix, r.iy): (r.n, r.value) for r in sky_raster(df, "m", "mean", ra, dec).collect()}


def test_scatter_reads_only_the_viewport(sky, tmp_path):
    df, _ = sky
    path = str(tmp_path / "t")
    df.write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    ra, dec, m = Axis("ra", 4, 1.0, 2.0), Axis("dec", 4, 0.0, 1.0), Axis("m", 4, -1.0, 1.0)
    for got, want in (
        (scatter_density(stored, ra, m, ra, dec), scatter_density(df, ra, m, ra, dec)),
        (scatter_density_multi(stored, ra, [m], ra, dec), scatter_density_multi(df, ra, [m], ra, dec)),
    ):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ra,1.0)" in plan.replace(" ", "")
        assert got.select("layer", "ix", "iy", "n").exceptAll(want.select("layer", "ix", "iy", "n")).count() == 0


def test_map_polygons_and_taps(spark, skymap):
    metrics = spark.createDataFrame([("r", 1, 5.0), ("r", 2, 6.0), ("g", 1, 7.0), ("r", 9, 8.0)], "filter string, tract int, m double")
    shown = tract_map(metrics, skymap, "r", "m")
    assert sorted(r.tract for r in shown.collect()) == [1, 2, 9]
    assert [r.tract for r in tract_map(metrics, skymap, "r", "m", [2]).collect()] == [2]
    rings = {r.tract: r.ring for r in tract_polygons(shown).collect()}
    assert rings[9] is None
    assert [(p.x, p.y) for p in rings[1]] == [(10, 0), (10, 10), (0, 10), (0, 0), (10, 0)]
    assert tuple(map_extent(shown, 1.0).collect()[0]) == (-1.0, 21.0, -1.0, 11.0)
    taps = spark.createDataFrame([(9.5, 5.0), (9.6, 5.0)], "x double, y double")
    hit = tracts_at(taps, skymap)
    assert sorted(r.tract for r in hit.collect()) == [1, 2, 3]
    assert sorted(r.tract for r in polygons_of(hit, tract_polygons(shown)).collect()) == [1, 2]
    assert skymap_right_join(skymap, metrics).count() == 4


def test_series_take_the_median_over_tracts(spark):
    rows = [("r", t, v, s, float(t * v), 1.0) for t in (1, 2, 6) for v in (2, 10) for s in ("mean", "std")]
    stats = spark.createDataFrame(rows, "filter string, tract int, visit int, statistic string, m double, n double")
    assert [tuple(r) for r in visit_series(stats, "r", ["m"]).collect()] == [(2, 4.0), (10, 20.0)]
    long, missing = visit_series_long(stats, "r", ["m", "gone"], "mean")
    assert missing == ["gone"]
    # numeric order, text label
    assert [tuple(r) for r in long.collect()] == [("2", "m_mean", 4.0), ("10", "m_mean", 20.0)]


def test_normalisers(spark):
    rows = [(1, 0.0, 7.0), (1, 10.0, 7.0), (2, 20.0, 7.0), (2, None, 7.0)]
    df = spark.createDataFrame(rows, "visit int, m double, c double")
    got = {(r.visit, r.metric): (r.n, r["mean"]) for r in visit_normalized(df, ["m", "c"], "minmax").collect()}
    assert got == {(1, "m"): (2, 0.25), (2, "m"): (1, 1.0), (1, "c"): (2, 0.0), (2, "c"): (2, 0.0)}
    robust = {(r.visit, r.metric): r["mean"] for r in visit_normalized(df, ["m", "c"], "robust").collect()}
    assert robust == {(1, "m"): -0.5, (2, "m"): 1.0, (1, "c"): 0.0, (2, "c"): 0.0}
    raw = {(r.visit, r.metric): r["mean"] for r in visit_normalized(df, ["m"], None).collect()}
    assert raw == {(1, "m"): 5.0, (2, "m"): 20.0}
    assert {r.visit: r.median for r in visit_minmax_median(df, ["m"]).collect()} == {1: 0.25, 2: 1.0}
    with pytest.raises(ValueError, match="normalizer"):
        visit_normalized(df, ["m"], "other")


@pytest.mark.parametrize("limit", [10**6, 5])
def test_box_whisker(spark, limit):
    values = [*map(float, range(1, 10)), 100.0]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, None)], "visit int, m double")
    got = visit_box_whisker(df, ["m"], max_group_rows=limit).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.q1, r.median, r.q3, r.lower, r.upper, r.n_outliers, r.n) == (3.25, 5.5, 7.75, 1.0, 9.0, 1, 10)
    for normalizer, centre, scale in (("minmax", 1.0, 99.0), ("robust", 5.5, 4.5)):
        (s,) = visit_box_whisker(df, ["m"], max_group_rows=limit, normalizer=normalizer).collect()
        want = [(v - centre) / scale for v in (r.q1, r.median, r.q3, r.lower, r.upper)]
        assert [s.q1, s.median, s.q3, s.lower, s.upper] == pytest.approx(want)
        assert (s.n_outliers, s.n) == (1, 10)


def test_keys_are_normalised_by_themselves(spark):
    rows = [("a", 1, 0.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 10.0), ("b", 2, 30.0), (None, 1, 5.0)]
    df = spark.createDataFrame(rows, "k string, visit int, m double")
    want = {("a", 1): 0.25, ("a", 2): 1.0, ("b", 1): 0.0, ("b", 2): 1.0, (None, 1): 0.0}
    mean = visit_normalized(df, ["m"], "minmax", keys=["k"]).collect()
    assert {(r.k, r.visit): r["mean"] for r in mean} == want
    assert {(r.k, r.visit): r.median for r in visit_minmax_median(df, ["m"], keys=["k"]).collect()} == want
    boxes = visit_box_whisker(df, ["m"], normalizer="minmax", by=["k"]).collect()
    assert {(r.k, r.visit): r.median for r in boxes} == want
    robust = visit_normalized(df, ["m"], "robust", keys=["k"]).collect()
    got = {(r.k, r.visit): r["mean"] for r in robust}
    assert got == {("a", 1): -0.5, ("a", 2): 1.0, ("b", 1): -1.0, ("b", 2): 1.0, (None, 1): 0.0}


@pytest.mark.parametrize("rounds", [1, 3])
def test_large_maps_and_taps_without_pairs(spark, monkeypatch, rounds):
    rng = np.random.default_rng(8)
    boxes = [(i % 140 if i % 9 else None, float(x), float(x + w if x + w < 360 else x + w - 360), float(y), float(y + w / 3)) for i, (x, y, w) in enumerate(rng.uniform((0, -60, 0.5), (360, 60, 30), (150, 3)))]
    boxes += [(400, 359.5, 0.5, -1.0, 1.0), (401, 358.0, 0.0, 0.0, 5.0), (402, 10.0, 10.001, 0.0, 0.001), (403, 20.0, None, 0.0, 1.0), (404, 30.0, 31.0, 80.0, 81.0)]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.r_[rng.uniform((0, -70), (360, 70), (60, 2)), rng.uniform((49.9, 9.9), (50.1, 10.1), (400, 2))])]
    pts += [(500, 0.0, 0.0), (501, 359.9, 0.0), (502, 10.0005, 0.0005), (503, None, 1.0), (504, float("nan"), 1.0), (505, 31.0, 80.5), (506, 30.0, 81.0)]
    skymap = spark.createDataFrame(boxes, "tract int, x0 double, x1 double, y0 double, y1 double")
    df = spark.createDataFrame(pts, "id int, x double, y double")

    def holds(x0, x1, x):
        return x0 <= x < x1 if x0 < x1 else x >= x0 or x < x1

    placed = [p for p in pts if p[1] is not None and p[1] == p[1]]
    want = [(i, t) for i, x, y in placed for t, x0, x1, y0, y1 in boxes if x1 is not None and holds(x0, x1, x) and y0 <= y < y1]
    key = lambda r: (r[0], -1 if r[1] is None else r[1])
    monkeypatch.setattr(tracts, "BROADCAST_ROWS", 0)
    assert sorted(((r.id, r.tract) for r in points_in_tracts(df, skymap, "x", "y").collect()), key=key) == sorted(want, key=key)
    monkeypatch.setattr(tracts, "points_in_tracts", None)
    monkeypatch.setattr(tracts, "_ROUNDS", rounds)
    got = [r.tract for r in tracts_at(df, skymap).collect()]
    assert len(got) == len(set(got)) and set(got) == {t for _, t in want} and None in got and 404 not in got
    assert tracts_at(df.limit(0), skymap).isEmpty() and tracts_at(df, skymap.limit(0)).isEmpty()


def test_polygons_of_a_large_map_without_pairs(spark, monkeypatch):
    skymap = spark.range(400).selectExpr("cast(id as int) tract", "id % 20 * 18.0 x0", "id % 20 * 18.0 + 9 x1", "id div 20 * 4.0 y0", "id div 20 * 4.0 + 3 y1")
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (10.0, 1.0), (19.0, 5.0), (359.0, 90.0)], "x double, y double")
    monkeypatch.setattr(tracts, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tracts, "points_in_tracts", None)
    got = polygons_of(tracts_at(df, skymap), skymap.select("tract", "x0"))
    assert sorted((r.tract, r.x0) for r in got.collect()) == [(0, 0.0), (21, 18.0)]
