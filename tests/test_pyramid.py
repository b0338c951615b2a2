"""Stored raster pyramids against rasters of the rows, and the files that a viewport opens."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyqa.functions.frames import scratch_path
from skyqa.operators.raster import Axis, sky_raster
from skyqa.sources.pyramid import Grid, View, open_pyramid, read_view, view_edges, view_of, write_pyramid

GRID = Grid("ra", "dec", (0.0, 64.0), (-8.0, 8.0), levels=6, tile_levels=2, by=("band",))


def files_read(df):
    """Files that the scans of an executed frame have opened."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(1)
    n = 5000
    rows = [
        ("a" if rng.random() < 0.8 else None, float(x), float(y), float(v))
        for x, y, v in zip(rng.uniform(-1, 65, n), rng.uniform(-8.5, 8.5, n), 1e9 + rng.normal(size=n), strict=True)
    ]
    rows += [("a", 64.0, 8.0, 1e9), ("a", 0.0, -8.0, math.nan), ("a", 32.0, 0.0, None), ("a", None, 0.0, 1.0), ("a", math.nan, 1.0, 1.0), ("b", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "band string, ra double, dec double, v double")
    path = scratch_path(spark, "pyramid")
    write_pyramid(df, path, GRID, ["v"])
    return df, path


@pytest.mark.parametrize("aggregator", ["mean", "std", "count"])
@pytest.mark.parametrize(("x", "y", "most"), [((0, 64), (-8, 8), 64), ((0, 64), (-8, 8), 9), ((16, 32), (-4, 4), 32), ((17.3, 40.9), (-1.1, 0.2), 30), ((-50, 90), (math.nan, 8), 1)])
def test_views_are_the_rasters_of_the_rows(spark, field, aggregator, x, y, most):
    df, path = field
    grid = open_pyramid(spark, path)
    assert grid == GRID
    view = view_of(grid, x, y, most)
    (x0, x1), (y0, y1) = view_edges(grid, view)
    assert x0 <= max(x[0], 0) and x1 >= min(x[1], 64) and max(np.diff([view.x_bins, view.y_bins])) <= most
    n = 1 << view.level
    got = {(r.band, r.ix + view.x_bins[0], r.iy + view.y_bins[0]): (r.n, r.value) for r in read_view(spark, path, grid, view, "v", aggregator).collect()}
    want = {}
    for band in ("a", None, "b"):
        rows = df.where(F.col("band").eqNullSafe(F.lit(band)))
        for r in sky_raster(rows, "v", aggregator, Axis("ra", n, 0.0, 64.0), Axis("dec", n, -8.0, 8.0)).collect():
            if view.x_bins[0] <= r.ix < view.x_bins[1] and view.y_bins[0] <= r.iy < view.y_bins[1]:
                want[band, r.ix, r.iy] = (r.n, r.value)
    assert got.keys() == want.keys()
    for k, (count, value) in want.items():
        assert got[k][0] == count
        assert got[k][1] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-6))


def test_a_view_opens_the_files_of_its_tiles(spark, field):
    _, path = field
    whole = read_view(spark, path, GRID, View(6, (0, 64), (0, 64)), "v")
    part = read_view(spark, path, GRID, View(6, (8, 16), (20, 24)), "v")  # two tiles
    for df in (whole, part):
        df.collect()
    folders = part.select(F.input_file_name().alias("f")).distinct().count()
    assert files_read(part) <= 6 and folders <= files_read(part) < files_read(whole) / 20


def test_levels_and_broken_pyramids(spark, field, tmp_path):
    df, path = field
    assert spark.read.parquet(f"{path}/tiles/level=0").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{path}/tiles/level=6").agg(F.sum("n")).first()[0]
    with pytest.raises(ValueError, match="complete"):
        open_pyramid(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError, match="finite"):
        Grid("ra", "dec", (0.0, math.inf), (0.0, 1.0))
    with pytest.raises(ValueError, match="needs a value"):
        read_view(spark, path, GRID, View(0, (0, 1), (0, 1)), None)
    with pytest.raises(ValueError, match="unknown"):
        read_view(spark, path, GRID, View(0, (0, 1), (0, 1)), "v", "mode")
    empty = f"{tmp_path}/empty"
    write_pyramid(df.where("dec > 1000"), empty, GRID, ["v"])
    assert read_view(spark, empty, open_pyramid(spark, empty), View(3, (0, 8), (0, 8)), "v").count() == 0
