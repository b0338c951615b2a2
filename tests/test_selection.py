import pytest

from skyqa.operators.filters import (
    FilterState,
    coadd_slice,
    query_filter,
    sky_points,
    state_filter,
    stats_slice,
    visit_slice,
    visits_long,
)
from skyqa.operators.ingest import decimate, project_columns, sample_fraction, sample_per_key
from skyqa.operators.schema import (
    COADD_FORCED,
    COADD_UNFORCED,
    VISIT,
    column_profile,
    flag_columns,
    key_and_value_columns,
    magnitude_names,
    metric_columns,
    role_of,
    split_available,
)

NAN = float("nan")
from skyqa.operators.visits import visit_series_long


@pytest.fixture(scope="module")
def points(spark):
    rows = [
        (0.0, 1.0, True, False, "r", 1),
        (5.0, 2.0, True, True, "r", 2),
        (10.0, 3.0, False, False, "g", 1),
        (None, 4.0, True, False, "g", 2),
        (9.5, NAN, True, False, "r", 2),
    ]
    return spark.createDataFrame(rows, "x double, y double, used boolean, bad boolean, filter string, tract int").cache()


def test_range_is_half_open(points):
    assert state_filter(points, FilterState({"x": (0.0, 10.0)})).count() == 3
    assert state_filter(points, FilterState({"x": (None, 10.0)})).count() == 3
    assert state_filter(points, FilterState({"x": (5.0, float("inf"))})).count() == 3
    assert state_filter(points, FilterState()).count() == 5


def test_bad_flags_win(points):
    both = FilterState(flags=("used", "bad"), bad_flags=("bad",))
    assert state_filter(points, both).count() == 3
    assert state_filter(points, FilterState(flags=("used", "bad"))).count() == 1
    assert state_filter(points, FilterState({"used": (5, 6)}, flags=("used",))).count() == 4


def test_box_replaces_and_keeps(points):
    state = FilterState({"x": (0.0, 1.0), "tract": (2, 3)}, ("used",)).with_box("x", "y", (4.0, 0.0, 6.0, 9.0))
    assert state.ranges == {"x": (4.0, 6.0), "tract": (2, 3), "y": (0.0, 9.0)} and state.flags == ("used",)
    assert state_filter(points, state).count() == 1
    assert state.reset() == FilterState()


def test_user_condition_cannot_escape_the_flags(points):
    got = query_filter(points, {"used": True}, "x > 100 or x = 10")
    assert got.count() == 0
    assert query_filter(points, {"used": False}, "x > 100 or x = 10").count() == 1
    assert query_filter(points, {}, "  ").count() == 5


def test_coadd_slice_warns_and_falls_back(points):
    rows, warnings = coadd_slice(points, "r", ["y"], [1, 99], columns=["filter"])
    assert [r.y for r in rows.collect()] == [1.0] and warnings == ["tract 99 is not in the data"]
    assert rows.columns == ["y", "used", "bad", "filter"]
    rows, warnings = coadd_slice(points, "r", ["y"], [98, 99], [1, 2], columns=["filter"])
    # the NaN row is incomplete
    assert sorted(r.y for r in rows.collect()) == [1.0, 2.0] and len(warnings) == 3


def test_visit_slice(points):
    kept = visit_slice(points, "r", ["y"], visit_name="tract", columns=["tract"])
    assert sorted(r.y for r in kept.collect()) == [1.0, 2.0]
    assert visit_slice(points, "r", ["y"], 2, visit_name="tract", columns=["tract"]).count() == 1
    assert visit_slice(points, "r", [], columns=["tract"]).count() == 3


def test_visits_long_reports_missing(points):
    long, missing = visits_long(points, ["filter"], ["x", "y", "z"])
    assert missing == ["z"] and long.count() == 4 + 4


def test_sky_points(points):
    got = sky_points(points, ["y"], 10.0, "r", "x", FilterState(bad_flags=("bad",)), label_name="filter", position=("x", "y"))
    assert got.columns == ["x", "y", "tract"] and got.count() == 1
    every = sky_points(points, ["y"], 10.0, "r", "x", label_name="filter", position=("x", "y"), complete=False)
    assert every.count() == 3


def test_stats_slice(points):
    assert stats_slice(points, "r", [2]).count() == 2
    assert stats_slice(points).count() == 5
    assert "filter" not in stats_slice(points, "r", drop_keys=True).columns


def test_roles(spark, points):
    assert flag_columns(points) == ["used", "bad"]
    assert metric_columns(points) == ["x", "y"]
    assert key_and_value_columns(points, ["x"]) == (["used", "bad", "filter", "tract"], ["x"])
    assert split_available(points, ["x", "q"]) == (["x"], ["q"])
    df = spark.createDataFrame([(1.0, "mas", 2)], "m double, m_unit string, visit int")
    assert role_of(df) == {"m": "metric", "m_unit": "unit", "visit": "key"}
    assert magnitude_names(["a_magDiff", "a_magDiff_mmag"]) == {"a_magDiff": "a_mag"}


def test_catalogue_kinds():
    assert len(COADD_FORCED.metric_columns()) == 15 and len(COADD_FORCED.flag_columns()) == 16
    assert len(COADD_UNFORCED.metric_columns()) == 12 and len(VISIT.metric_columns()) == 11
    assert {"ccdId", "filter", "tract", "visit"} <= set(VISIT.columns())
    assert COADD_FORCED.columns() == sorted(COADD_FORCED.columns())


def test_profile_counts_what_is_not_finite(points):
    got = {r.column: r for r in column_profile(points, ["x", "y", "used", "filter", "q"]).collect()}
    assert (got["x"].filled, got["x"].non_finite, got["x"].lo, got["x"].hi) == (4, 0, 0.0, 10.0)
    assert (got["y"].filled, got["y"].non_finite, got["y"].hi) == (4, 1, 4.0)
    assert got["used"].n_true == 4 and got["used"].role == "flag"
    assert got["filter"].lo is None and not got["q"].present


def test_projection_is_sorted(points):
    assert project_columns(points, ["y", "x"], ["used"], without=["x"]).columns == ["used", "y"]


def test_samples_repeat_in_any_layout(spark):
    df = spark.range(5000).withColumnRenamed("id", "i").selectExpr("i", "if(i < 4000, 0, i % 7) as k")
    other = df.repartition(13).sortWithinPartitions("k")
    for draw in (
        lambda d: sample_fraction(d, 0.1, 3, by="i"),
        lambda d: sample_per_key(d, ["k"], 20, "i", 3),
        lambda d: decimate(d, "i", 100, 3),
    ):
        a, b = ({r.i for r in draw(d).collect()} for d in (df, other))
        assert a == b and len(a) > 0
    assert sample_per_key(df, ["k"], 20, "i").groupBy("k").count().where("count > 20").isEmpty()
    assert decimate(df, "i", 100).count() == 100
    assert 350 < sample_fraction(df, 0.1, by="i").count() < 650


def test_no_wanted_metric_gives_an_empty_frame_and_the_list(spark):
    df = spark.createDataFrame([("r", 1, "mean", 2.0)], "filter string, visit int, statistic string, m double")
    long, missing = visits_long(df, ["filter", "visit"], ["a", "b"])
    assert long.columns == ["filter", "visit", "metric", "value"] and long.count() == 0 and missing == ["a", "b"]
    series, missing = visit_series_long(df, "r", ["a"])
    assert series.columns == ["visit", "series", "value"] and series.count() == 0 and missing == ["a"]
