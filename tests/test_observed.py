"""Counts and warnings that come with the rows."""

import pytest
from pyspark.sql import functions as F

from skyqa.functions.frames import scratch_path
from skyqa.functions.observed import Watch
from skyqa.operators.filters import coadd_slice, visit_slice, visit_stats_slice
from skyqa.operators.match import match_counts, sky_match
from skyqa.plans.explorer import Request, explore, open_catalogue
from test_jobs import METRIC, folder, raw  # noqa: F401


def jobs(spark):
    """Jobs that were started so far."""
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


@pytest.fixture
def rows(spark):
    return spark.range(100).select(
        F.when(F.col("id") < 60, "r").otherwise("i").alias("filter"), (F.col("id") % 4).cast("int").alias("tract"), (F.col("id") % 5).cast("int").alias("visit"),
        F.when(F.col("id") % 10 != 0, F.col("id") / 7).alias("m"), F.lit(True).alias("flag"),
    )


def test_slices(spark, rows):
    watch = Watch()
    before = jobs(spark)
    coadd, warnings = coadd_slice(rows, "r", ["m"], [1, 9], [0, 1, 2, 3], columns=["filter"], watch=watch)
    visit = visit_slice(rows, "i", ["m"], 2, columns=["visit"], tracts=[1, 2], watch=watch)
    none = visit_slice(rows, "z", ["m"], 77, columns=["visit"], watch=watch)
    assert jobs(spark) == before
    assert warnings == ["tract 9 is not in the data"]
    got = [df.collect() for df in (coadd, visit, none)]
    counted = [c["n"] for _, c in zip(got, (o.get for _, o, _ in watch._parts), strict=True)]
    assert counted == [len(g) for g in got] and counted[0] == 15 and counted[2] == 0
    assert all(r.visit == 2 for r in got[1]) and len(got[1]) == rows.where("filter = 'i' and visit = 2 and tract in (1, 2) and m is not null").count()
    assert watch.warnings() == ["no rows of filter z, visit 77"]


def test_visit_statistics(spark, rows):
    stats = rows.groupBy("filter", "tract", "visit").agg(F.avg("m").alias("m"))
    for tracts, text in (([1], []), ([77], ["no visit statistics for tracts [77]"]), ((), [])):
        watch = Watch()
        assert visit_stats_slice(stats, tracts, watch=watch).count() == watch.counts()["visit statistics"]["n"]
        assert watch.warnings() == text


def test_match_counts_need_no_job(spark):
    left = spark.range(200).select("id", (F.col("id") * 1.0).alias("ra"), F.lit(0.0).alias("dec"), (F.col("id") % 9 != 0).alias("detect_isPrimary"))
    right = left.where("id % 2 = 0")
    want = match_counts(sky_match(left, right, 1.0)).first()
    watch = Watch()
    sky_match(left, right, 1.0, watch=watch).write.parquet(scratch_path(spark, "match"))
    assert watch.counts() == {"match": want.asDict()} and watch.warnings() == []
    watch = Watch()
    sky_match(left, right.withColumn("dec", F.lit(50.0)), 1.0, watch=watch).collect()
    assert watch.counts()["match"]["n_matched"] == 0 and watch.warnings() == ["no row has a match"]


def test_explore_visits_by_tract(spark, folder):  # noqa: F811
    catalogue = open_catalogue(spark, folder)
    watch = Watch()
    tables, warnings = explore(catalogue, Request("HSC-I", (METRIC,), (9615, 1), visit=100), watch)
    assert warnings == ["tract 1 is not in the data"]
    got = tables["rows"].collect()
    want = raw(spark).where("filter = 'HSC-I' and tract = 9615 and visit = 100 and id % 50 != 7")
    assert tables["series"].collect() != []
    assert len(got) == want.count() == watch.counts()["objects"]["n"] > 0
    assert watch.warnings() == []
    # ranges are those of the rows' own visit
    ranges = {r.column: r for r in tables["ranges"].collect()}
    ra = raw(spark).where("filter = 'HSC-I' and tract = 9615 and visit = 100").select(F.degrees("coord_ra").alias("ra"))
    assert ranges["ra"].lo >= ra.agg(F.min("ra")).first()[0] - 1e-9 and ranges["ra"].hi <= ra.agg(F.max("ra")).first()[0] + 1e-9
    watch = Watch()
    tables, warnings = explore(catalogue, Request("HSC-I", (METRIC,), (1,), visit=12345), watch)
    assert warnings == ["tract 1 is not in the data", "no known tract selected, using all tracts"]
    assert tables["rows"].collect() == [] and tables["series"].collect() != []
    assert watch.warnings() == ["no objects are left by the selection"]
