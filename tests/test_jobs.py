"""The three end-to-end jobs on catalogues with the real column names."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from skyqa.functions.clean import named
from skyqa.functions.frames import scratch_path
from skyqa.operators.filters import FilterState
from skyqa.operators.schema import COADD_FORCED, COADD_UNFORCED, FLAGS, METRICS, VISIT
from skyqa.plans.compare import compare_catalogues
from skyqa.plans.explorer import Request, explore, open_catalogue
from skyqa.plans.repartition import main, manifest_chunks, repartition_catalogue
from skyqa.sources.readers import read_with_keys

N = 600
METRIC = "Kron-PSF_magDiff_mmag"


def raw(spark):
    i = F.col("id")
    columns = {
        "filter": F.when(i % 3 == 0, "HSC-R").otherwise("HSC-I"),
        "tract": (9615 + i % 2).cast("int"),
        "visit": (100 + i % 4).cast("int"),
        "ccdId": (i % 5).cast("int"),
        "patchId": F.concat(i % 3, F.lit(","), i % 2),
        "coord_ra": F.radians(150 + i / 1000),
        "coord_dec": F.radians(2 + (i * 37 % 600) / 1000),
    }
    columns |= {m: (i * (k + 1) % 101) + 1.0 for k, m in enumerate(METRICS)}
    columns |= {f: i % (k + 2) == 0 for k, f in enumerate(FLAGS)}
    columns[METRIC] = F.when(i % 50 == 7, F.lit(float("inf"))).otherwise(columns[METRIC])
    return spark.range(N).select(i, *[c.alias(n) for n, c in columns.items()])


@pytest.fixture(scope="module")
def folder(spark):
    root, table = scratch_path(spark, "catalogue"), raw(spark)
    manifest = []
    for kind in (COADD_FORCED, COADD_UNFORCED, VISIT):
        for f in ("HSC-R", "HSC-I"):
            for t in (9615, 9616):
                path = f"{root}/raw/{kind.name}/{f}-{t}"
                part = table.where((F.col("filter") == f) & (F.col("tract") == t))
                if kind is not VISIT:
                    part = part.drop("filter", "tract", "visit", "ccdId")
                    manifest.append((path, kind.name, f, t, None))
                    part.write.parquet(path)
                else:
                    for v in (100, 101, 102, 103):
                        rows = part.where(F.col("visit") == v)
                        if not rows.isEmpty():
                            rows.write.parquet(f"{path}-{v}")
                            manifest.append((f"{path}-{v}", kind.name, f, t, v))
    listing = spark.createDataFrame(manifest, "path string, dataset string, filter string, tract int, visit int")
    listing.write.parquet(f"{root}/manifest")
    main([f"{root}/manifest", f"{root}/out", "--num-buckets", "4", "--chunk-keys", "3"])
    return f"{root}/out"


def test_repartition_writes_catalogues_and_statistics(spark, folder):
    for kind in (COADD_FORCED, COADD_UNFORCED, VISIT):
        back = spark.read.parquet(f"{folder}/{kind.name}")
        assert back.count() == N
        assert {"ra", "dec", "psfMag", "patch", "bucket"} <= set(back.columns) and "patchId" not in back.columns
        assert not set(kind.absent_metrics) & set(back.columns)
        # complete cases only: 12 rows have an infinite metric
        stats = spark.read.parquet(f"{folder}/{kind.name}_stats")
        assert stats.where("statistic = 'count'").agg(F.sum(named(METRIC))).first()[0] == N - 12
        assert not {"visit", "ccd"} & (set(stats.columns) - set(kind.keys))
    want = raw(spark).agg(F.max(F.degrees("coord_ra"))).first()[0]
    got = spark.read.parquet(f"{folder}/coadd_forced_stats").where("statistic = 'max'").agg(F.max("ra")).first()[0]
    assert got == pytest.approx(want)


def test_chunks_open_their_own_files_only(spark, folder):
    manifest = spark.read.parquet(folder.replace("/out", "/manifest")).where("dataset = 'visit'")
    chunks = list(manifest_chunks(manifest, VISIT.keys, 3))
    opened = [set(read_with_keys(spark, c, VISIT.keys, ["id"]).inputFiles()) for c in chunks]
    assert len(opened) > 2 and sum(map(len, opened)) == len(set().union(*opened))
    keys = [{tuple(r) for r in c.select(*VISIT.keys).collect()} for c in chunks]
    assert max(map(len, keys)) <= 3 and sum(map(len, keys)) == manifest.count()


def test_integer_metrics_are_described(spark):
    whole = raw(spark).withColumn("base_Footprint_nPix", F.col("base_Footprint_nPix").cast("int"))
    stats = repartition_catalogue(whole, scratch_path(spark, "whole"), COADD_FORCED)
    assert stats.where("statistic = 'max'").agg(F.max("base_Footprint_nPix")).first()[0] == 101


def test_repartition_can_sample(spark):
    out = scratch_path(spark, "sampled")
    stats = repartition_catalogue(raw(spark), out, COADD_FORCED, sample_frac=0.2)
    assert 0 < spark.read.parquet(f"{out}/coadd_forced").count() < N / 2
    assert stats.select("filter", "tract").distinct().count() == 4


def test_explore(spark, folder):
    catalogue = open_catalogue(spark, folder)
    assert catalogue.filters == ("HSC-I", "HSC-R") and catalogue.tracts == (9615, 9616)
    request = Request(
        "HSC-I", (METRIC,), (9615, 1), flags={"calib_psf_used": True}, expression="psfMag < -1 or psfMag > 0",
        state=FilterState({"ra": (150.1, 150.5)}), bins=16,
    )
    tables, warnings = explore(catalogue, request)
    assert warnings == ["tract 1 is not in the data"]
    rows = tables["rows"]
    want = raw(spark).where("filter = 'HSC-I' and tract = 9615 and calib_psf_used and id % 50 != 7").where(
        "-2.5 * log10(base_PsfFlux_instFlux) < -1"
    )
    assert rows.count() == want.count() > 0
    selected = rows.where("ra >= 150.1 and ra < 150.5").count()
    placed = {r.layer: r.n for r in tables["density"].groupBy("layer").agg(F.sum("n").alias("n")).collect()}
    assert placed == {"sky": selected, "scatter": selected}
    assert tables["summary"].where("statistic = 'count'").first()[METRIC] == selected
    assert tables["info"].first().object_count == rows.count()
    assert [r.visit for r in tables["series"].collect()] == ["100", "102"]
    assert {r.column for r in tables["ranges"].collect()} == {"ra", "dec", "psfMag", METRIC}
    one, _ = explore(catalogue, Request("HSC-I", (METRIC,), visit=101))
    assert one["rows"].select("visit").distinct().collect()[0][0] == 101


def test_explore_without_known_tracts_or_metrics(spark, folder):
    catalogue = open_catalogue(spark, folder)
    tables, warnings = explore(catalogue, Request("HSC-I", (METRIC, "gone"), (1,), bins=8))
    assert warnings == ["no metric gone", "tract 1 is not in the data", "no known tract selected, using all tracts"]
    rows = tables["rows"].count()
    assert rows == raw(spark).where("filter = 'HSC-I' and id % 50 != 7").count()
    # every table is about the same tracts as the rows
    assert tables["info"].first().visit_count == 4 and tables["series"].count() == 4
    assert all(r.lo is not None for r in tables["ranges"].select(F.col(tables["ranges"].columns[1]).alias("lo")).collect())
    tables, _ = explore(catalogue, Request("HSC-I", ("gone",)))
    assert "density" not in tables and tables["series"].count() == 0 and tables["rows"].count() > 0


def test_scans_of_explore_do_not_grow_with_the_metrics(spark, folder):
    catalogue = open_catalogue(spark, folder)

    def scans(metrics):
        tables, _ = explore(catalogue, Request("HSC-I", metrics, bins=8))
        found = 0
        for name in ("density", "summary"):
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                tables[name].explain("formatted")
            found += len(re.findall(r"^\(\d+\) Scan parquet", out.getvalue(), re.M))
        return found

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # shows what is shared before anything runs
    try:
        assert scans((METRIC,)) == scans(tuple(m for m in METRICS if m in catalogue.coadd.columns)[:3]) > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_compare(spark):
    left = raw(spark).select(
        "id", F.degrees("coord_ra").alias("ra"), F.degrees("coord_dec").alias("dec"), named(METRIC).alias("m"),
        (F.col("id") % 10 != 0).alias("detect_isPrimary"), F.lit(20.0).alias("psfMag"),
    )
    right = left.withColumn("m", F.col("m") + 1.5).withColumn("dec", F.col("dec") + 1e-5)
    tables = compare_catalogues(left, right, ["m"], 0.5)
    assert tables["differences"].count() == left.where("detect_isPrimary and m < double('inf')").count()
    summary = {r.statistic: r.m for r in tables["summary"].collect()}
    assert summary["mean"] == pytest.approx(1.5) and summary["std"] == pytest.approx(0, abs=1e-9)
