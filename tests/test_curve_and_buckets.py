"""Layouts along a curve and by buckets: what a box opens, and joins without an exchange."""

import math

import pytest
from pyspark.sql import functions as F

from skyqa.functions.frames import scratch_path
from skyqa.sources.layout import curve_place, join_buckets, save_bucketed_table, write_along_curve, write_tables
from skyqa.sources.readers import read_box
from test_summaries import input_records


def sky(spark, n=40_000):
    return spark.range(n).select(
        "id", ((F.col("id") * 7919) % 36000 / 100).alias("ra"), ((F.col("id") * 104729) % 18000 / 100 - 90).alias("dec"), F.lit("x" * 40).alias("text"),
        F.when(F.col("id") % 2 == 0, "r").otherwise("i").alias("band"),
    )


def same(a, b):
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_places_interleave_the_bits_of_both_cells(spark):
    rows = [(0.0, -90.0), (360.0, 90.0), (360.0, -90.0), (0.0, 90.0), (123.4, 5.6), (-5.0, 100.0), (None, 1.0), (math.nan, 1.0)]
    df = spark.createDataFrame(rows, "ra double, dec double").select("ra", "dec", curve_place("ra", "dec").alias("p"))

    def want(ra, dec):
        a, b = (int(min(max(s, 0), 1) * 65535) for s in (ra / 360, (dec + 90) / 180))
        return sum((a >> k & 1) << 2 * k | (b >> k & 1) << 2 * k + 1 for k in range(16))

    for r in df.collect():
        assert r.p == (None if r.ra is None or math.isnan(r.ra) else want(r.ra, r.dec))


@pytest.mark.parametrize("keys", [(), ("band",)])
def test_a_box_opens_few_row_groups(spark, keys):
    odd = spark.createDataFrame([(-1, None, 1.0), (-2, math.nan, 1.0), (-3, 1.0, None)], "id long, ra double, dec double")
    df = sky(spark).unionByName(odd, allowMissingColumns=True)
    path, plain = scratch_path(spark, "curve"), scratch_path(spark, "plain")
    write_along_curve(df, path, keys=keys, files=8, row_group_bytes=64 << 10)
    df.repartition(8).write.option("parquet.block.size", 64 << 10).parquet(plain)
    assert same(df.fillna({"ra": -1.0}), spark.read.parquet(path).fillna({"ra": -1.0}))
    for x, y in (((40.0, 70.0), (-20.0, 5.0)), ((355.0, 4.0), (10.0, 30.0))):
        read = {}
        for name in (path, plain):
            before = input_records(spark)
            rows = read_box(spark, name, x, y).collect()
            read[name] = input_records(spark) - before
        inside = (F.col("ra") >= x[0]) & (F.col("ra") < x[1]) if x[0] < x[1] else (F.col("ra") >= x[0]) | (F.col("ra") < x[1])
        want = df.where(inside & ~F.isnan("ra") & F.col("dec").between(y[0], y[1] - 1e-9)).count()
        assert len(rows) == want > 0
        assert read[path] < read[plain] / 4


def test_bucketed_tables_join_without_an_exchange(spark):
    df = sky(spark, 3000)
    names = [f"t_{scratch_path(spark, 'x').rsplit('-', 1)[1]}" for _ in range(4)]
    save_bucketed_table(df.select("id", "ra"), names[0], [], "id", 4, scratch_path(spark, "buckets"))
    save_bucketed_table(df.select("id", "band", "dec"), names[1], ["band"], "id", 4, scratch_path(spark, "buckets"))
    save_bucketed_table(df.select("id", "text"), names[2], [], "id", 8, scratch_path(spark, "buckets"))
    save_bucketed_table(df.select("id", "text"), names[3], [], "text", 4, scratch_path(spark, "buckets"))
    joined = join_buckets(spark, names[0], names[1], "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert same(joined, df.select("id", "ra", "dec", "band"))
    for other in names[2:]:
        with pytest.raises(ValueError, match="not both bucketed"):
            join_buckets(spark, names[0], other, "id")
    for name in names:
        spark.sql(f"drop table {name}")


def test_tables_by_key_are_unchanged(spark):
    path = scratch_path(spark, "tables")
    write_tables(sky(spark, 500), path, ["band"])
    assert spark.read.parquet(path).count() == 500
