"""Limits and counts from footers, and when the rows are read after all."""

import math

import pytest
from pyspark.sql import functions as F

from skyqa.functions.frames import scratch_path
from skyqa.operators.stats import extent
from skyqa.sources.footers import footer_aggregate, stored_count, stored_extent, stored_keys
from test_summaries import input_records


@pytest.fixture(scope="module")
def table(spark):
    path = scratch_path(spark, "table")
    rows = spark.range(5000).select(
        (F.col("id") % 3).cast("int").alias("tract"), (F.col("id") * 37 % 1001 - 500.0).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") / 7).alias("gappy"),
        F.lit(None).cast("double").alias("none"), F.col("id").cast("int").alias("n"),
        F.when(F.col("id") == 77, F.lit(math.nan)).otherwise(F.col("id") * 1.0).alias("nan"), F.when(F.col("id") == 78, F.lit(-math.inf)).otherwise(F.col("id") * 1.0).alias("inf"),
    )
    rows.repartition(4).write.partitionBy("tract").parquet(path)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_limits_come_from_footers(spark, table):
    columns = ["a", "gappy", "n"]
    plan = footer_aggregate(spark, table, columns)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(a)" in plan
    before = input_records(spark)
    got = stored_extent(spark, table, columns)
    assert input_records(spark) - before < 50  # a row for each footer
    want = extent(spark.read.parquet(table), columns)
    assert got.dtypes == want.dtypes and rows(got) == rows(want)
    assert rows(stored_extent(spark, table, ["none"])) == [("none", None, None)]
    one = stored_extent(spark, table, ["a"], {"tract": 2})
    assert rows(one) == rows(extent(spark.read.parquet(table).where("tract = 2"), ["a"]))


@pytest.mark.parametrize("column", ["nan", "inf"])
def test_rows_are_read_where_footers_cannot_tell(spark, table, column):
    before = input_records(spark)
    got = rows(stored_extent(spark, table, ["a", column]))
    assert got == rows(extent(spark.read.parquet(table), ["a", column])) and got[1][1:] == (0.0, 4999.0)
    assert input_records(spark) - before >= 5000


def test_counts_and_keys(spark, table):
    before = input_records(spark)
    assert (stored_count(spark, table), stored_count(spark, table, {"tract": 1})) == (5000, 1667)
    assert rows(stored_keys(spark, table, ["tract"])) == [(0,), (1,), (2,)]
    assert input_records(spark) - before < 100
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
