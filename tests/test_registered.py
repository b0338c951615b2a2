"""Every registered query against its SQL, and the shape of the plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.catalogue import KEYS, VALUES, catalogue, first_cat, second_cat
from checks.registry import QUERIES, SQL
from skyqa.operators.filters import FilterState
from skyqa.operators.match import neighbours
from skyqa.operators.raster import Axis, sky_raster
from skyqa.operators.stats import describe_by_key
from tools.verify import connect, rows_of


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_of(df):
    """The scan details, which the short form of a plan cuts off."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["visit", "flux", "metric_a", "metric_b"] and df.count() == 7


@pytest.mark.parametrize("name", ["sky_raster", "sky_match", "points_in_tracts", "tract_map", "visit_minmax_mean"])
def test_no_nested_loop_joins(spark, small, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoop", plan_of(entry.queries()[name](spark, small)))


def test_raster_reads_its_columns_and_combines_before_the_exchange(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    x, y = Axis("l_extendedprice", 8, 0.0, 1e5), Axis("l_quantity", 8, 0.0, 50.0)
    made = sky_raster(df, "l_tax", "mean", x, y, FilterState({"l_discount": (0.01, 0.05)}))
    assert plan_of(made).count("Exchange") == 1 and "partial_avg" in plan_of(made)
    plan = scan_of(made)
    assert "GreaterThanOrEqual(l_discount,0.01)" in plan and "GreaterThanOrEqual(l_extendedprice,0.0)" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"l_extendedprice", "l_quantity", "l_tax", "l_discount"}


def test_match_is_an_equi_join_on_cubes(spark, small):
    plan = plan_of(neighbours(first_cat(spark, small), second_cat(spark, small), 0.001))
    assert "cx" in plan and "WindowGroupLimit" in plan
    assert not re.search("CartesianProduct|BroadcastNestedLoop", plan)


def test_means_alone_move_no_rows(spark, small):
    plan = plan_of(describe_by_key(catalogue(spark, small), KEYS, VALUES, percentiles=()))
    assert "partial_avg" in plan and "Window" not in plan


def test_python_never_touches_rows(spark, small):
    for name in ("describe_by_key", "sky_match", "scatter_density", "selection_keys"):
        plan = plan_of(entry.queries()[name](spark, small))
        assert not re.search("Python|Arrow", plan)


def test_results_do_not_depend_on_partitions(spark, small):
    cat = catalogue(spark, small)
    a = describe_by_key(cat, KEYS, ["flux"])
    b = describe_by_key(cat.repartition(11), KEYS, ["flux"])
    exact = [c for c in ("1%", "50%", "99%", "min", "max", "count")]
    keep = F.col("statistic").isin(exact)
    assert a.where(keep).exceptAll(b.where(keep)).isEmpty()
