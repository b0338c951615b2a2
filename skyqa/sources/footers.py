"""Answers from what Parquet files say about themselves: limits and counts from footers, keys from folder names."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyqa.functions.clean import named
from skyqa.operators.stats import extent
from skyqa.sources.changes import file_manifest

_PUSHED = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
_EXTENT = T.StructType([T.StructField("column", T.StringType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])


def footer_aggregate(spark: SparkSession, path: str, columns: Sequence[str], where: Mapping[str, object] | None = None) -> DataFrame:
    """One row with the row count ``n`` and ``lo|column``, ``hi|column`` of a table, of which Spark reads the footers only.

    ``where`` may test partition columns for equality. The frame belongs to a session of its own, in which Spark may answer
    aggregates from footers; the settings of ``spark`` stay as they are.
    """
    session = spark.newSession()
    for key, value in _PUSHED.items():
        session.conf.set(key, value)
    rows = session.read.parquet(path)
    for k, v in (where or {}).items():
        rows = rows.where(named(k) == F.lit(v))
    limits = [f(named(c)).alias(f"{side}|{c}") for c in columns for side, f in (("lo", F.min), ("hi", F.max))]
    return rows.agg(F.count(F.lit(1)).alias("n"), *limits)


def stored_extent(spark: SparkSession, path: str, columns: Sequence[str], where: Mapping[str, object] | None = None) -> DataFrame:
    """:func:`skyqa.operators.stats.extent` of a stored table: ``column, lo, hi``, from footers if they can tell.

    A file that holds NaN or no value at all states no limits, and an infinite limit hides the finite one; then the columns are read.
    """
    try:
        found = footer_aggregate(spark, path, columns, where).first()
    except (PySparkException, Py4JJavaError) as error:
        if "No min/max found" not in str(error):
            raise
        found = None
    if found is not None:
        limits = [(c, found[f"lo|{c}"], found[f"hi|{c}"]) for c in columns]
        if all(v is None or math.isfinite(v) for _, *both in limits for v in both):
            rows = [(c, *(None if v is None else float(v) + 0.0 for v in both)) for c, *both in limits]
            return spark.createDataFrame(rows, _EXTENT)
    table = spark.read.parquet(path)
    for k, v in (where or {}).items():
        table = table.where(named(k) == F.lit(v))
    return extent(table, columns)


def stored_count(spark: SparkSession, path: str, where: Mapping[str, object] | None = None) -> int:
    """The number of rows of a stored table (of some partitions), from footers."""
    return footer_aggregate(spark, path, [], where).first()["n"]


def stored_keys(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of a table partitioned by them, from the names of its folders. A folder of empty files counts."""
    return file_manifest(spark, path, keys).select(*[named(k) for k in keys]).distinct()
