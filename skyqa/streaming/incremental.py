"""Appending newly landed catalogue files with Structured Streaming.

The batch counterpart is :func:`skyqa.sources.layout.write_incremental`. Here Spark keeps
track of the files it has seen, and every file is loaded exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skyqa.sources.layout import NUM_BUCKETS, with_bucket


def append_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    bucket_by: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    num_buckets: int = NUM_BUCKETS,
    max_files: int | None = None,
) -> StreamingQuery:
    """Load every file that is new since the last call, then stop.

    ``prepare`` is a row-wise step such as ``normalize``. ``max_files`` bounds one batch.
    Both ``target`` and ``checkpoint`` must be in storage that all executors share.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = with_bucket(prepare(reader.parquet(source)), bucket_by, num_buckets)
    return (
        rows.writeStream.format("parquet")
        .partitionBy(*keys)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
