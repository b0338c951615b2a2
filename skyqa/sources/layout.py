"""Writing catalogues and statistics: partitioned, bucketed, incremental."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, named
from skyqa.functions.frames import cut
from skyqa.operators.keys import key_chunks
from skyqa.sources.readers import is_complete, rows_of_keys

# Buckets per partition, and keys per chunk of an incremental load.
NUM_BUCKETS = 8
CHUNK_KEYS = 20

BUCKET = "bucket"


def with_bucket(df: DataFrame, bucket_by: str, num_buckets: int = NUM_BUCKETS) -> DataFrame:
    """Add the bucket number of a row, a hash of one column."""
    return df.withColumn(BUCKET, F.pmod(F.hash(named(bucket_by)), F.lit(num_buckets)).cast("int"))


def write_partitioned(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    bucket_by: str,
    num_buckets: int = NUM_BUCKETS,
    mode: str = "overwrite",
) -> None:
    """Write one folder per key, rows clustered by bucket.

    The exchange is a rebalance by keys and bucket: Spark merges small partitions and
    splits one that is too large, so a key with a third of the rows is written by many
    tasks. ``overwrite`` replaces the partitions that the frame has rows for and leaves
    the others alone, so a load can be repeated; ``append`` adds rows.
    """
    placed = with_bucket(df, bucket_by, num_buckets)
    order = [*[named(k) for k in keys], named(BUCKET), named(bucket_by)]
    (
        placed.hint("rebalance", *[named(k) for k in keys], named(BUCKET))
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def save_bucketed_table(
    df: DataFrame,
    table: str,
    keys: Sequence[str],
    bucket_by: str,
    num_buckets: int = NUM_BUCKETS,
    path: str | None = None,
) -> None:
    """Save as a catalogue table with Spark's own buckets, for joins without an exchange.

    A bucket is sorted and one file for each key, or one in all without keys. ``path`` is a folder for the files instead of
    the warehouse.
    """
    rows = df.repartition(num_buckets, named(bucket_by)) if not keys else df.repartition(*[named(k) for k in keys], named(bucket_by))
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(num_buckets, bucket_by).sortBy(bucket_by)
    if keys:
        writer = writer.partitionBy(*keys)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def join_buckets(spark: SparkSession, left: str, right: str, on: str, how: str = "inner") -> DataFrame:
    """Join two tables of :func:`save_bucketed_table` that are bucketed by ``on``: bucket by bucket, without an exchange.

    Tables with other buckets raise :class:`ValueError`, as Spark would exchange them without a word.
    """
    tables = []
    for name in (left, right):
        about = {r.col_name: r.data_type for r in spark.sql(f"describe extended {name}").collect()}
        tables.append((about.get("Num Buckets"), about.get("Bucket Columns", "").strip("[]").replace("`", "")))
    if tables[0] != tables[1] or tables[0][1] != on:
        raise ValueError(f"{left} and {right} are not both bucketed by {on} alike: {tables}")
    return spark.table(left).join(spark.table(right).hint("merge"), on, how)


def curve_place(
    x: str, y: str, x_range: tuple[float, float] = (0.0, 360.0), y_range: tuple[float, float] = (-90.0, 90.0)
) -> Column:
    """Place of a position on a space-filling curve: the bits of its two 16-bit cell numbers in turn, NULL without a position.

    Positions outside the ranges count as on their edge.
    """

    def cell(name: str, limits: tuple[float, float]) -> Column:
        v = finite_or_null(named(name).cast("double"))
        share = (v - limits[0]) / (limits[1] - limits[0])
        inside = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
        return F.when(v.isNotNull(), F.floor(inside * 65535).cast("long"))

    def spread(v: Column) -> Column:
        """The bits of a 16-bit number, each followed by a zero."""
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(cell(x, x_range)).bitwiseOR(F.shiftleft(spread(cell(y, y_range)), 1))


def write_along_curve(
    df: DataFrame,
    path: str,
    x: str = "ra",
    y: str = "dec",
    x_range: tuple[float, float] = (0.0, 360.0),
    y_range: tuple[float, float] = (-90.0, 90.0),
    keys: Sequence[str] = (),
    files: int | None = None,
    row_group_bytes: int = 32 << 20,
    mode: str = "overwrite",
) -> None:
    """Write rows in the order of a space-filling curve, so that a box on the sky lies in few files and row groups.

    The exchange is by ranges of keys and place, which Spark samples: dense regions get more tasks. Every row group then covers a
    small area, and the limits of x and y in its statistics are what a box read skips by.
    """
    place = curve_place(x, y, x_range, y_range)
    order = [*[named(k) for k in keys], F.col("__place")]
    placed = df.withColumn("__place", place)
    dealt = placed.repartitionByRange(*order) if files is None else placed.repartitionByRange(files, *order)
    writer = dealt.sortWithinPartitions(*order).drop("__place").write.mode(mode).option("parquet.block.size", row_group_bytes)
    if keys:
        writer = writer.partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_incremental(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    bucket_by: str,
    num_buckets: int = NUM_BUCKETS,
    chunk_keys: int = CHUNK_KEYS,
) -> int:
    """Load a catalogue a chunk of keys at a time and return the number of chunks.

    Each filter (the first key) is cut into chunks of at most ``chunk_keys`` keys, at least
    one. A chunk replaces its own partitions, so a load that was interrupted can simply be
    run again. Spark spills, so this is for bounding the work of one job, not for memory. Where ``df`` is a
    table partitioned by the keys, a chunk opens the files of its keys only.
    """
    numbered = cut(key_chunks(df.select(*[named(k) for k in keys]).distinct(), keys[0], chunk_keys))
    chunks = numbered.select(named(keys[0]), "chunk").distinct().collect()
    for first, chunk in sorted(map(tuple, chunks), key=lambda r: (r[0] is None, str(r[0]), r[1])):
        wanted = numbered.where(named(keys[0]).eqNullSafe(F.lit(first)) & (F.col("chunk") == chunk))
        write_partitioned(rows_of_keys(df, wanted, keys), path, keys, bucket_by, num_buckets)
    return len(chunks)


def write_tables(df: DataFrame, path: str, keys: Sequence[str] = ("filter", "table", "tract")) -> None:
    """Export rows of several tables, one folder per filter, table and tract."""
    columns = [named(k) for k in keys]
    (
        df.hint("rebalance", *columns)
        .sortWithinPartitions(*columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def write_stats(stats: DataFrame, path: str) -> None:
    """Write a statistics table, or kept summaries: the sketches of a group repeat values, which this codec finds."""
    stats.write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_stats(
    spark: SparkSession,
    path: str,
    compute: Callable[[], DataFrame],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read a statistics table, computing and writing it first if it is not there.

    A table without success marker is half-written and made anew.
    """
    if not is_complete(spark, path):
        write_stats(compute(), path)
    stats = spark.read.parquet(path)
    return stats if columns is None else stats.select(*[named(c) for c in columns])
