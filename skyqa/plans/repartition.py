"""Batch job: raw per-key files to a clean partitioned catalogue and its statistics.

``spark-submit -m``-style entry: ``python -m skyqa.plans.repartition MANIFEST DESTINATION``.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyqa.functions.clean import named
from skyqa.functions.frames import broadcast_if_small, cut, join_on
from skyqa.operators.ingest import normalize, project_dataset, sample_fraction
from skyqa.operators.keys import key_chunks
from skyqa.operators.schema import KINDS, CatalogueKind, numeric_columns
from skyqa.operators.stats import describe_by_key, key_summaries
from skyqa.sources.layout import NUM_BUCKETS, write_incremental, write_partitioned, write_stats
from skyqa.sources.readers import read_with_keys, scan


def cleaned(raw: DataFrame, kind: CatalogueKind, sample_frac: float | None = None) -> DataFrame:
    """Raw rows as they are stored: projected, perhaps sampled, normalised."""
    rows = project_dataset(raw, kind)
    return normalize(sample_fraction(rows, sample_frac) if sample_frac else rows)


def write_catalogue_stats(spark: SparkSession, destination: str, kind: CatalogueKind) -> DataFrame:
    """Describe the written catalogue and write that beside it; returns the table.

    The summaries of the keys are written first and kept: the statistics need one more pass with them, and
    so do ranges and quantiles that are asked for later.
    """
    written = scan(spark, f"{destination}/{kind.name}").drop("bucket")
    metrics = numeric_columns(written, skip=[*kind.keys, kind.bucket_by])
    kept, path = f"{destination}/{kind.name}_summaries", f"{destination}/{kind.name}_stats"
    write_stats(key_summaries(written, kind.keys, metrics), kept)
    write_stats(describe_by_key(written, kind.keys, metrics, summaries=spark.read.parquet(kept)), path)
    return spark.read.parquet(path)


def repartition_catalogue(
    raw: DataFrame,
    destination: str,
    kind: CatalogueKind,
    sample_frac: float | None = None,
    num_buckets: int = NUM_BUCKETS,
    chunk_keys: int | None = None,
) -> DataFrame:
    """Write one catalogue and its statistics table below ``destination``; returns the latter.

    ``raw`` has the raw columns and the key columns. Statistics are computed from the
    written catalogue, so the raw rows are read once, or once a chunk with ``chunk_keys``.
    """
    clean = cleaned(raw, kind, sample_frac)
    path = f"{destination}/{kind.name}"
    if chunk_keys is None:
        write_partitioned(clean, path, kind.keys, kind.bucket_by, num_buckets)
    else:
        write_incremental(clean, path, kind.keys, kind.bucket_by, num_buckets, chunk_keys)
    return write_catalogue_stats(raw.sparkSession, destination, kind)


def manifest_chunks(files: DataFrame, keys: Sequence[str], chunk_keys: int) -> Iterator[DataFrame]:
    """The manifest rows of at most ``chunk_keys`` keys of one filter at a time."""
    numbered = cut(key_chunks(files.select(*[named(k) for k in keys]).distinct(), keys[0], chunk_keys))
    first = named(keys[0])
    for value, chunk in sorted(tuple(r) for r in numbered.select(first, "chunk").distinct().collect()):
        wanted = numbered.where(first.eqNullSafe(F.lit(value)) & (F.col("chunk") == chunk)).drop("chunk")
        yield join_on(files, broadcast_if_small(wanted), keys, "left_semi")


def repartition_files(
    spark: SparkSession,
    files: DataFrame,
    destination: str,
    kind: CatalogueKind,
    sample_frac: float | None = None,
    num_buckets: int = NUM_BUCKETS,
    chunk_keys: int | None = None,
    root: str | None = None,
) -> DataFrame:
    """As :func:`repartition_catalogue`, from a manifest of raw files: ``path`` and the keys.

    With ``chunk_keys`` the manifest is cut, not the rows: a chunk opens its own files only,
    so every file is read once, and replaces its own partitions, so a load that was
    interrupted can be run again. ``root`` is for a manifest that is loaded as a whole: files
    are found below that folder instead of by a list of paths from the driver.
    """
    columns = [c for c in kind.columns() if c not in kind.keys]
    chunks = [files] if chunk_keys is None else manifest_chunks(files, kind.keys, chunk_keys)
    for part in chunks:
        raw = read_with_keys(spark, part, kind.keys, columns, root if chunk_keys is None else None)
        clean = cleaned(raw, kind, sample_frac)
        write_partitioned(clean, f"{destination}/{kind.name}", kind.keys, kind.bucket_by, num_buckets)
    return write_catalogue_stats(spark, destination, kind)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("manifest", help="Parquet table: path, dataset, filter, tract, visit")
    parser.add_argument("destination")
    parser.add_argument("--sample-frac", type=float, default=None)
    parser.add_argument("--num-buckets", type=int, default=NUM_BUCKETS)
    parser.add_argument(
        "--chunk-keys", type=int, nargs="?", const=0, default=None, help="keys a chunk; no number: as the catalogue has it"
    )
    parser.add_argument("--root", default=None, help="folder of all raw files, for a load without chunks")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("catalogue repartition").getOrCreate()
    manifest = spark.read.parquet(args.manifest)
    for kind in KINDS.values():
        files = manifest.where(manifest["dataset"] == kind.name)
        if files.isEmpty():
            continue
        chunk = kind.chunk_keys if args.chunk_keys == 0 else args.chunk_keys
        repartition_files(
            spark, files, args.destination, kind, args.sample_frac, args.num_buckets, chunk, args.root
        )


if __name__ == "__main__":
    main()
