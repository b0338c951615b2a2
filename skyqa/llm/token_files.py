"""Token ids in Parquet files: list columns, chosen encoding, small row groups and pages with indexes.

Each file holds documents in ascending ``doc_id`` order, and the files follow each other in that order, so a reader
that wants some documents, or only their sizes, opens few row groups and pages: the statistics and page
indexes on ``doc_id`` and ``n_tokens`` are written by Spark's Parquet writer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyqa.llm.tokens import Tokens
from skyqa.llm.words import list_array

#: Bytes of a row group and of a page: a page is what a selective read of one document costs at least.
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 64 << 10

_SCHEMA = "doc_id long, n_tokens long, part int, before long, tokens array<int>"


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, encoding: str = "dictionary"
) -> None:
    """Tokenize ``docs(doc_id, text)`` and write the ids, with ``end_id`` after each document.

    ``encoding`` is ``dictionary`` or ``delta`` (binary packed differences). NULL text counts as empty and gives the
    end id alone. A NULL ``doc_id`` sorts first; rows that repeat a ``doc_id`` are all kept, in the order of their
    text. Other columns are ignored. ``part`` numbers the files in order and ``before`` counts
    the ids ahead of a document in its file.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seen = Tokens(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0)
            for at, to, ids, sizes in tokens.blocks(batch.column(1)):
                n = to - at
                ends = np.cumsum(sizes + 1) - 1
                out = np.full(len(ids) + n, end_id, np.int32)
                body = np.ones(len(out), bool)
                body[ends] = False
                out[body] = ids
                sizes = sizes + 1
                before = seen + np.cumsum(sizes) - sizes
                seen += len(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(at, n).cast(pa.int64()),
                        pa.array(sizes),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(before),
                        list_array(out, sizes),
                    ],
                    ["doc_id", "n_tokens", "part", "before", "tokens"],
                )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, _SCHEMA)
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "v2" if encoding == "delta" else "v1")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .mode("overwrite")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as a frame; select columns and filter on ``doc_id`` to read only pages that are needed."""
    return spark.read.schema(_SCHEMA).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the ids in the files.

    ``start`` counts the ids of all documents before it. Only the total of each file is summed over files; no ids
    are exchanged.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets)
            ids = np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(crc, pa.int64())], ["doc_id", "part", "before", "n_tokens", "ids_crc32"]
            )

    files = read_tokens(spark, path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    base = totals.select("part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("base"))
    rows = files.select("doc_id", "part", "before", "tokens").mapInArrow(
        digest, "doc_id long, part int, before long, n_tokens long, ids_crc32 long"
    )
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
