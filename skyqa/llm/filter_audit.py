"""Filter interaction audit: what each filter removes, alone and behind others, in every order of the filters.

A document is the set of filters that it fails. The step at which an order removes it is a min-plus product: the set's
row of a mask matrix (0 where it fails, else infinity) plus the order's row of a matrix of positions (the inverse
permutation), at its minimum. Spark counts documents by part and set; the counts are then scattered to these steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyqa.functions.frames import cut
from skyqa.llm.tables import written
from skyqa.llm.words import find_words, text_blocks

#: The filters; a document fails number k if bit k of its set is one.
FILTERS = "ABCDE"
#: Fewest words, fewest distinct words and most capital letters, the last two in percent.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5

_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#$%&*|")] = True
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def removal_steps(n_filters: int, orders: np.ndarray) -> np.ndarray:
    """``[set, order]``: the step (from 1) at which the order removes the set's documents, ``n_filters + 1`` if never.

    ``orders[o, k]`` is the filter that order o applies at step k + 1.
    """
    failed = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1
    masks = np.where(failed == 1, 0, n_filters + 1)
    positions = np.argsort(orders, axis=1) + 1
    return np.minimum((masks[:, None, :] + positions[None, :, :]).min(axis=2), n_filters + 1)


def audit_counts(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, orders: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``SCHEMA`` as ``[part, order, step]`` from counts by ``[part, set]``."""
    parts, sets = n.shape
    n_orders, n_filters = orders.shape
    steps = removal_steps(n_filters, orders)
    row = np.arange(n_orders)

    def scattered(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((parts, n_orders, n_filters + 1), np.int64)
        for k in range(sets):
            out[:, row, steps[k] - 1] += weight[:, k, None]
        return out[:, :, :n_filters]

    removed = scattered(n)
    redundant = np.zeros_like(removed)
    for k in range(sets):  # steps after the removal at which the set's documents would fail as well
        late = (k >> orders & 1 == 1) & (np.arange(1, n_filters + 1) > steps[k][:, None])
        redundant += n[:, k, None, None] * late
    position = np.argsort(orders, axis=1)
    by_filter = removed[:, row[:, None], position].sum(axis=1)
    return {
        "kept": n.sum(axis=1)[:, None, None] - removed.cumsum(axis=2),
        "removed": removed,
        "redundant": redundant,
        "unique_fails": n[:, 1 << orders],
        "good_lost": scattered(good),
        "toxic_lost": scattered(toxic),
        "shapley": by_filter[:, orders],
    }


def text_fails(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3 of each text's set: too few words, too few distinct ones, too many capitals, odd signs. NULL is empty."""
    out = []
    for _, _, data, offsets in text_blocks(texts):
        words = find_words(data, offsets)
        n = np.diff(words.first)
        order = np.argsort(words.hash, kind="stable")  # equal words in the order of their texts
        h, doc = words.hash[order], words.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        distinct = np.bincount(doc[new], minlength=len(n))
        capitals = _inside(offsets, (data >= 65) & (data <= 90))
        points = _inside(offsets, (data & 0xC0) != 0x80)
        signs = _inside(offsets, _SIGNS[data])
        fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * points, signs > 0)
        out.append(sum(f.astype(np.int32) << k for k, f in enumerate(fails)))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _inside(offsets: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.diff(sums[offsets])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arrays = [*batch.columns[:-1], pa.array(text_fails(batch.column(batch.num_columns - 1)), pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "fails"])


def failed_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, part, fails`` of every row: the set of filters that it fails, the copies (E) included.

    A row is a copy if its text is that of a smaller doc_id; a row without an id is no copy and makes none. Texts are equal if two 64-bit
    hashes of them are. The smallest id of each text is an aggregate that combines in the tasks, so copies never meet in one place.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(F.lit(1), text).alias("h"),
        F.xxhash64(F.lit(2), text).alias("g"),
        text.alias("text"),
    )
    judged = written(rows.mapInArrow(_judge, "doc_id long, part string, h long, g long, fails int"), "failed-filters")
    first = judged.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = cut(first)  # so that both sides of the join have exchanges of their own and Spark can split many copies of one text
    marked = judged.join(first, ["h", "g"], "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return marked.select("doc_id", "part", (F.col("fails") + copy).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per source, order of the filters and step, with the counts of that step (``SCHEMA``).

    ``docs(doc_id, text, source)``, ``labels(doc_id, quality, toxic)``; a document is good (toxic) if any label of its id says so. NULL text is
    empty, a NULL source the part ''. Repeated rows count each; an empty table gives no rows. Other columns are ignored.
    """
    said = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"),
        )
    )
    counts = (
        failed_sets(docs)
        .join(said, "doc_id", "left")
        .groupBy("part", "fails")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    )
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))  # 32 at most
    return by_part.mapInArrow(lambda batches: _audit(batches, FILTERS), SCHEMA)


def _audit(batches: Iterator[pa.RecordBatch], filters: Sequence[str]) -> Iterator[pa.RecordBatch]:
    orders = np.array(list(permutations(range(len(filters)))))
    names = ["".join(filters[f] for f in o) for o in orders]
    n_orders, n_steps = orders.shape
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part, sets = batch.column(0)[at : at + 64], batch.column(1)[at : at + 64]
            own = np.repeat(np.arange(len(part)), np.diff(np.asarray(sets.offsets)))
            cells = sets.flatten()
            weights = np.zeros((3, len(part), 1 << len(filters)), np.int64)
            for k in range(3):
                weights[k, own, np.asarray(cells.field(0))] = np.asarray(cells.field(k + 1))
            counts = audit_counts(*weights, orders)
            rows = n_orders * n_steps
            full = np.broadcast_arrays(*[counts[c].reshape(len(part), rows) for c in _COUNTS])
            yield pa.RecordBatch.from_arrays(
                [
                    part.take(pa.array(np.repeat(np.arange(len(part)), rows))),
                    pa.array(np.repeat(names, n_steps).tolist() * len(part)),
                    pa.array(np.tile(np.arange(1, n_steps + 1), n_orders * len(part)), pa.int32()),
                    *(pa.array(c.ravel()) for c in full),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )
