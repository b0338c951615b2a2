"""Quality scores: random-indexing word vectors pooled per document, and a small network with calibrated output.

Every piece of a text (a run of letters, a digit, a run of signs) falls into one of ``WORDS`` hashed places, each with a
fixed sparse random index vector. The context vector of a place is the sum of the index vectors around all its
occurrences in all documents. A document is the mean of its index and context vectors with a few shares of
signs. A network of two layers is fitted to labelled documents by numpy; a temperature found on rows kept
from the fit turns its output into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyqa.functions.frames import cut
from skyqa.llm.tokens import _pieces
from skyqa.llm.words import hash_ranges, text_blocks

#: Hashed places of words, components of a vector, signs of an index vector, words on each side that are context.
WORDS, DIMENSIONS, SIGNS, REACH = 1 << 14, 64, 4, 2
#: Labelled rows that are fitted at most: a fixed sample by hash of the id, held on the driver (about 600 bytes each).
FIT_ROWS = 20_000
#: Rows of the context table in one message.
_SLICE = 512
#: Groups of tasks whose sums of one slice are added up together before they meet the others.
_PARTS = 256


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each place, which components of its index vector are set, and their signs."""
    draw = np.random.default_rng(7)
    return draw.integers(0, DIMENSIONS, (WORDS, SIGNS)), draw.choice([-1.0, 1.0], (WORDS, SIGNS))


def _places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    raw, start, end, _ = _pieces(data, offsets)
    h = hash_ranges(raw, start, end)
    return raw, start, end, (h >> np.uint64(50)).astype(np.int64), np.searchsorted(start, offsets)


def context_table(docs: DataFrame) -> np.ndarray:
    """Context vectors (rows of length 1) of all places, from every whole text of ``docs(text)``.

    The result has a fixed size. Tasks send their sums in slices, which are added up in two steps: parts of the tasks
    beside each other for each slice, then the few sums of a slice. Sums of signs are whole numbers, so their order does not matter.
    """
    which, sign = index_vectors()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(WORDS * DIMENSIONS)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                _, _, _, place, first = _places(data, offsets)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, REACH + 1):
                    a, b = place[:-step], place[step:]
                    same = doc[:-step] == doc[step:]
                    a, b = a[same], b[same]
                    for word, near in ((a, b), (b, a)):
                        cell = word[:, None] * DIMENSIONS + which[near]
                        table += np.bincount(cell.ravel(), sign[near].ravel(), WORDS * DIMENSIONS)
        slices = table.reshape(-1, _SLICE * DIMENSIONS)
        full = np.flatnonzero(slices.any(axis=1))
        for k in full.tolist():
            yield _slice_row(k, slices[k])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(held, "<f8")
                sums[k] = sums[k] + values if k in sums else values
        for k, values in sums.items():
            yield _slice_row(k, values)

    schema = "slice int, sums binary"
    parts = docs.select("text").mapInArrow(gather, schema)
    table = np.zeros((WORDS // _SLICE, _SLICE * DIMENSIONS))
    some = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_PARTS))).repartition("slice", "part")
    some = some.select("slice", "sums").mapInArrow(add, schema)
    for row in some.repartition(WORDS // _SLICE, "slice").mapInArrow(add, schema).toLocalIterator():
        table[row.slice] = np.frombuffer(row.sums, "<f8")
    table = table.reshape(WORDS, DIMENSIONS)
    size = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return (table / np.where(size > 0, size, 1)).astype(np.float32)


def _slice_row(k: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([values.astype("<f8").tobytes()])], ["slice", "sums"])


def document_vectors(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of features per text: pooled vectors, then logarithm of the pieces and shares of kinds of signs."""
    raw, start, end, place, first = _places(data, offsets)
    n = len(first) - 1
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    pooled = np.zeros((n, vectors.shape[1]))
    filled = np.flatnonzero(count)
    step = max(1, (1 << 26) // vectors.shape[1] // 4)
    for at in range(0, len(place), step):  # long texts in parts of bounded size
        own = doc[at : at + step]
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        pooled[own[edge]] += np.add.reduceat(vectors[place[at : at + step]], edge, axis=0)
    pooled[filled] /= count[filled, None]
    out = np.zeros((n, vectors.shape[1] + 5), np.float32)
    out[:, :-5] = pooled * 8
    out[:, -5] = np.log1p(count) / 4
    head = raw[start] if len(start) else np.zeros(0, np.uint8)
    upper = (head >= 65) & (head <= 90)
    letter = upper | (head >= 97) & (head <= 122) | (head >= 128)
    second = raw[np.minimum(start + 1, len(raw) - 1)] if len(start) else head
    caps = upper & (end - start > 1) & (second >= 65) & (second <= 90)
    for j, flag in enumerate((letter, caps, end - start > 12)):
        out[filled, j - 4] = np.bincount(doc, flag, n)[filled] / count[filled]
    size = np.diff(offsets)
    lines = np.diff(np.searchsorted(np.flatnonzero(raw == 10), offsets))
    out[:, -1] = np.log1p(size / (1 + lines)) / 8
    return out


class Network:
    """Two layers: ``tanh(x a + b) c + d``, scaled inputs, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 3):
        draw = np.random.default_rng(seed)
        kept = draw.random(len(y)) < 0.2
        if kept.all() or not kept.any():
            kept = np.zeros(len(y), bool)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.a = draw.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1])
        self.b, self.c, self.d = np.zeros(hidden), draw.standard_normal(hidden) / np.sqrt(hidden), 0.0
        self.temperature = 1.0
        self._fit((x[~kept] - self.mean) / self.scale, y[~kept], rounds, draw)
        if kept.any():
            z = self.raw(x[kept])
            steps = np.geomspace(0.25, 8, 61)
            self.temperature = float(min(steps, key=lambda t: _loss(z / t, y[kept])))

    def _fit(self, x, y, rounds, draw) -> None:
        part = [self.a, self.b, self.c, np.array([self.d])]
        first, second, step = [np.zeros_like(p) for p in part], [np.zeros_like(p) for p in part], 0
        size = min(256, len(y))
        for _ in range(rounds):
            order = draw.permutation(len(y))
            for at in range(0, len(y) - size + 1, size):
                rows = order[at : at + size]
                inner = np.tanh(x[rows] @ part[0] + part[1])
                error = (_sigmoid(inner @ part[2] + part[3][0]) - y[rows]) / size
                back = error[:, None] * part[2] * (1 - inner * inner)
                slopes = [x[rows].T @ back + 1e-4 * part[0], back.sum(axis=0), inner.T @ error, np.array([error.sum()])]
                step += 1
                for i, g in enumerate(slopes):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    part[i] -= 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.a, self.b, self.c, self.d = *part[:3], float(part[3][0])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.a + self.b) @ self.c + self.d

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A NULL id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit_scorer(docs: DataFrame, labels: DataFrame) -> Callable[[Column], Column]:
    """A function that scores a text column, fitted to ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    Learns from rows with quality 0 or 1 that are not :func:`held_out`, at most ``FIT_ROWS``; the context vectors come
    from all texts. A repeated label counts as its smallest one. Without labels of both kinds every score
    is the share of label 1 among them (0.5 without any).
    """
    spark = docs.sparkSession
    known = cut(
        labels.where(F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(FIT_ROWS)
    )
    texts = docs.select("doc_id", "text")
    which, sign = index_vectors()
    index = np.zeros((WORDS, DIMENSIONS), np.float32)
    np.add.at(index, (np.arange(WORDS)[:, None], which), sign.astype(np.float32) / 2)
    # WORDS x 128 floats, whatever the corpus
    held = spark.sparkContext.broadcast(np.hstack([index, context_table(texts)]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_blocks(batch.column(1)):
                rows = pa.array([r.tobytes() for r in document_vectors(data, offsets, held.value)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), rows], ["quality", "x"])

    labelled = texts.join(F.broadcast(known), "doc_id").select("quality", "text")  # FIT_ROWS rows at most
    found = labelled.mapInArrow(features, "quality int, x binary").collect()
    y = np.array([r.quality for r in found], float)
    x = np.array([np.frombuffer(r.x, np.float32) for r in found]).reshape(len(y), 2 * DIMENSIONS + 5)
    order = np.lexsort(x.T[::-1]) if len(y) else []  # the same fit for any order of the rows
    x, y = x[order], y[order]
    mean = float(y.mean()) if len(y) else 0.5
    network = Network(x, y) if len(set(y.tolist())) == 2 else None

    def score(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0)]
        for at, to, data, offsets in text_blocks(texts):
            rows = network.score(document_vectors(data, offsets, held.value)) if network else np.full(to - at, mean)
            parts.append(rows)
        return pa.array(np.concatenate(parts))

    return F.arrow_udf(score, "double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Every row of ``docs(doc_id, text)``: ``doc_id, held_out, score, predicted``, learned as :func:`fit_scorer` says.

    NULL or empty text is a document without pieces and is scored as such. Other columns are never read.
    """
    scored = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), fit_scorer(docs, labels)("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
