"""Nearest neighbours by cosine: randomly rotated one-bit codes choose what is compared exactly.

A unit vector is rotated and kept as the signs of its components. The product of these signs with a rotated query,
divided by the product of the vector with its own code, estimates their cosine without bias; how far the estimate
can be off follows from how well the code fits. Queries are held with four bits a component, so the estimate is four
counts of common bits. Only vectors whose upper bound reaches a query's current last place are compared
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries. Every block of queries meets every block of candidates.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Standard errors that an estimate may be off before its vector is missed.
WIDTH = 3.0
_QUERY_BITS = 4

_RESULT = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL or empty, finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to each row where ``is_query``: ``query_id, rank, vec_id, score``.

    Ties go to the smaller id. Vectors that are not :func:`usable` or have no id take no part; only vectors of the same
    number of components are compared. Rows that repeat an id are one vector (the smallest). With fewer than ``k``
    candidates all are returned. Vectors of double components are compared as they are, also those too large for single precision. Every row is a candidate: blocks are scanned whole, and a block of
    queries keeps only its best ``k`` in each task.
    """
    single = vectors.schema[column].dataType.elementType.typeName() == "float"
    kind, element = ("<f4", "float") if single else ("<f8", "double")  # as exact as the given components
    held = (
        vectors.where(F.col(id_column).isNotNull() & usable(F.col(column)))
        .withColumn("__query", F.coalesce(is_query, F.lit(False)))
        .select(F.col(id_column).cast("long").alias("id"), F.col(column).cast(f"array<{element}>").alias("v"), "__query")
        .groupBy("id")
        .agg(F.min("v").alias("v"), F.max("__query").alias("__query"))
        .select("id", "v", F.size("v").alias("d"), "__query")
    )
    asked = held.where("__query")
    total = asked.groupBy("d").count()
    blocks = total.select("d", F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("n"))
    packed = (
        asked.join(F.broadcast(blocks), "d")  # one row for each number of components
        .withColumn("q", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
        .groupBy("d", "q")
        .applyInArrow(lambda table: _pack_queries(table, kind), "d int, q int, ids binary, vecs binary")
    )
    codes = held.select("id", "v", "d").mapInArrow(lambda batches: _encode(batches, kind), "d int, ids binary, vecs binary, codes binary, fits binary")
    spread = codes.join(F.broadcast(blocks), "d").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    found = (
        spread.drop("n")
        .join(packed.withColumnsRenamed({"ids": "query_ids", "vecs": "query_vecs"}), ["d", "q"])
        .select("d", "q", "ids", "vecs", "codes", "fits", "query_ids", "query_vecs")
        .mapInArrow(lambda batches: _search(batches, k, kind), _RESULT)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of ``d`` components, padded with zeros to whole 64-bit words."""
    wide = -(-d // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:d]


def _matrix(lists: pa.Array, d: int, kind: str) -> np.ndarray:
    return np.asarray(lists.flatten(), kind).reshape(-1, d)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # keeps squares of tiny or huge components in range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits in 64-bit words, and the product of each unit vector with its code."""
    turned = _unit(v) @ turn
    bits = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
    return bits, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])


def _pack_queries(table: pa.Table, kind: str) -> pa.Table:
    d, q = table["d"][0].as_py(), table["q"][0].as_py()
    ids = np.asarray(table["id"]).astype("<i8")
    vecs = _matrix(table["v"].combine_chunks(), d, kind)
    return pa.table({"d": pa.array([d], pa.int32()), "q": pa.array([q], pa.int32()), "ids": [ids.tobytes()], "vecs": [vecs.tobytes()]})


def _encode(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch.column(2))
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            for at in range(0, len(rows), BLOCK):
                part = batch.take(pa.array(rows[at : at + BLOCK]))
                vecs = _matrix(part.column(1), d, kind)
                if d not in turns:
                    turns[d] = rotation(d)
                bits, fit = encode(vecs, turns[d])
                held = (np.asarray(part.column(0)).astype("<i8"), vecs, bits, fit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in held)],
                    ["d", "ids", "vecs", "codes", "fits"],
                )


def estimate(queries: np.ndarray, bits: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of rotated unit ``queries`` with coded vectors, and their error bounds."""
    wide = queries.shape[1]
    low = queries.min(axis=1, keepdims=True)
    step = np.maximum((queries.max(axis=1, keepdims=True) - low) / (2**_QUERY_BITS - 1), 1e-12)
    level = np.rint((queries - low) / step).astype(np.uint8)
    rounding = np.abs(low + level * step - queries).sum(axis=1, keepdims=True) / np.sqrt(wide)
    common = np.zeros((len(queries), len(bits)), np.int32)
    for b in range(_QUERY_BITS):
        plane = np.packbits(level >> b & 1, axis=1, bitorder="little").view("<u8")
        for w in range(bits.shape[1]):
            common += np.bitwise_count(plane[:, w, None] & bits[None, :, w]).astype(np.int32) << b
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    whole = low * wide + step * level.sum(axis=1, keepdims=True, dtype=np.int64)  # sum of the held components
    product = (2 * (low * ones + step * common) - whole) / np.sqrt(wide)
    error = WIDTH * np.sqrt(np.maximum(0, 1 - fit * fit)) / np.sqrt(max(1, wide - 1))
    return product / fit, (error + rounding) / fit


def _search(batches: Iterator[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    state: dict[tuple[int, int], tuple] = {}
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["d"], row["q"])
            if key not in state:
                if len(state) >= 16:
                    yield from _found(state)
                    state.clear()
                if row["d"] not in turns:
                    turns[row["d"]] = rotation(row["d"])
                state[key] = _start(row, k, turns[row["d"]], kind)
            _scan_block(state[key], row, k, kind)
    yield from _found(state)


def _start(row: dict, k: int, turn: np.ndarray, kind: str) -> tuple:
    ids = np.frombuffer(row["query_ids"], "<i8")
    unit = _unit(np.frombuffer(row["query_vecs"], kind).reshape(-1, row["d"]))
    n = len(ids)
    return ids, unit, unit @ turn, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)


def _scan_block(state: tuple, row: dict, k: int, kind: str) -> None:
    query_ids, unit, turned, best, best_ids = state
    ids = np.frombuffer(row["ids"], "<i8")
    vecs = _unit(np.frombuffer(row["vecs"], kind).reshape(-1, row["d"]))
    bits = np.frombuffer(row["codes"], "<u8").reshape(len(ids), -1)
    fit = np.frombuffer(row["fits"], "<f8")
    for at in range(0, len(query_ids), 64):
        own = slice(at, at + 64)
        guess, error = estimate(turned[own], bits, fit)
        for i in range(len(guess)):
            q = at + i
            last = best[q, -1]
            if last == -np.inf and len(ids) > 4 * k:  # nothing yet: the best lower bounds give the first limit
                last = np.partition(guess[i] - error[i], len(ids) - k - 1)[len(ids) - k - 1]
            near = np.flatnonzero(guess[i] + error[i] >= last)
            near = near[ids[near] != query_ids[q]]
            if not len(near):
                continue
            score = np.concatenate([best[q], (vecs[near] * unit[q]).sum(axis=1)])
            which = np.concatenate([best_ids[q], ids[near]])
            order = np.lexsort((which, -score))[:k]
            best[q], best_ids[q] = score[order], which[order]


def _found(state: dict) -> Iterator[pa.RecordBatch]:
    for ids, _, _, best, best_ids in state.values():
        full = best > -np.inf
        rows = np.repeat(ids, full.sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(best_ids[full]), pa.array(best[full])], ["query_id", "vec_id", "score"]
        )
