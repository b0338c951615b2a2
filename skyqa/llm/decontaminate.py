"""Benchmark passages in documents by greedy string tiling.

Words are compared in lower case without signs. Runs of ``seed`` words that documents and items share are
joined; each (document, item) pair that shares one is tiled: the longest common run of unmarked words
is marked in both, again and again, found by running hashes. Tiles never overlap, so the share
of an item's words under tiles also tells when its passages stand in another order. Of a document only words in seeds are
kept and sent; a row of other words is one stop.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyqa.functions.frames import scratch_path
from skyqa.llm.words import PLAIN, as_long, find_words, grams, list_array, same_text, text_blocks

#: Words of a seed, which is also the shortest tile; share of an item's words that makes a document contaminated.
SEED, COVERAGE = 5, 0.6
#: Bits of the filter that keeps seeds of no item from being joined. Its size does not depend on the items.
_FILTER_BITS = 24


def tile(doc: np.ndarray, item: np.ndarray, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(place in doc, place in item, length)`` of two hash sequences, strictly longest first.

    Of equally long matches the one first in ``doc``, then first in ``item``, is marked first. 0 is no word and ends
    every match. Whether any free run of a length is common to both is told by running hashes, so the greatest such
    length is found by halving; all its matches are marked, and the search goes on below it. Matches of one length are
    taken place by place and never listed as pairs: many equal words cost no more than many different ones.
    """
    shortest = max(1, shortest)
    if min(len(doc), len(item)) < shortest:
        return []
    known, b = np.unique(item, return_inverse=True)
    near = np.minimum(np.searchsorted(known, doc), len(known) - 1)
    a = np.where((known[near] == doc) & (doc != 0), near + 1, 0)
    b = np.where(item != 0, b + 1, 0)
    live_a, live_b = _seeded(a, b, shortest)
    kept = np.flatnonzero(live_a | np.concatenate([[False], live_a[:-1]]))  # runs of other words are one stop
    a, free_a = a[kept], live_a[kept]
    runs_a, runs_b = _Runs(a, max(len(a), len(b))), _Runs(b, max(len(a), len(b)))
    taken = bytearray((~live_b).astype(np.uint8).tobytes())
    tiles: list[tuple[int, int, int]] = []
    limit = len(item)
    while True:
        runs_a.free(free_a)
        runs_b.free(np.frombuffer(taken, np.uint8) == 0)
        limit = min(limit, runs_a.longest, runs_b.longest)
        found = _longest(runs_a, runs_b, shortest, limit)
        if found is None:
            return tiles
        length, starts, places = found
        stop = 0
        for at, key in starts:
            left = places[key]
            while left and (taken[left[-1]] or taken[left[-1] + length - 1]):
                left.pop()
            if at < stop or not left:
                continue
            to = left[-1]
            if not np.array_equal(a[at : at + length], b[to : to + length]):  # equal hashes of different runs
                continue
            stop = at + length
            free_a[at:stop] = False
            taken[to : to + length] = b"\1" * length
            tiles.append((int(kept[at]), to, length))
        limit = length - 1


#: Primes and bases of the running hash; both together tell runs apart by 62 bits.
_RUNNING = ((2147483647, 1103515245), (2147483629, 69069))


@lru_cache(maxsize=64)
def _powers(prime: int, base: int, bits: int) -> np.ndarray:
    power = np.ones(1, np.uint64)
    for _ in range(bits):
        power = np.concatenate([power, power * (power[-1] * np.uint64(base) % np.uint64(prime)) % np.uint64(prime)])
    return power


class _Runs:
    """Running hashes of a sequence of small numbers: that of any run is a difference of two sums, shifted to one power."""

    def __init__(self, values: np.ndarray, size: int):
        self.size, self.parts = size, []
        for prime, base in _RUNNING:
            power = _powers(prime, base, max(10, size.bit_length()))
            each = values.astype(np.uint64) * power[: len(values)] % np.uint64(prime)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each) % np.uint64(prime)])
            self.parts.append((np.uint64(prime), power, sums))

    def free(self, free: np.ndarray) -> None:
        """Only runs of free places count from now on."""
        n = len(free)
        ends = np.where(free, n, np.arange(n))
        self.room = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)
        self.longest = int(self.room.max(initial=0))

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where free runs of the length start, and their hashes."""
        at = np.flatnonzero(self.room >= length)
        out = np.zeros(len(at), np.uint64)
        for prime, power, sums in self.parts:
            own = (sums[at + length] + prime - sums[at]) % prime * power[self.size - at] % prime
            out = out << np.uint64(31) | own
        return at, out


def _longest(a: _Runs, b: _Runs, low: int, high: int):
    """The greatest length from ``low`` to ``high`` of a common free run, where its runs start in ``a`` (with a key), and where in ``b`` by key."""

    def common(length: int):
        (at, own), (to, other) = a.of(length), b.of(length)
        hit = np.isin(own, other)
        return (length, at[hit], own[hit], to, other) if hit.any() else None

    best = None
    if low <= high:
        best = common(high)  # a whole passage, most often
        high -= 1
    if best is None:
        while low <= high:
            middle = (low + high + 1) // 2
            found = common(middle)
            if found is None:
                high = middle - 1
            else:
                best, low = found, middle + 1
    if best is None:
        return None
    length, at, own, to, other = best
    hit = np.isin(other, own)
    places: dict[int, list[int]] = {}
    for place, key in zip(to[hit][::-1].tolist(), other[hit][::-1].tolist(), strict=True):
        places.setdefault(key, []).append(place)
    return length, list(zip(at.tolist(), own.tolist(), strict=True)), places


def _seeded(a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places lie in a run of ``length`` words that both sequences hold. No other place can be part of a match."""
    size = max(len(a), len(b))
    runs = []
    for values in (a, b):
        own = _Runs(values, size)
        own.free(values != 0)
        runs.append(own.of(length))
    out = []
    for values, (at, own), (_, other) in ((a, *runs), (b, *runs[::-1])):
        out.append(_covered(at[np.isin(own, other)], length, len(values)))
    return out[0], out[1]


def _covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``length`` from one of the places ``at``."""
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _item_seeds(items: DataFrame, seed: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_blocks(batch.column(1)):
                words = find_words(data, offsets, PLAIN, lower=True)
                held = [as_long(words.hash[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                seeds = [np.unique(as_long(grams(h.view(np.uint64), min(seed, len(h))))) if len(h) else h for h in held]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array([h.tobytes() for h in held], pa.binary()),
                        list_array(np.concatenate([np.zeros(0, np.int64), *seeds]), np.array([len(s) for s in seeds])),
                        pa.array([min(seed, len(h)) for h in held], pa.int32()),
                    ],
                    ["item_id", "item_words", "seeds", "size"],
                )

    rows = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    return rows.mapInArrow(cut, "item_id long, item_words binary, seeds array<long>, size int")


def coverage(docs: DataFrame, items: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, item_id, covered`` (share of the item's words under tiles) of every pair that shares a seed.

    An item of fewer than ``seed`` words is sought as a whole. Documents and items without words, with NULL text or
    NULL id share nothing. Repeated rows of one id count as one pair with the largest share.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "items")
    _item_seeds(items, seed).write.parquet(path)
    held_items = spark.read.parquet(path)
    sizes = [r[0] for r in held_items.where("size > 0").select("size").distinct().collect()]  # at most `seed` rows
    seeds = held_items.select("item_id", F.explode("seeds").alias("seed"))
    mask = (1 << _FILTER_BITS) - 1
    words = (
        seeds.select((F.col("seed").bitwiseAND(F.lit(mask))).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    )
    table = np.zeros((mask + 1) >> 6, np.int64)
    for r in words.collect():  # never more than 2**18 rows
        table[r.word] = r.bits
    held = spark.sparkContext.broadcast(table.view(np.uint64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for at, _, data, offsets in text_blocks(batch.column(1)):
                words = find_words(data, offsets, PLAIN, lower=True)
                seeds, docs_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                owner, inside = words.doc, np.zeros(len(words.hash), bool)
                for k in sizes:
                    g = grams(words.hash, k)
                    low = g & np.uint64(mask)
                    hit = (bits[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)
                    hit &= same_text(words, k)
                    inside |= _covered(np.flatnonzero(hit), k, len(inside))
                    seeds.append(as_long(g[hit]))
                    docs_of.append(owner[: len(g)][hit])
                seed_of, doc_of = np.concatenate(seeds), np.concatenate(docs_of)
                order = np.lexsort((seed_of, doc_of))
                seed_of, doc_of = seed_of[order], doc_of[order]
                new = np.ones(len(order), bool)
                new[1:] = (seed_of[1:] != seed_of[:-1]) | (doc_of[1:] != doc_of[:-1])
                seed_of, doc_of = seed_of[new], doc_of[new]
                which, count = np.unique(doc_of, return_counts=True)
                stop = ~inside
                stop[1:] &= inside[:-1]
                held_words, keep = np.where(inside, words.hash, np.uint64(0)), np.flatnonzero(inside | stop)
                held_words, first = held_words[keep], np.searchsorted(keep, words.first)
                text = [held_words[first[d] : first[d + 1]].tobytes() for d in which.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + which)), pa.array(text, pa.binary()), list_array(seed_of, count)],
                    ["doc_id", "doc_words", "seeds"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    hits = scratch_path(spark, "seeded")
    rows.mapInArrow(find, "doc_id long, doc_words binary, seeds array<long>").withColumn(
        "row", F.monotonically_increasing_id()
    ).write.parquet(hits)
    hits = spark.read.parquet(hits)
    pairs = (
        hits.select("row", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .select("row", "item_id")
        .distinct()
    )
    joined = pairs.join(hits.select("row", "doc_id", "doc_words"), "row").join(
        held_items.select("item_id", "item_words"), "item_id"
    )

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for d, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                doc, item = np.frombuffer(d, np.uint64), np.frombuffer(w, np.uint64)
                share.append(sum(n for _, _, n in tile(doc, item, min(seed, len(item)))) / len(item))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], ["doc_id", "item_id", "covered"])

    found = joined.select("doc_id", "item_id", "doc_words", "item_words").mapInArrow(
        tiles, "doc_id long, item_id long, covered double"
    )
    return found.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """``doc_id, n_items, item_id, covered, contaminated`` of every row of ``docs``.

    ``n_items`` counts items covered to ``threshold`` at least, ``item_id`` is the most covered item (ties: the
    smaller id) and NULL if no seed is shared. Defined as :func:`coverage` says.
    """
    best = (
        coverage(docs, items, seed)
        .groupBy("doc_id")
        .agg(
            F.sum((F.col("covered") >= threshold).cast("long")).alias("n_items"),
            F.max(F.struct("covered", (-F.col("item_id")).alias("low"))).alias("top"),
        )
    )
    return (
        docs.select(F.col("doc_id").cast("long"))
        .join(best, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            (-F.col("top.low")).alias("item_id"),
            F.coalesce("top.covered", F.lit(0.0)).alias("covered"),
            (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"),
        )
    )
