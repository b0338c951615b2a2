"""Packing documents into training sequences of a fixed number of tokens.

Linear grouping: large lengths are sorted, cut into groups of equal cardinality and rounded up to the largest of
their group, which leaves few sizes. Configurations of these sizes (what one sequence holds) are optimised by column
generation. The actual documents then take the places of their group, and the small ones, and what
rounding down left over, are put by best fit into the room that is really left.

All of this works on the histogram of lengths, which has at most as many rows as a sequence has tokens, whatever the size
of the corpus. Its result is a plan in runs of equal sequences; documents find their place from
their rank among those of the same length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyqa.functions.frames import scratch_path
from skyqa.llm.tokens import Tokens

#: Tokens of a sequence.
CAPACITY = 4096
#: Settings of the plan that are tried: number of groups, and the largest length that counts as small.
GROUPS, SMALL = (24, 40), (640, 1024)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of ``docs(doc_id, text)``: a document longer than ``capacity`` is cut, no other is.

    NULL or empty text is the end id alone. Rows that repeat a ``doc_id`` each give their pieces. ``nth`` counts
    the pieces of one length within a task (``part``).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = Tokens(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tail = np.array([end_id], "<u4")
        for batch in batches:
            keys = batch.column(0)
            for at, to, ids, sizes in tokens.blocks(batch.column(1)):
                ids = ids.astype("<u4")
                full = sizes + 1
                count = -(-full // capacity)
                owner = np.repeat(np.arange(to - at), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(full[owner] - start, capacity)
                begin = (np.cumsum(sizes) - sizes)[owner] + start
                last = start + length == full[owner]
                crc = np.empty(len(owner), np.int64)
                for i in range(len(owner)):
                    c = zlib.crc32(ids[begin[i] : begin[i] + length[i] - last[i]])
                    crc[i] = zlib.crc32(tail, c) if last[i] else c
                order = np.argsort(length, kind="stable")
                grouped = length[order]
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.searchsorted(grouped, grouped) + seen[grouped]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(at, to - at).cast(pa.int64()).take(pa.array(owner)),
                        *map(pa.array, (piece.astype(np.int32), start, length, crc)),
                        pa.array(np.full(len(owner), part, np.int32)),
                        pa.array(nth),
                    ],
                    [c.split()[0] for c in _PIECES.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece of ``docs``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    The pieces are written once to the shared scratch folder, since their order within a task must hold.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    cut_pieces(docs, tokenizer, end_id, capacity).write.parquet(path)
    pieces = spark.read.schema(_PIECES).parquet(path)
    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = sizes.groupBy("length").agg(F.sum("n").alias("n"))  # at most `capacity` rows
    plan = make_plan({r.length: r.n for r in histogram.collect()}, capacity)
    up_to = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            row = plan[np.searchsorted(key, length << 44 | rank, "right") - 1] if len(plan) else plan[:0]
            sequence = row[:, 2] + rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(row[:, 3])], [*columns, "sequence_id", "offset"]
            )

    return ranked.select(*columns, "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


class _Run:
    """Equal sequences: ``count`` of them, each with ``items`` (lengths in order)."""

    __slots__ = ("items", "count", "room")

    def __init__(self, items: tuple[int, ...], count: int, room: int):
        self.items, self.count, self.room = items, count, room


def make_plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows ``length, first rank, sequence of that rank, offset``, sorted; the shortest plan of the settings."""
    if not histogram:
        return np.zeros((0, 4), np.int64)
    tried = [_runs(histogram, capacity, k, s * capacity // CAPACITY) for k in GROUPS for s in SMALL]
    runs = min(tried, key=lambda runs: sum(r.count for r in runs))
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length in run.items:
            rows.append((length, used[length], sequence, offset))
            used[length] += run.count
            offset += length
        sequence += run.count
    return np.array(sorted(rows), np.int64)


def _runs(histogram: Mapping[int, int], capacity: int, groups: int, small: int) -> list[_Run]:
    left = {n: c for n, c in histogram.items() if c}
    runs = [_Run((capacity,), left.pop(capacity), 0)] if capacity in left else []
    large = sorted((n for n in left if n > small), reverse=True)
    if large:
        for group_items, count in _configure(large, left, capacity, groups):
            runs += _substitute(group_items, count, capacity)
        for run in runs:
            for n in run.items:
                if n in left:
                    left[n] -= run.count
    return _best_fit(runs, {n: c for n, c in left.items() if c}, capacity)


def _configure(large, left, capacity, groups):
    """Groups of near-equal cardinality, their configurations, and which lengths fill the places.

    Gives ``(one list of (length, count) for each place of the configuration, number of sequences)``.
    """
    total = sum(left[n] for n in large)
    target = max(1, -(-total // groups))
    members: list[list[list[int]]] = [[]]
    held = 0
    for n in large:  # descending; a length goes to one group as a whole unless it is larger than a group
        if held >= target:
            members.append([])
            held = 0
        members[-1].append([n, left[n]])
        held += left[n]
    sizes = np.array([m[0][0] for m in members])
    need = np.array([sum(c for _, c in m) for m in members], float)
    patterns, amount = _column_generation(sizes, need, capacity)
    spare = need.astype(np.int64)
    for p in np.argsort(-amount):
        count = int(amount[p] + 1e-9)
        used = patterns[:, p]
        if used.any():
            count = min(count, *(int(spare[g] // used[g]) for g in np.flatnonzero(used)))
        if count <= 0 or not used.any():
            continue
        spare -= used * count
        places = []
        for g in np.flatnonzero(used):
            for _ in range(used[g]):
                places.append(_take(members[g], count))
        yield places, count


def _take(member: list[list[int]], count: int) -> list[tuple[int, int]]:
    """The next ``count`` items of a group, largest first, as ``(length, count)``."""
    out = []
    while count:
        k = min(count, member[0][1])
        out.append((member[0][0], k))
        member[0][1] -= k
        count -= k
        if not member[0][1]:
            member.pop(0)
    return out


def _substitute(places, count, capacity) -> list[_Run]:
    """Runs of sequences with the actual lengths in the places of one configuration."""
    cuts = sorted({0, count, *(int(c) for p in places for c in np.cumsum([k for _, k in p]))})
    runs, at = [], [(0, 0) for _ in places]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        items = []
        for i, place in enumerate(places):
            j, end = at[i]
            if end <= a:
                end += place[j][1]
                at[i] = (j + 1, end)
                j += 1
            else:
                j = at[i][0]
            items.append(place[j - 1][0])
        runs.append(_Run(tuple(items), b - a, capacity - sum(items)))
    return runs


def _column_generation(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns: places for each size) and how often each is used, by the simplex method.

    Starts with sequences of one size; a knapsack over the token counts finds the configuration that the current
    prices make most worthwhile, until none is worth more than a sequence.
    """
    k = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    amount = need / np.diag(basis)
    for _ in range(12 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        column, worth = _knapsack(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, need), 0)
    return basis.round().astype(np.int64), amount


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The worthiest configuration, by rounds that each allow one more place."""
    best, took = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        value, last = best.copy(), np.full(capacity + 1, -1)
        for j, (size, worth) in enumerate(zip(sizes.tolist(), price.tolist(), strict=True)):
            with_it = best[: capacity + 1 - size] + worth
            better = with_it > value[size:] + 1e-12
            value[size:][better] = with_it[better]
            last[size:][better] = j
        if (last < 0).all():
            break
        best = value
        took.append(last)
    column, c = np.zeros(len(sizes)), capacity
    for last in reversed(took):
        if last[c] >= 0:
            column[last[c]] += 1
            c -= sizes[last[c]]
    return column, float(best[capacity])


def _best_fit(runs: list[_Run], left: Mapping[int, int], capacity: int) -> list[_Run]:
    """Put the remaining lengths, largest first, where the least room is left that suffices."""
    by_room: dict[int, list[_Run]] = defaultdict(list)
    for run in runs:
        by_room[run.room].append(run)
    rooms = sorted(by_room)

    def add(run: _Run) -> None:
        if not by_room[run.room]:
            at = bisect.bisect_left(rooms, run.room)
            if at == len(rooms) or rooms[at] != run.room:
                rooms.insert(at, run.room)
        by_room[run.room].append(run)

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(rooms, n)
            while at < len(rooms) and not by_room[rooms[at]]:
                rooms.pop(at)
            if at == len(rooms):
                each = capacity // n
                whole, rest = divmod(count, each)
                if whole:
                    add(_Run((n,) * each, whole, capacity - n * each))
                if rest:
                    add(_Run((n,) * rest, 1, capacity - n * rest))
                break
            run = by_room[rooms[at]].pop()
            k = min(count, run.count)
            if k < run.count:
                by_room[rooms[at]].append(_Run(run.items, run.count - k, run.room))
            add(_Run((*run.items, n), k, run.room - n))
            count -= k
    return [run for group in by_room.values() for run in group]
