"""Source divergence audit: how the terms of each source differ from other sources and from its whole language.

Terms are counted inside the tasks. A term of up to 8 bytes is one 64-bit word, one of up to 16 bytes two; these are
brought into order by a radix sort of 16-bit digits and counted as runs. Longer terms are sorted by their bytes, one bucket
for each length. Spark adds up what the tasks found; all arithmetic on the counts is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyqa.functions.frames import broadcast_if_small, cut
from skyqa.llm.tables import written
from skyqa.llm.words import text_blocks

#: Documents of a language that must hold a term, added occurrences of each term, and terms reported of each source.
MIN_DOCS, SMOOTHING, TOP = 30, 5, 50
#: Counted terms a task holds before it hands them on.
HELD_TERMS = 1 << 19
#: Terms of a slice and sources of a tile: what one step of the comparison of all pairs of sources holds.
SLICE_TERMS, TILE_SOURCES = 2048, 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

COUNTED = "lang string, source string, term string, n long, docs long"
_COMPARED = "lang string, a int, b int, part long"


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order by ``words`` (unsigned, the first one counts most): a radix sort of 16-bit digits, least first."""
    order: np.ndarray | None = None
    for word in reversed(words):
        for shift in range(0, 8 * word.dtype.itemsize, 16):
            digit = (word >> word.dtype.type(shift)).astype(np.uint16)
            if not len(digit) or digit.min() == digit.max():
                continue
            if order is None:
                order = np.argsort(digit, kind="stable")  # numpy sorts 16-bit values by radix
            else:
                order = order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(words[0])) if order is None else order


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new combination of values begins in ordered columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = columns[0][1:] != columns[0][:-1]
        for column in columns[1:]:
            new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def find_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every term ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a block of texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _count(words: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(*words, group, occurrences, documents)`` of each term and group; ``doc`` ascends."""
    order = radix_order([*words, group])
    words, group, doc = [w[order] for w in words], group[order], doc[order]
    first = run_starts([*words, group])
    if not len(first):
        return (*words, group, np.zeros(0, np.int64), np.zeros(0, np.int64))
    another = np.zeros(len(doc), np.int64)
    another[1:] = doc[1:] != doc[:-1]
    another[first] = 1
    return (*(w[first] for w in words), group[first], np.diff(first, append=len(doc)), np.add.reduceat(another, first))


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Several results of :func:`_count` as one."""
    *words, n, docs = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = radix_order(words)
    words = [w[order] for w in words]
    first = run_starts(words)
    if not len(first):
        return (*words, n, docs)
    return (*(w[first] for w in words), np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first))


def count_block(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[list, list, list]:
    """Terms of one word, of two words (both as of :func:`_count`) and long ones (``[terms, group, n, docs]`` by length)."""
    data = _LOWER[data]
    start, end, doc = find_terms(data, offsets)
    size, group = end - start, group[doc]
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), ">u8", padded, strides=(1,))

    def word(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        empty = np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)
        return eight[at].astype(np.uint64) >> empty << empty  # terms hold no zero byte, so zeros mark their end

    one = np.flatnonzero(size <= 8)
    two = np.flatnonzero((size > 8) & (size <= 16))
    found_one = _count([word(start[one], size[one])], group[one], doc[one])
    found_two = _count([word(start[two], size[two]), word(start[two] + 8, size[two] - 8)], group[two], doc[two])
    found_long = []
    long = np.flatnonzero(size > 16)
    for length in np.unique(size[long]).tolist():
        own = long[size[long] == length]
        terms = np.empty(len(own), f"S{length}")
        for i, at in enumerate(start[own].tolist()):
            terms[i] = data[at : at + length].tobytes()
        order = radix_order([group[own]])
        order = order[np.argsort(terms[order], kind="stable")]
        terms, owners, docs = terms[order], group[own][order], doc[own][order]
        first = run_starts([terms, owners])
        another = np.ones(len(docs), np.int64)
        another[1:] = docs[1:] != docs[:-1]
        another[first] = 1
        found_long.append((terms[first], owners[first], np.diff(first, append=len(docs)), np.add.reduceat(another, first)))
    return [found_one], [found_two], found_long


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], int] = {}
    one: list = []
    two: list = []
    rows = 0
    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        codes = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.uint32)
        for at, to, data, offsets in text_blocks(batch.column(2)):
            found_one, found_two, found_long = count_block(data, offsets, codes[at:to])
            one, two = one + found_one, two + found_two
            rows += len(found_one[0][0]) + len(found_two[0][0])
            for terms, *rest in found_long:
                yield from _rows(list(groups), terms.tolist(), *rest)
            if rows > 2 * HELD_TERMS:
                one, two = [_merge(one)], [_merge(two)]
                rows = len(one[0][0]) + len(two[0][0])
                if rows > HELD_TERMS:
                    yield from _short(list(groups), one, two)
                    one, two, rows = [], [], 0
    if one:
        yield from _short(list(groups), [_merge(one)], [_merge(two)])


def _short(groups: list, one: list, two: list) -> Iterator[pa.RecordBatch]:
    for part in (*one, *two):
        *words, group, n, docs = part
        packed = np.stack(words, axis=1).astype(">u8")
        for at in range(0, len(n), 1 << 16):
            own = slice(at, at + (1 << 16))
            terms = np.ascontiguousarray(packed[own]).view(f"S{8 * len(words)}")[:, 0]
            yield from _rows(groups, terms.tolist(), group[own], n[own], docs[own])


def _rows(groups: list, terms: list[bytes], group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(terms):
        which = pa.array(group, pa.int32())
        names = [pa.array([g[i] for g in groups], pa.string()).take(which) for i in (0, 1)]
        found = pa.array(terms, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*names, found, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def share(count: str, total: str) -> Column:
    """``floor(10^9 * count / total)`` of SQL expressions with ``0 <= count <= total``, exact below 9 * 10^15.

    Long division, three digits at a time, so that nothing leaves 64 bits.
    """
    rest, out = f"({count}) % ({total})", f"({count}) div ({total})"
    for _ in range(3):
        out = f"({out}) * 1000L + (({rest}) * 1000L) div ({total})"
        rest = f"(({rest}) * 1000L) % ({total})"
    return F.expr(f"case when ({total}) > 0 then {out} end")


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """:func:`share` of arrays."""
    out, rest = count // total, count % total
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out


def count_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, all_n, tid, is_first``: occurrences of each kept term in each source that holds it.

    Kept is a term that occurs in ``min_docs`` rows of its language. ``all_n`` counts it in the whole language, ``tid`` numbers terms of a
    language, ``is_first`` marks one row of each. ``docs(lang, source, text)`` holds no NULL. What the tasks counted is dealt by
    language and term once; the sums by source, by language and the numbering need no further exchange.
    """
    counted = docs.select("lang", "source", "text").mapInArrow(_count_batches, COUNTED).repartition("lang", "term")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    numbered = summed.withColumn("id", F.monotonically_increasing_id())
    held = numbered.select(
        "lang", "source", "term", "n", "id",
        F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("all_n"), F.min("id").over(term).alias("tid"),
    )
    return held.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "all_n", "tid", (F.col("id") == F.col("tid")).alias("is_first"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets each source of ``docs(text, lang, source)`` apart.

    Each (lang, source) gives a kept term the share ``p = 1 + floor(10^9 (count + s) / (N + s V))`` with N its occurrences of all V kept terms of
    the language and ``s = smoothing``; a language does the same. Part ``pair``: the other sources of the language by the sum
    of absolute differences over all kept terms. Part ``term``: the ``top`` terms of a source whose share exceeds the
    language's. Ranks go by descending value, then by the bytes of the item.

    NULL text, lang and source count as ''. Repeated rows count each. A source without terms has pairs and no terms; a
    language without kept terms has pairs of value 0. An empty table gives no rows. Other columns are ignored.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    cells = written(count_terms(named, min_docs), "term-counts")
    info = cut(_sources(named, cells))
    placed = cells.join(broadcast_if_small(info), ["lang", "source"])
    terms = _terms(placed, smoothing, top)
    pairs = _pairs(placed, info, smoothing)
    return terms.unionByName(pairs)


def _sources(named: DataFrame, cells: DataFrame) -> DataFrame:
    """``lang, source, n_source, n_lang, v, idx`` of every source; ``idx`` numbers those of a language from 0."""
    by_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    by_lang = cells.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("is_first").alias("v"))
    found = named.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    order = Window.partitionBy("lang").orderBy("source")
    return found.na.fill(0, ["n_source", "n_lang", "v"]).withColumn("idx", F.row_number().over(order) - 1)


def _terms(placed: DataFrame, s: int, top: int) -> DataFrame:
    own, whole = share(f"n + {s}", f"n_source + {s} * v"), share(f"all_n + {s}", f"n_lang + {s} * v")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        placed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (own - whole).alias("value"))
        .where(F.col("value") > 0)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )


def _pairs(placed: DataFrame, info: DataFrame, s: int) -> DataFrame:
    """All pairs of sources of a language, compared slice of terms by slice of terms and tile of sources by tile.

    Terms that neither source holds add the same to every pair: ``V`` times the difference of both shares of count 0. The slices
    add what the terms held by either change in that.
    """
    tile = F.floor(F.col("idx") / TILE_SOURCES).cast("int").alias("tile")
    slices = placed.select(
        "lang", tile, F.pmod(F.xxhash64("tid"), F.ceil(F.col("v") / SLICE_TERMS)).alias("slice"), F.struct("tid", "idx", "n").alias("cell")
    )
    packs = slices.groupBy("lang", "slice", "tile").agg(F.collect_list("cell").alias("cells"))  # at most a slice times a tile
    total = F.col("n_source") + s * F.col("v")
    tiles = info.groupBy("lang", tile).agg(F.collect_list(F.struct("idx", total.alias("total"))).alias("sources"))
    grid = packs.select("lang", "slice").distinct().join(tiles, "lang").join(packs, ["lang", "slice", "tile"], "left")
    other = grid.withColumnsRenamed({"tile": "o_tile", "cells": "o_cells", "sources": "o_sources"})
    met = grid.join(other, ["lang", "slice"]).where("tile <= o_tile")
    parts = met.select("lang", "cells", "sources", "o_cells", "o_sources").mapInArrow(lambda batches: _compare(batches, s), _COMPARED)
    changed = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("changed"))

    base = info.select("lang", "source", "idx", "v", F.coalesce(share(str(s), f"n_source + {s} * v"), F.lit(0)).alias("base"))
    against = base.select("lang", F.col("source").alias("item"), F.col("idx").alias("o_idx"), F.col("base").alias("o_base"))
    both = base.join(against, "lang").where("idx <> o_idx")
    both = both.withColumns({"a": F.least("idx", "o_idx"), "b": F.greatest("idx", "o_idx")}).join(changed, ["lang", "a", "b"], "left")
    value = F.col("v") * F.abs(F.col("base") - F.col("o_base")) + F.coalesce("changed", F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))


def _compare(batches: Iterator[pa.RecordBatch], s: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            (ids, base, terms, shares), (o_ids, o_base, o_terms, o_shares) = (_tile(batch, i, at, s) for at in (1, 3))
            every = np.union1d(terms, o_terms)
            rows, o_rows = np.tile(base[:, None], len(every)), np.tile(o_base[:, None], len(every))
            rows[:, np.searchsorted(every, terms)] = shares
            o_rows[:, np.searchsorted(every, o_terms)] = o_shares
            out = []
            for k in range(len(ids)):
                part = np.abs(o_rows - rows[k]).sum(axis=1) - len(every) * np.abs(o_base - base[k])
                after = o_ids > ids[k]
                out.append((np.full(after.sum(), ids[k]), o_ids[after], part[after]))
            a, b, part = (np.concatenate(c) for c in zip(*out, strict=True))
            lang = batch.column(0)[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(part, pa.int64())],
                ["lang", "a", "b", "part"],
            )


def _tile(batch: pa.RecordBatch, i: int, at: int, s: int) -> tuple[np.ndarray, ...]:
    """Numbers of a tile's sources, their share of count 0, the terms they hold and all shares of these."""
    sources = batch.column(at + 1)[i].values
    ids, total = (np.asarray(sources.field(k), np.int64) for k in (0, 1))
    order = np.argsort(ids)
    ids, total = ids[order], total[order]
    cells = batch.column(at)[i].values
    if cells is None or not len(cells):
        cells = pa.array([], pa.struct([("tid", pa.int64()), ("idx", pa.int32()), ("n", pa.int64())]))
    tid, idx, n = (np.asarray(cells.field(k), np.int64) for k in (0, 1, 2))
    terms, column = np.unique(tid, return_inverse=True)
    count = np.zeros((len(ids), len(terms)), np.int64)
    count[np.searchsorted(ids, idx), column] = n
    return ids, _share(np.full(len(ids), s), total), terms, _share(count + s, total[:, None])
