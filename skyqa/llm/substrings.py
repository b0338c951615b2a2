"""Passages that an earlier document already holds, found with compressed indexes of shards of the corpus.

A document is cut into fragments: runs of consecutive windows (``window`` words each) that have the same anchor, the
smallest hash among the window's short word runs. Equal windows have equal anchors, so a shard of all fragments of an
anchor answers for them. Anchors of one row only are left out. Each shard's distinct fragments are indexed
(:mod:`fm_index`); the fragments are streamed through the index, and backward search gives for each window the smallest
doc_id it starts in. Windows of an earlier document are reported as intervals of words.

An anchor of very many documents (a passage with many surroundings) is dealt by whole windows instead, which are
as many as the distinct windows are, however often they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyqa.llm.fm_index import FMIndex
from skyqa.llm.tables import written
from skyqa.llm.words import SPACED, Words, as_long, find_words, grams, list_array, mix, same_text, text_blocks

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 13, 5
#: Documents from which an anchor is dealt by windows; words of a shard.
COMMON, SHARD_WORDS = 512, 300_000


def _window_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor of every window inside one text."""
    low = mix(grams(words.hash, anchor) ^ np.uint64(0x2545F4914F6CDD1D))
    span, have = window - anchor + 1, 1
    while have < span:  # minimum over spans of doubling width
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    at = np.flatnonzero(same_text(words, window))
    return at, low[at]


def _runs(words: Words, at: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 index (into ``at``) of runs of windows that follow each other with one anchor."""
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at))


def _range_hash(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words in ``first:last``."""
    power = mix(np.arange(int((last - first).max(initial=0)), dtype=np.uint64) + np.uint64(11)) | np.uint64(1)
    size = last - first
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    part = mix(words.hash[first[owner] + inner] * power[inner])
    total = np.concatenate([[np.uint64(0)], np.cumsum(part)])
    edge = np.concatenate([[0], np.cumsum(size)])
    return mix((total[edge[1:]] - total[edge[:-1]]) ^ size.astype(np.uint64))


def _fragments(words: Words, common: list[np.ndarray], kept: list[np.ndarray], window: int, anchor: int):
    """``first word, last word + 1, shard key`` of the fragments whose anchors are in ``kept`` of their text."""
    at, low = _window_anchors(words, window, anchor)
    first, last = _runs(words, at, low)
    text = np.searchsorted(words.first, at[first], "right") - 1 if len(first) else first
    code = as_long(low)[first] if len(first) else np.zeros(0, np.int64)
    a, b, key = [], [], []
    edge = np.searchsorted(text, np.arange(len(words.first)))
    for d in range(len(words.first) - 1):
        own = slice(edge[d], edge[d + 1])
        keep = np.isin(code[own], kept[d])
        wide = keep & np.isin(code[own], common[d])
        one = keep & ~wide
        a.append(at[first[own][one]])
        b.append(at[last[own][one] - 1] + window)
        key.append(code[own][one])
        for i, j in zip(first[own][wide].tolist(), last[own][wide].tolist(), strict=True):
            a.append(at[i:j])
            b.append(at[i:j] + window)
            key.append(np.zeros(j - i, np.int64))
    if not a:
        none = np.zeros(0, np.int64)
        return none, none, none
    a, b, key = np.concatenate(a), np.concatenate(b), np.concatenate(key)
    order = np.argsort(a, kind="stable")
    return a[order], b[order], key[order]


def repeated_intervals(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``row, first, last``: ranges of words (from 0, last excluded) covered by windows of an earlier document.

    ``docs`` has ``row`` (a 64-bit name of the row's id and text), ``doc_id`` and ``text``. A window counts if its
    words, in their order, also start in a document with a smaller doc_id. Rows with NULL id or text have none and
    give none. Intervals may overlap.
    """
    texts = docs.where("doc_id is not null and text is not null").select("row", "doc_id", "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in text_blocks(batch.column(2)):
                words = find_words(data, offsets, SPACED)
                where, low = _window_anchors(words, window, anchor)
                first, _ = _runs(words, where, low)
                code, doc = (as_long(low)[first], words.doc[where[first]]) if len(first) else (first, first)
                order = np.lexsort((code, doc))  # each anchor of a text once
                code, doc = code[order], doc[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[new]), batch.column(0).take(pa.array(at + doc[new]))], ["anchor", "row"]
                )

    seen = texts.mapInArrow(anchors, "anchor long, row long")
    counted = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = written(counted.select("anchor", (F.col("n") >= COMMON).alias("common")), "anchors")
    # per row its repeated anchors: at most as many as it has words
    wanted = seen.select("anchor", "row").join(repeated, "anchor").groupBy("row").agg(
        F.collect_set(F.struct("anchor", "common")).alias("kept")
    )
    wanted = wanted.select(
        "row",
        F.transform("kept", lambda x: x["anchor"]).alias("kept"),
        F.transform(F.filter("kept", lambda x: x["common"]), lambda x: x["anchor"]).alias("common"),
    )
    routed = written(texts.dropDuplicates(["row"]).join(wanted, "row"), "routed")
    routed = routed.select("row", "doc_id", "text", "kept", "common")

    def cut(with_text: bool):
        def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept, common = _arrays(batch.column(3)), _arrays(batch.column(4))
                for at, to, data, offsets in text_blocks(batch.column(2)):
                    words = find_words(data, offsets, SPACED)
                    a, b, key = _fragments(words, common[at:to], kept[at:to], window, anchor)
                    name = as_long(_range_hash(words, a, b))
                    key = np.where(key == 0, name, key)
                    doc = np.searchsorted(words.first, a, "right") - 1
                    owner = pa.array(at + doc)
                    if with_text:
                        held = [data[words.start[i] : words.end[j - 1]].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                        more, names = [pa.array(key), pa.array(held, pa.binary())], ["key", "words"]
                    else:
                        more, names = [batch.column(0).take(owner), pa.array((a - words.first[doc]).astype(np.int32))], ["row", "place"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name), batch.column(1).take(owner), *more], ["name", "doc_id", *names]
                    )

        return fragments

    distinct = routed.mapInArrow(cut(True), "name long, doc_id long, key long, words binary").groupBy("name").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("key").alias("key"), F.min("words").alias("words")
    )
    distinct = written(distinct, "fragments")
    size = distinct.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-size // (6 * SHARD_WORDS)))
    answers = (
        distinct.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "name", "lo", "hi", "words")
        .repartition(int(min(shards, 100_000)), "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(lambda batches: _answer(batches, window), "name long, earliest array<long>")
    )
    found = routed.mapInArrow(cut(False), "name long, doc_id long, row long, place int").join(answers, "name")
    starts = found.select(
        "row", "doc_id", F.posexplode("earliest").alias("i", "lo"), "place"
    ).where("lo < doc_id").select("row", (F.col("place") + F.col("i")).alias("first"))
    return starts.select("row", "first", (F.col("first") + window).alias("last"))


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _answer(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For every fragment the smallest doc_id of each of its windows; rows come by shard."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        shard = np.asarray(batch.column(0))
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if shard[a] != current and held:
                yield from _answer_shard(held, window)
                held = []
            current = shard[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from _answer_shard(held, window)


def _answer_shard(held: list[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    name, lo, hi = (np.asarray(rows[c].combine_chunks()) for c in ("name", "lo", "hi"))
    raw = rows["words"].cast(pa.large_binary()).combine_chunks()
    _, where, data = raw.buffers()
    offsets = np.frombuffer(where, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    words = find_words(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], SPACED)
    distinct, number, often = np.unique(words.hash, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(1, len(distinct) + 1)  # frequent words have short numbers
    symbols = rank[number]
    index = FMIndex(symbols, words.first, window)
    count = np.diff(words.first) - window + 1
    ends = np.repeat(words.first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum())) + window
    earliest = np.repeat(lo, count)
    for at in range(0, len(ends), 1 << 18):
        part = slice(at, at + (1 << 18))
        low, high = index.search(symbols, ends[part], window)
        several = np.flatnonzero(high - low > 1)
        if len(several):
            earliest[at + several] = index.smallest(low[several], high[several], lo)
    # a fragment whose windows are all new to the last document that holds it has nothing to report
    edge = np.concatenate([[0], np.cumsum(count)])
    new = np.minimum.reduceat(earliest, edge[:-1]) >= hi
    keep = np.flatnonzero(~new)
    pick = np.repeat(~new, count)
    yield pa.RecordBatch.from_arrays([pa.array(name[keep]), list_array(earliest[pick], count[keep])], ["name", "earliest"])


def remove_repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` of every row of ``docs(doc_id, text)``.

    Words are runs without ASCII white space. Each word in a window that also starts in a document with a smaller doc_id
    is removed; windows are judged on the given texts. ``kept`` is the other words joined by one space. NULL or
    empty text has no words. Rows with NULL doc_id keep everything and are nobody's source. Rows that repeat a
    doc_id are each compared with smaller ids only. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    found = repeated_intervals(texts, window, anchor)
    places = found.groupBy("row").agg(F.collect_set("first").alias("starts"))  # at most the words of the row

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = _arrays(batch.column(2))
            for at, to, data, offsets in text_blocks(batch.column(1)):
                words = find_words(data, offsets, SPACED)
                total, gone, kept = np.diff(words.first), [], []
                blob = data.tobytes()
                for d in range(to - at):
                    a, b = words.first[d], words.first[d + 1]
                    step = np.zeros(b - a + 1, np.int32)
                    if len(starts[at + d]):
                        own = np.unique(starts[at + d])
                        step[own] += 1
                        np.add.at(step, own + window, -1)
                    stay = np.flatnonzero(np.cumsum(step)[:-1] == 0) + a
                    gone.append(int(b - a - len(stay)))
                    parts = zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)
                    kept.append(b" ".join([blob[i:j] for i, j in parts]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(total),
                        pa.array(gone, pa.int64()),
                        pa.array([k.decode() for k in kept], pa.string()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    joined = texts.join(places, "row", "left").select(
        "doc_id", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts")
    )
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
