"""Groups of documents whose sets of word shingles are similar, by prefixes of token combinations.

A token here is a shingle. Tokens are ordered: first the rare ones, then the frequent ones, by hash within each. A set of
``n`` tokens that reaches the similarity with another misses at most ``t`` of its tokens there, so two such sets
share a token among their first ``t + 1``. Rare tokens are indexed one by one. Frequent tokens would make
long lists; they are dealt into classes, and pairs of one class are indexed. A prefix is
extended until, over its classes, the tokens beyond the first of each make up what is missing: then two similar sets share
either a rare token or two frequent tokens of one class. Candidates are verified on the whole sets.

Texts with equal sets are one node. In each list the candidates are first compared with the smallest node only. Where all
other members end up in one component, no other pair can change it. The members of the other lists are compared block by block, but
for pairs that are in one component already; of lists with the same members one is enough. Before any text is sent, sketches of the sets
(how many tokens fall into each hash cell) show for most pairs that too few tokens can be shared. Of the pairs left in a list
those are verified first that connect its components, the likeliest ones that do; lists that hold more go on, with some partners of each
component and more each time, until all members are in one component or no pair is left.

Links never leave a component. Once these are known, all pairs of nodes inside each are compared and counted, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyqa.functions.frames import BROADCAST_ROWS, broadcast_if_small, scratch_path
from skyqa.llm.components import components
from skyqa.llm.tables import written
from skyqa.llm.words import SPACED, as_long, find_words, grams, mix, same_text, text_blocks

#: Words of a shingle; similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Documents from which a token is frequent, and how many tokens may be (the most frequent; 8 bytes each in every task).
#: Which tokens are frequent steers the work only; any choice gives the same groups.
FREQUENT, FREQUENT_TOKENS = 16, 1 << 19
#: Tokens of one task of the counting stage, and members of a list that are verified in one group.
COUNTED, VERIFIED = 4_000_000, 256
#: Nodes and tokens of a block of a component when its links are counted; every block meets every other once.
BLOCK_NODES, BLOCK_TOKENS = 2048, 2_000_000
#: Members of a block of a long list; every block of a list meets every other once.
LIST_BLOCK = 1024
#: Partners of each component in a list that are verified in a pass, and how many times more in each further one. The first pass
#: verifies only pairs that connect components.
PARTNERS, PARTNERS_GROW = 4, 8
#: Hash cells whose tokens a sketch counts; a multiple of 64.
_CELLS = 512
#: Pairs of lists that a task looks at together, and pairs whose sketches it compares at once.
_LOOKED, _SKETCHED = 1 << 20, 1 << 13
#: Bits of the table that most rare tokens are told by without a search among the frequent ones.
_TOLD_BITS = 23
#: Share of each set's first tokens (by hash) that are counted; prefixes lie among them unless most are frequent.
_COUNTED_SHARE = 0.4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, one text after the other, and where each text begins."""
    words = find_words(data, offsets, SPACED, lower=True)
    count = np.diff(words.first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    token = np.empty(first[-1], np.uint64)
    token[np.repeat(count >= size, n)] = grams(words.hash, size)[same_text(words, size)]
    for k in range(1, size):  # too short for a shingle: all the words as one
        few = np.flatnonzero(count == k)
        if len(few):
            token[first[few]] = grams(words.hash, k)[words.first[few]]
    new = np.ones(len(token) + 1, bool)
    edges = first.tolist()
    for d in np.flatnonzero(n > 1).tolist():
        token[edges[d] : edges[d + 1]].sort()
    new[1:-1] = token[1:] != token[:-1]
    new[first] = True
    before = np.concatenate([[0], np.cumsum(new[:-1])])
    return token[new[:-1]], before[first]


def _nodes(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(token ^ np.uint64(0x5BD1E995)))])
    return as_long(mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(np.uint64)))


def _sketches(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set, how many of its tokens fall into each cell (at most 255)."""
    cell = (mix(token ^ np.uint64(0x7FEB352D)) >> np.uint64(40)).astype(np.int64) % _CELLS
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = np.bincount(doc * _CELLS + cell, minlength=(len(first) - 1) * _CELLS).reshape(-1, _CELLS)
    return np.minimum(n, 255).astype(np.uint8)


def missing(n: np.ndarray | int, percent: int = PERCENT):
    """How many of its ``n`` tokens a set can miss in a similar one."""
    return n - -(-n * percent // 100)


def size_steps(percent: int, most: int) -> np.ndarray:
    """Lower ends of size classes: similar sets are in the same class or in neighbouring ones."""
    steps = [1]
    while steps[-1] <= most:
        steps.append(steps[-1] * 100 // percent + 1)
    return np.array(steps)


def signatures(
    token: np.ndarray, first: np.ndarray, frequent: np.ndarray, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, set number, and whether it is a pair of frequent tokens, of each set with four tokens at least.

    Smaller sets are similar to equal ones only, which are one node.
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    often = _among(token & np.uint64(_LOW40), frequent)
    rare_rank = np.cumsum(~often) - 1
    begin = np.concatenate([[0], np.cumsum(~often)])[first[:-1]]
    need = missing(n, percent) + 1
    rank = rare_rank - begin[doc]
    big = n >= -(-percent // max(1, 100 - percent))  # smaller ones have no unequal partner
    single = ~often & (rank < need[doc]) & big[doc]
    sig, of = [mix(token[single] ^ np.uint64(1))], [doc[single]]
    pair = [np.zeros(int(single.sum()), bool)]
    rare = np.bincount(doc[~often], minlength=len(n))
    steps = size_steps(percent, int(n.max(initial=1)))
    for d in np.flatnonzero((rare < need) & big).tolist():
        own = token[first[d] : first[d + 1]]
        own = own[often[first[d] : first[d + 1]]]
        step = int(np.searchsorted(steps, n[d], "right")) - 1
        for b in (step, step + 1):
            made = _pairs(own, int(need[d] - rare[d]), b, max(1, int(steps[b]) // 8))
            sig.append(made)
            of.append(np.full(len(made), d))
            pair.append(np.ones(len(made), bool))
    return np.concatenate(sig), np.concatenate(of), np.concatenate(pair)


def _pairs(own: np.ndarray, need: int, size_class: int, classes: int) -> np.ndarray:
    """Pairs of one class among the first tokens, as many tokens as leave ``need`` beyond the first of each class."""
    group = (mix(own ^ np.uint64(size_class + 2)) % np.uint64(classes)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    start = np.ones(len(own), bool)
    start[1:] = group[order][1:] != group[order][:-1]
    repeat = np.ones(len(own), bool)
    repeat[order[start]] = False
    reach = np.cumsum(repeat)
    take = int(np.searchsorted(reach, need)) + 1
    own, group = own[:take], group[:take]
    order = np.lexsort((own, group))
    own, group = own[order], group[order]
    out, salt = [np.zeros(0, np.uint64)], np.uint64(0x1000 + size_class)
    for gap in range(1, len(own)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        out.append(mix(mix(own[:-gap][same] ^ salt) + own[gap:][same]))
    return np.concatenate(out)


_LOW40 = (1 << 40) - 1
_told: list[np.ndarray] = []


def _among(token: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Whether each token is one of the sorted ``frequent`` ones. A task keeps the table of the last array it asked for."""
    if not len(frequent):
        return np.zeros(len(token), bool)
    mask = np.uint64((1 << _TOLD_BITS) - 1)
    if not _told or _told[0] is not frequent:
        table = np.zeros(1 << _TOLD_BITS, bool)
        table[frequent & mask] = True
        _told[:] = [frequent, table]
    out = _told[1][token & mask]
    may = np.flatnonzero(out)
    where = np.minimum(np.searchsorted(frequent, token[may]), len(frequent) - 1)
    out[may] = frequent[where] == token[may]
    return out


def _count_frequent(texts: DataFrame, total: int, size: int) -> np.ndarray:
    """The most frequent tokens (their lowest 40 bits), from a count over all texts."""
    buckets = max(16, -(-total // COUNTED))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                token, first = shingle_sets(data, offsets, size)
                n = np.diff(first)
                rank = np.arange(len(token)) - np.repeat(first[:-1], n)
                token = token[rank < np.repeat(np.ceil(n * _COUNTED_SHARE), n)] & np.uint64(_LOW40)
                token.sort()
                bucket = (token * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                held = np.ascontiguousarray(token.view(np.uint8).reshape(-1, 8)[:, :5])
                full = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full.astype(np.int32)),
                        # the five bytes of a token apart: the high ones of sorted tokens repeat
                        pa.array([held[edge[b] : edge[b + 1]].T.tobytes() for b in full.tolist()], pa.binary()),
                    ],
                    ["bucket", "tokens"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.zeros((len(raw) // 5, 8), np.uint8)
                part[:, :5] = np.frombuffer(raw, np.uint8).reshape(5, -1).T
                held.setdefault(b, []).append(part.view("<u8").ravel())
        for parts in held.values():
            token = np.sort(np.concatenate(parts))
            edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            n = np.diff(edge)
            token, n = token[edge[:-1]][n >= FREQUENT], n[n >= FREQUENT]
            level = np.log2(n).astype(np.int32)
            for k in np.unique(level).tolist():
                own = token[level == k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([own.tobytes()], pa.binary())],
                    ["level", "n", "tokens"],
                )

    dealt = texts.mapInArrow(deal, "bucket int, tokens binary").repartition(buckets, "bucket")
    found = written(dealt.mapInArrow(count, "level int, n long, tokens binary"), "frequent")
    kept, held = [], 0
    for r in found.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        held += r.n
        if held > FREQUENT_TOKENS:
            break
        kept.append(r.level)
    rows = found.where(F.col("level").isin(kept)).select("tokens").toLocalIterator() if kept else []
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.tokens, "<u8") for r in rows)]))


def similar_groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row of ``docs(doc_id, text)``.

    Sets link when ``100 * |intersection| >= percent * |union|``. ``component_id`` is the smallest doc_id that links
    reach. Equal sets that are not empty always link. A text without words (or NULL) links with nothing. ``n_links`` counts
    all links of the row's set to other sets; rows of equal sets are one set there. Rows with a
    NULL doc_id form no link and are their own (NULL) component; rows that repeat a doc_id are rows of their own.
    Other columns are ignored.
    """
    if not 50 < percent < 100:
        raise ValueError("percent is above 50 and below 100")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_blocks(batch.column(1)):
                token, first = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(np.diff(first)),
                        pa.array(_nodes(token, first)),
                        pa.array([c.tobytes() for c in _sketches(token, first)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "node", "cells"],
                )

    path = scratch_path(spark, "sets")
    texts.mapInArrow(name, "doc_id long, n_shingles long, node long, cells binary").write.option("compression", "zstd").parquet(path)
    sets = spark.read.parquet(path)
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    known = texts.where("doc_id is not null")
    frequent = spark.sparkContext.broadcast(_count_frequent(known.select("text"), total, size))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                token, first = shingle_sets(data, offsets, size)
                sig, of, pair = signatures(token, first, frequent.value, percent)
                node, n = _nodes(token, first), np.diff(first).astype(np.int32)
                columns = (as_long(sig), node[of], n[of], pair)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "node", "n", "pair"])

    signed = known.select("text").mapInArrow(sign, "sig long, node long, n int, pair boolean")
    # a list of pairs of frequent tokens may be long: its rows are thinned and joined, which can be split. Signing twice
    # costs less than keeping all signatures
    path = scratch_path(spark, "lists")
    lists = Window.partitionBy("sig")
    hub = F.min(F.struct("node", "n"))
    singles = (
        signed.where(~F.col("pair"))
        .withColumn("hub", hub.over(lists))
        .withColumn("other", F.max("node").over(lists))
        .where("hub.node < other")
    )
    rows = signed.where("pair").select("sig", "node", "n").distinct()
    heads = rows.groupBy("sig").agg(hub.alias("hub"), F.max("node").alias("other")).where("hub.node < other")
    for kind, found in (("singles", singles), ("pairs", rows.join(heads, "sig"))):
        row = ("sig", F.col("hub.node").alias("a"), F.col("hub.n").alias("a_n"), F.col("node").alias("b"), F.col("n").alias("b_n"))
        found.select(*row).write.option("compression", "zstd").parquet(f"{path}/{kind}")
    shared = spark.read.parquet(f"{path}/singles").unionByName(spark.read.parquet(f"{path}/pairs"))

    near = written(shared.where("a <> b").select("a", "a_n", "b", "b_n").distinct(), "near")
    holders = sets.where("doc_id is not null and n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")
    )
    cells = sets.where("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.max("cells").alias("cells"))
    named = holders.select("node", "doc_id")
    possible = written(_possible(_fitting(near, percent), cells, percent), "possible")
    links = written(_verify(possible, known, named, percent, size), "links")
    found = components(links)

    # its first node is done with each list; the others are compared where they are in several components
    others = shared.where("a <> b").select("sig", F.col("b").alias("node"), F.col("b_n").alias("n")).distinct()
    members = written(_open_lists(others, found).join(cells, "node"), "open-lists")
    tried, partners, first = near.select("a", "b"), PARTNERS, True
    while not members.isEmpty():
        listed = written(_list_pairs(members, percent, 0 if first else partners), "list-pairs")
        pairs = listed.where("sig is null").select("a", "b").distinct()
        fresh = written(pairs.join(tried, ["a", "b"], "left_anti"), "fresh")
        linked = None if fresh.isEmpty() else written(_verify(fresh, known, named, percent, size), "links")
        if linked is not None and not linked.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked))
        more = written(listed.where("sig is not null").select("sig").distinct(), "more")
        if more.isEmpty():
            break
        tried, partners, first = tried.unionByName(pairs), partners * PARTNERS_GROW, False
        left = members.join(broadcast_if_small(more), "sig", "left_semi").drop("component")
        members = written(_open_lists(left, found), "open-lists")

    degree = _degrees(found, known, holders.select("node", "doc_id", "n"), percent, size)
    nodes = holders.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    nodes = nodes.join(smallest, "component").join(degree, "node", "left").select("node", "component_id", "n_links")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return (
        sets.join(nodes, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(linkable, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(linkable, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
        )
    )


def _open_lists(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members ``sig, node, n`` with their ``component``, of the lists that hold more than one; of lists of the same nodes just one."""
    placed = members.join(broadcast_if_small(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = placed.groupBy("sig").agg(
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.count(F.lit(1)).alias("held"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"),
    )
    kept = lists.where("lo < hi").groupBy("held", "one", "two").agg(F.min("sig").alias("sig"))
    return placed.join(kept.select("sig"), "sig")


def _list_pairs(members: DataFrame, percent: int, partners: int) -> DataFrame:
    """Pairs ``a, b`` of one list and two components whose sizes and sketches fit: the ``partners`` likeliest of each component there.

    Of no ``partners``, the likeliest pairs that connect all components of a list as far as they can be: fewer than it has components.
    A list (or two blocks of one) that holds more pairs also gives a row with its ``sig`` alone. A pair of many lists may come from
    several tasks. Lists of more than ``LIST_BLOCK`` members are dealt in blocks by their nodes, so that no task holds a long one whole.
    """
    long = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = members.join(broadcast_if_small(written(long, "long-lists")), "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.col("other")
    keys = ["sig", "low", "high"]
    seats = (
        dealt.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), "own", "node", "n", "component", "cells")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
    )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cells, emitted = np.zeros((0, 7), np.int64), np.zeros((0, _CELLS), np.uint8), np.zeros(0, _PAIR)
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(7)], axis=1)
            held = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, _CELLS)
            rows, cells = np.concatenate([rows, fresh]), np.concatenate([cells, held])
            whole = (rows[:, :3] != rows[-1, :3]).any(axis=1)  # the last list may go on in the next batch
            for pairs, more in _fitting_pairs(rows[whole], cells[whole], percent, partners):
                pairs = pairs[~np.isin(pairs, emitted)]
                emitted = np.concatenate([emitted, pairs])[-_REMEMBERED:]
                yield _pair_batch(pairs, more)
            rows, cells = rows[~whole], cells[~whole]
        for pairs, more in _fitting_pairs(rows, cells, percent, partners):
            yield _pair_batch(pairs, more)

    return seats.mapInArrow(pair, "a long, b long, sig long")


#: A pair of nodes, and how many pairs a task remembers so as not to send them again.
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
_REMEMBERED = 1 << 17


def _pair_batch(pairs: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Rows of pairs without a ``sig``, then rows of ``sig`` alone."""
    none, gap = np.zeros(len(pairs), np.int64), np.zeros(len(more), np.int64)
    lists = np.arange(len(pairs) + len(more)) >= len(pairs)
    ends = [pa.array(np.concatenate([pairs[c], gap]), mask=lists) for c in ("a", "b")]
    return pa.RecordBatch.from_arrays([*ends, pa.array(np.concatenate([none, more]), mask=~lists)], ["a", "b", "sig"])


def _fitting_pairs(
    rows: np.ndarray, cells: np.ndarray, percent: int, partners: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The likeliest pairs across components, and which lists hold more, of lists or of two blocks of one.

    ``rows`` are ``sig, low, high, own, node, n, component``, ``cells`` their sketches. Some lists at a time are looked at.
    """
    if not len(rows):
        return
    order = np.lexsort((rows[:, 5], rows[:, 2], rows[:, 1], rows[:, 0]))
    rows, cells = rows[order], cells[order]
    start = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]))
    size = np.diff(np.append(start, len(rows)))
    part = np.cumsum(size * size // 2) // _LOOKED
    edges = [*start[np.flatnonzero(np.diff(part, prepend=-1))].tolist(), len(rows)]
    for at, to in zip(edges[:-1], edges[1:], strict=True):
        own, held = rows[at:to], cells[at:to]
        one, two, share = _sketched(own, held, percent)
        sides = _sides(own, one, two)
        likely = _likeliest(*sides, share, partners) if partners else _connecting(*sides, share)
        x, y = own[one[likely], 4], own[two[likely], 4]
        pairs = np.empty(len(x), _PAIR)
        pairs["a"], pairs["b"] = np.minimum(x, y), np.maximum(x, y)
        yield np.unique(pairs), np.unique(own[one[~likely], 0])


def _sketched(rows: np.ndarray, cells: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places whose sizes and sketches fit, and which share of both sets' tokens can be common."""
    own, n, component = rows[:, 3], rows[:, 5], rows[:, 6]
    bits = np.packbits(cells > 0, axis=1).view(np.uint64)
    full = (cells == 255).any(axis=1)  # counts may be higher
    mixed = rows[:, 1] != rows[:, 2]
    start = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]))
    end = np.repeat(np.append(start[1:], len(rows)), np.diff(np.append(start, len(rows))))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    at, gap = np.arange(len(rows)), 1
    while True:
        at = at[at + gap < end[at]]
        at = at[100 * n[at] >= percent * n[at + gap]]  # sizes ascend: no later partner fits either
        if not len(at):
            break
        near = at[(component[at] != component[at + gap]) & ~(mixed[at] & (own[at] == own[at + gap]))]
        for k in range(0, len(near), _SKETCHED):
            one = near[k : k + _SKETCHED]
            two = one + gap
            here = np.bitwise_count(bits[one] & ~bits[two]).sum(axis=1, dtype=np.int64)
            there = np.bitwise_count(bits[two] & ~bits[one]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[one] - here, n[two] - there)  # tokens that both can have
            fits = (100 + percent) * most >= percent * (n[one] + n[two])
            one, two, most = one[fits], two[fits], most[fits]
            both = np.minimum(cells[one], cells[two]).sum(axis=1, dtype=np.int64)
            most = np.where(full[one] | full[two], most, both)
            fits = (100 + percent) * most >= percent * (n[one] + n[two])
            one, two = one[fits], two[fits]
            out.append((one, two, most[fits] / (n[one] + n[two])))
        gap += 1
    one, two, share = (np.concatenate(c) for c in zip(*out, strict=True))
    return one, two, share


def _sides(rows: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of places, a number for the component of each within its list: members of one component ask for partners together."""
    order = np.lexsort((rows[:, 6], rows[:, 2], rows[:, 1], rows[:, 0]))
    keys = rows[order][:, [0, 1, 2, 6]]
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(np.append(False, (keys[1:] != keys[:-1]).any(axis=1)))
    return number[one], number[two]


def _likeliest(one: np.ndarray, two: np.ndarray, share: np.ndarray, partners: int) -> np.ndarray:
    """Which pairs are among the ``partners`` likeliest of one of their sides, whose numbers are ``one`` and ``two``."""
    ends = np.concatenate([one, two])
    order = np.lexsort((-np.concatenate([share, share]), ends))
    begin = np.flatnonzero(np.diff(ends[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    keep = np.zeros(len(one), bool)
    keep[order[rank < partners] % max(1, len(one))] = True
    return keep


def _connecting(one: np.ndarray, two: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which pairs connect all sides that any pairs connect, the likeliest ones that do: a forest, so fewer pairs than sides."""
    keep = np.zeros(len(one), bool)
    order = np.lexsort((two, one, -share))
    one, two, open_ = one[order], two[order], np.arange(len(order))
    root = np.arange(max(one.max(initial=-1), two.max(initial=-1)) + 1)
    while len(open_):
        best = np.full(len(root), len(order))  # the likeliest pair of each tree
        for side in (one, two):
            of = np.full(len(root), len(order))
            of[root[side[open_]][::-1]] = open_[::-1]
            best = np.minimum(best, of)
        tree = np.flatnonzero(best < len(order))
        a, b = root[one[best[tree]]], root[two[best[tree]]]
        keep[order[best[tree]]] = True
        to = np.arange(len(root))
        to[tree] = np.where(a == tree, b, a)
        chose = tree[(to[to[tree]] == tree) & (tree < to[tree])]  # of two trees that chose one pair, one stays
        to[chose] = chose
        while (to[to] != to).any():
            to = to[to]
        root = to[root]
        open_ = open_[root[one[open_]] != root[two[open_]]]
    return keep


def _possible(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The pairs whose counts of tokens by cell leave enough that both can have."""
    a, b = (cells.select(F.col("node").alias(c), F.col("cells").alias(f"{c}_cells")) for c in ("a", "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, _CELLS) for i in (2, 3))
            most = np.minimum(left, right).sum(axis=1, dtype=np.int64)
            total = left.sum(axis=1, dtype=np.int64) + right.sum(axis=1, dtype=np.int64)
            full = (left == 255).any(axis=1) | (right == 255).any(axis=1)  # counts may be higher
            pick = pa.array(np.flatnonzero(full | ((100 + percent) * most >= percent * total)))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pick) for i in (0, 1)], ["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_cells", "b_cells").mapInArrow(check, "a long, b long")


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity."""
    return pairs.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent).select("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame, holders: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs ``a, b`` of nodes that reach the similarity; ``pairs`` were :func:`written`.

    Each text travels once to every group that compares it: the members of an ``a``, in parts of about ``VERIFIED``, with ``a`` in front.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / VERIFIED).cast("int").alias("parts"))
    split = broadcast_if_small(written(groups.where("parts > 1"), "parts"))
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    parts = F.coalesce("parts", F.lit(1))
    members = pairs.join(split, "a", "left").select("a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), F.col("b").alias("node"))
    seats = written(heads.unionByName(members).join(holders, "node"), "seats")
    texts = texts.join(broadcast_if_small(seats.select("doc_id").distinct()), "doc_id", "left_semi")  # most stay where they are
    sent = (
        texts.join(seats, "doc_id")
        .select("a", "part", "node", "text")
        .repartition("a", "part")
        .sortWithinPartitions("a", "part", F.desc(F.col("node") == F.col("a")))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, front = None, None
        for batch in batches:
            groups, parts, nodes = (np.asarray(batch.column(i)) for i in range(3))
            for at, to, data, offsets in text_blocks(batch.column(3)):
                token, first = shingle_sets(data, offsets, size)
                real = _nodes(token, first)
                linked = []
                for i in range(at, to):
                    own = token[first[i - at] : first[i - at + 1]]
                    if real[i - at] != nodes[i]:  # another row of that doc_id
                        continue
                    if nodes[i] == groups[i]:
                        head, front = (groups[i], parts[i]), own
                        continue
                    if head != (groups[i], parts[i]):
                        raise ValueError("a group without its first text")
                    where = np.searchsorted(front, own)
                    common = int((front[np.minimum(where, len(front) - 1)] == own).sum())
                    if 100 * common >= percent * (len(front) + len(own) - common):
                        linked.append(i)
                pick = np.array(linked, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(groups[pick]), pa.array(nodes[pick])], ["a", "b"])

    return sent.mapInArrow(compare, "a long, b long").distinct()


def _degrees(found: DataFrame, texts: DataFrame, holders: DataFrame, percent: int, size: int) -> DataFrame:
    """``node, n_links`` of every node of the components ``found``: with how many others it links.

    All pairs inside each component are compared, in blocks: a text travels once to each block of its own component,
    so just once where the component is one block. Two nodes alone have the one link that joined them.
    """
    placed = written(found.join(holders, "node"), "placed")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    sizes = broadcast_if_small(written(placed.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), blocks.alias("blocks")), "sizes"))
    placed = placed.join(sizes, "component")
    seats = written(placed.where("nodes > 2").select("component", "blocks", "node", "doc_id"), "seats")
    if seats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then the other texts stay where they are
        texts = texts.join(F.broadcast(seats.select("doc_id").distinct()), "doc_id", "left_semi")
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.col("other")
    sent = (
        texts.join(seats, "doc_id")
        .withColumn("own", own)
        .select("component", "own", "node", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("component", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), "own", "node", "text")
        .repartition("component", "low", "high")
        .sortWithinPartitions("component", "low", "high")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            owns, nodes = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for at, to, data, offsets in text_blocks(batch.column(5)):
                token, first = shingle_sets(data, offsets, size)
                real = _nodes(token, first)
                for i in range(at, to):
                    if keys[i] != group:
                        yield _counted(group, held, percent)
                        group, held = keys[i], {}
                    if real[i - at] == nodes[i]:  # else another row of that doc_id
                        held[nodes[i]] = owns[i], token[first[i - at] : first[i - at + 1]].copy()
        yield _counted(group, held, percent)

    counted = sent.mapInArrow(count, "node long, n_links long")
    two = placed.where("nodes = 2").select("node", F.lit(1).cast("long").alias("n_links"))
    return counted.unionByName(two).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _counted(group: tuple | None, held: dict[int, tuple[int, np.ndarray]], percent: int) -> pa.RecordBatch:
    """Links that each node of the blocks ``(component, low, high)`` has with those of the other, or within one block."""
    nodes, links = [], [np.zeros(0, np.int64)]
    if held:
        low, high = ([(k, token) for k, (own, token) in held.items() if own == part] for part in group[1:])
        to_low, to_high = degrees([t for _, t in low], [t for _, t in high], percent)
        nodes, links = [k for k, _ in low], [to_low - (group[1] == group[2])]  # without the set itself
        if group[1] != group[2]:
            nodes += [k for k, _ in high]
            links.append(to_high)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(links))], ["node", "n_links"])


def degrees(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """With how many sets of ``right`` each set of ``left`` reaches the similarity, and the other way round."""
    common = _common(left, right)
    n, other = (np.array([len(t) for t in side], np.int64) for side in (left, right))
    to_left, to_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for at in range(0, len(left), 256):
        part = slice(at, at + 256)
        linked = (100 + percent) * common[part].astype(np.int64) >= percent * (n[part, None] + other)
        to_left[part] = linked.sum(axis=1)
        to_right += linked.sum(axis=0)
    return to_left, to_right


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``left`` shares with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int32)
    if not left or not right:
        return out
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(shared):
        return out

    def place(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        token, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(t) for t in sets])
        where = np.minimum(np.searchsorted(shared, token), len(shared) - 1)
        keep = shared[where] == token
        where, doc = where[keep], doc[keep]
        order = np.argsort(where, kind="stable")
        return where[order], doc[order]

    (a, a_doc), (b, b_doc) = place(left), place(right)
    a_n, b_n = np.bincount(a, minlength=len(shared)), np.bincount(b, minlength=len(shared))
    dense = a_n * b_n * 64 >= out.size  # tokens of many pairs: a product of matrices; the others pair by pair
    column = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), 2048):
        sides = []
        for where, doc, rows in ((a, a_doc, len(left)), (b, b_doc, len(right))):
            use = dense[where] & (column[where] >= at) & (column[where] < at + 2048)
            side = np.zeros((rows, 2048), np.float32)
            side[doc[use], column[where[use]] - at] = 1
            sides.append(side)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int32)
    start = np.cumsum(b_n) - b_n
    a, a_doc = a[~dense[a]], a_doc[~dense[a]]
    edge = np.concatenate([[0], np.cumsum(b_n[a])])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + (1 << 21), "right")) - 1)
        n = b_n[a[at:to]]
        partner = b_doc[np.repeat(start[a[at:to]] - (edge[at:to] - edge[at]), n) + np.arange(int(n.sum()))]
        out += np.bincount(np.repeat(a_doc[at:to], n) * len(right) + partner, minlength=out.size).reshape(out.shape).astype(np.int32)
        at = to
    return out
