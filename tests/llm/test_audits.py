"""Filter interactions, source divergence and near copies of vectors against plain versions."""

import itertools
import math
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from skyqa.llm import divergence, embedding_dedup, filter_audit  # noqa: E402

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


# ---- filters

LONG = " ".join(f"w{k}" for k in range(60))
TEXTS = [None, "", "  \n", "A", "a b c", LONG, LONG.upper(), LONG + " #", "r " * 70, "É" * 10 + " A", LONG, LONG, None, "50% " * 100, "x" * 300 + "A" * 16]


def fails(text):
    words = brute.SPACED.findall(text)
    out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
    return out + "D" * bool(re.search("[#$%&*|]", text))


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, s in docs:
        f = fails(t or "") + "E" * (i is not None and first[t or ""] < i)
        parts[s or ""].append((f, i in good, i in toxic))
    out = set()
    for part, rows in parts.items():
        shapley, made = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                gone, kept = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                redundant = sum(x in r[0] for r in rows) - len(gone)
                made.append((part, order, step, len(kept), len(gone), redundant, sum(r[0] == x for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
                shapley[x] += len(gone)
                left = kept
        out |= {(*m, shapley[m[1][m[2] - 1]]) for m in made}
    return out


def test_filter_audit(spark):
    docs = [(i, t, ["s", "", None, "t"][i % 4]) for i, t in enumerate(TEXTS)]
    docs += [(None, LONG, "s"), (3, "A", "t"), (3, "another text", "s"), (5, LONG, "s")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(15)] + [(None, 1, 1), (4, 1, None), (6, None, 1), (77, 1, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    df = df.withColumns({"fails": F.lit("x"), "part": F.lit(1), "h": F.lit(2), "n": F.lit(3)})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("y"))
    got = [tuple(r) for r in filter_audit.audit(df, said).collect()]
    assert len(got) == 3 * 600 and set(got) == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), said).count() == 0
    assert filter_audit.audit(df, said.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_removal_steps_are_those_of_applying_the_filters():
    orders = np.array(list(itertools.permutations(range(3))))
    steps = filter_audit.removal_steps(3, orders)
    for mask, (o, order) in itertools.product(range(8), enumerate(orders)):
        assert steps[mask, o] == next((k + 1 for k, f in enumerate(order) if mask >> f & 1), 4)


# ---- divergence


def plain_divergence(docs, min_docs, top, s=5):
    docs = [(t or "", la or "", so or "") for t, la, so in docs]
    counts, held, occurs = Counter(), defaultdict(set), Counter()
    for k, (t, la, so) in enumerate(docs):
        for term in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)):
            counts[la, so, term] += 1
            occurs[la, term] += 1
            held[la, term].add(k)
    out = set()
    for la in {d[1] for d in docs}:
        kept = [t for (x, t), d in held.items() if x == la and len(d) >= min_docs]
        sources = sorted({d[2] for d in docs if d[1] == la})
        v = len(kept)
        share = lambda c, n: 1 + 10**9 * (c + s) // (n + s * v)
        total = {so: sum(counts[la, so, t] for t in kept) for so in sources}
        whole = sum(occurs[la, t] for t in kept)
        p = {so: {t: share(counts[la, so, t], total[so]) for t in kept} for so in sources}
        q = {t: share(occurs[la, t], whole) for t in kept}
        key = lambda r: (-r[1], r[0].encode())
        for so in sources:
            pairs = sorted(((o, sum(abs(p[so][t] - p[o][t]) for t in kept)) for o in sources if o != so), key=key)
            terms = sorted(((t, p[so][t] - q[t]) for t in kept if counts[la, so, t] and p[so][t] > q[t]), key=key)
            out |= {(la, so, "pair", i, f, k) for k, (i, f) in enumerate(pairs, 1)}
            out |= {(la, so, "term", i, f, k) for k, (i, f) in enumerate(terms[:top], 1)}
    return out


@pytest.mark.parametrize(("slice_terms", "tile", "held"), [(2048, 64, 1 << 19), (5, 3, 40)])
def test_divergence(spark, monkeypatch, slice_terms, tile, held):
    for name, value in (("SLICE_TERMS", slice_terms), ("TILE_SOURCES", tile), ("HELD_TERMS", held)):
        monkeypatch.setattr(divergence, name, value)
    draw = np.random.default_rng(3)
    words = ["a", "Ab", "abcdefgh", "abcdefghi", "ABCDEFGHabcdefgh", "abcdefghabcdefghi", "é", "日本語", "Ünïcödé" * 3, "x" * 300, "z" * 70_000, "İ"]
    words += [f"w{chr(97 + k)}" for k in range(26)]
    docs = []
    for k in range(150):
        picked = draw.choice(words, int(draw.integers(0, 30)), p=None)
        joint = ["1", " ", "_", "\x00", "\x7f", "-"][k % 6]
        docs.append((joint.join(picked), ["en", "de", None, ""][k % 4], [None, "s1", "S1", "é", "t", "", "u", "v"][int(draw.integers(0, 8))]))
    docs += [(None, "fr", "s"), ("12 34", "fr", "t"), ("only", "xx", "s"), (None, None, None), ("", "en", "empty"), docs[3], docs[3]]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    df = df.withColumns({"n": F.lit("x"), "term": F.lit(1), "idx": F.lit("i"), "tile": F.lit(0)})
    got = [tuple(r) for r in divergence.divergence(df, min_docs=5, top=7).collect()]
    want = plain_divergence(docs, 5, 7)
    assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert divergence.divergence(df.limit(0)).count() == 0


def test_radix_order_is_stable():
    draw = np.random.default_rng(1)
    words = [draw.integers(0, 3, 500).astype(np.uint64) << np.uint64(40), draw.integers(0, 9, 500).astype(np.uint32)]
    assert divergence.radix_order(words).tolist() == np.lexsort(words[::-1]).tolist()
    assert divergence.radix_order([np.zeros(4, np.uint64)]).tolist() == [0, 1, 2, 3]


def test_shares_are_exact(spark):
    rows = [(0, 1), (1, 1), (1, 3), (2, 3), (7, 9 * 10**15), (8_999_999_999_999_998, 8_999_999_999_999_999), (123_456_789_012_345, 987_654_321_098_765)]
    want = [10**9 * c // t for c, t in rows]
    df = spark.createDataFrame(rows, "c long, t long")
    assert [r[0] for r in df.select(divergence.share("c", "t")).collect()] == want
    assert divergence._share(*np.array(rows).T).tolist() == want


# ---- vectors


def plain_links(rows, cosine=0.9):
    """``(vec_id, n_links, component)`` of every row, from all pairs."""
    unit = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok:
            u = np.array(v, float)
            u /= np.abs(u).max()
            unit.append(u / np.sqrt((u * u).sum()))
        else:
            unit.append(None)
    links = defaultdict(set)
    for x in range(len(rows)):
        for y in range(x):
            if unit[x] is not None and unit[y] is not None and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= cosine:
                links[x].add(y)
                links[y].add(x)
    out = []
    for x, (i, _) in enumerate(rows):
        seen, todo = {x}, [x]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min((rows[y][0] for y in seen if rows[y][0] is not None), default=None)
        out.append((i, len(links[x]), low, i == low))
    return out


def order(r):
    return (r[0] is None, r[0] or 0, r[1], r[2] or 0)


def test_every_near_vector_is_linked(spark):
    draw = np.random.default_rng(5)
    d = 48
    rows = [(1000 + k, draw.standard_normal(d)) for k in range(300)]
    # balls of several widths, chains between two directions, two balls next to each other, scaled and repeated vectors
    for base, (size, width) in enumerate([(300, 0.02), (80, 0.05), (60, 0.1), (300, 0.06)]):
        centre = draw.standard_normal(d)
        rows += [(10_000 * (base + 1) + k, centre + width * draw.standard_normal(d) * np.linalg.norm(centre) / np.sqrt(d) * 3) for k in range(size)]
    a, b = draw.standard_normal((2, d))
    rows += [(60_000 + k, a * np.cos(k / 10) + b * np.sin(k / 10)) for k in range(16)]
    near = a + 0.42 * b * np.linalg.norm(a) / np.linalg.norm(b)
    rows += [(70_000 + k, near + 0.1 * draw.standard_normal(d)) for k in range(300)]
    rows += [(80_000, a * 1e200), (80_001, a * 1e-200), (80_002, a), (80_002, a), (80_002, -a), (3, b)]
    rows = [(i, v.tolist()) for i, v in rows]
    odd = [None, [], [0.0] * d, [-0.0] * d, [math.nan] + [1.0] * (d - 1), [math.inf] * d, [None] + [1.0] * (d - 1)]
    rows += [(90_000 + k, v) for k, v in enumerate(odd)] + [(None, rows[0][1]), (95_000, [1.0]), (95_001, [2.0]), (95_002, [-1.0]), (95_003, [1.0, 0.0]), (95_004, [1.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("h", "v", "node", "a", "copies")})
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df.repartition(5), recall=0.999999).collect()), key=order)
    want = sorted((((i, n, low, same) if low is not None else (i, n, None, True)) for i, n, low, same in plain_links(rows)), key=order)
    assert [g for g, w in zip(got, want, strict=True) if g != w] == []
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_least_cosine():
    """Pairs exactly at the least cosine meet as often as planned."""
    draw = np.random.default_rng(2)
    hashes, tables = embedding_dedup.table_plan(50_000)
    u = draw.standard_normal((4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = draw.standard_normal((4000, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = 0.9 * u + math.sqrt(1 - 0.81) * w / np.linalg.norm(w, axis=1, keepdims=True)
    met = (embedding_dedup.table_keys(u, hashes, tables) == embedding_dedup.table_keys(v, hashes, tables)).any(axis=1)
    assert met.mean() >= 0.985
    unlike = np.bitwise_count(embedding_dedup.sign_codes(u) ^ embedding_dedup.sign_codes(v)).sum(axis=1)
    p = math.acos(0.9) / math.pi
    assert unlike.max() <= 128 * p + 6 * math.sqrt(128 * p * (1 - p))
    assert embedding_dedup.table_plan(10**9)[0] > hashes
