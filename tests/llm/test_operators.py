"""Every operator on small tables with NULLs, empty and long texts, ties and repeated rows, against plain versions."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from skyqa.llm import (  # noqa: E402
    decontaminate,
    jaccard,
    language,
    licenses,
    neighbours,
    packing,
    quality,
    secret_scan,
    substrings,
    token_files,
)
from skyqa.llm.tokens import Tokens, tokenizer_path  # noqa: E402

DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = [None, "", " \n", "a b c", "A b  c", "Σίσυφος İ 中文 é ½ it's <|endoftext|>", "a×b «é» 12ab34 \x7f x\x1cy"]
PASSAGE = " ".join(f"q{i}" for i in range(20))


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="module")
def corpus(spark):
    """Given documents, odd texts, a repeated row, a row without id, copies that differ a little, and a clashing column."""
    draw = np.random.default_rng(1)
    rows = [(900_000 + i, t) for i, t in enumerate(ODD)]
    rows += [(900_100, PASSAGE), (900_101, "x " + PASSAGE + " y"), (None, PASSAGE), (900_101, "zz " + PASSAGE)]
    rows += [(900_102, "r r " * 30), (900_103, "r " * 45), (900_104, PASSAGE), (900_104, PASSAGE)]
    for i in range(40):
        words = [f"x{k}" for k in range(120)]
        for k in draw.choice(120, int(draw.integers(1, 6)), replace=False):
            words[k] = f"y{draw.integers(1000)}"
        rows.append((910_000 + i, " ".join(words)))
    for i in range(30):  # a shared passage among other words
        rows.append((920_000 + i, " ".join([f"p{k}" for k in range(60)] + [f"z{i}_{k}" for k in range(int(draw.integers(2, 30)))])))
    given = spark.read.parquet(DOCS).select("doc_id", "text")
    df = given.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("node", F.lit("x")).cache()
    return df, [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("common", [3, 512])
def test_repeated_passages(corpus, monkeypatch, common):
    monkeypatch.setattr(substrings, "COMMON", common)
    df, rows = corpus
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeated(df).collect()]
    want = []
    for i, words, gone in brute.removed_words(rows):
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert by_id(got) == by_id(want)


@pytest.mark.parametrize("frequent", [2, 16])
def test_similar_groups(corpus, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    df, rows = corpus
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect()]
    assert by_id(got) == by_id(brute.groups(rows))


def test_tokens_equal_the_library(corpus):
    _, rows = corpus
    tokens = Tokens(tokenizer_path())
    texts = [t for _, t in rows]
    for at, to, ids, sizes in tokens.blocks(pa.array(texts)):
        begin = np.concatenate([[0], np.cumsum(sizes)])
        for k, text in enumerate(texts[at:to]):
            assert ids[begin[k] : begin[k + 1]].tolist() == tokens.library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, corpus, tmp_path, encoding):
    df, rows = corpus
    path = str(tmp_path / "t")
    token_files.write_tokens(df, path, tokenizer_path(), encoding=encoding)
    library = Tokens(tokenizer_path()).library
    want, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_index(spark, path).orderBy("start").collect()]
    assert got == want
    picked = token_files.read_tokens(spark, path).where("doc_id = 900003").select("tokens").collect()
    assert [r.tokens for r in picked] == [[*library.encode("a b c").ids, 2]]


def test_packing_places_every_piece_once(corpus):
    df, rows = corpus
    capacity = 256
    library = Tokens(tokenizer_path()).library
    pieces = packing.pack(df, tokenizer_path(), capacity=capacity).toPandas()
    want = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = [(None if np.isnan(r[0]) else int(r[0]), *r[1:]) for r in pieces[columns].astype({"doc_id": float}).itertuples(index=False)]
    assert by_id(got) == by_id(want)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.values == np.cumsum(own.length.values) - own.length.values).all() and own.length.sum() <= capacity
    assert pieces.sequence_id.nunique() <= 1.02 * pieces.length.sum() / capacity + 1


def test_plan_reaches_the_bound_and_takes_no_items():
    draw = np.random.default_rng(0)
    sizes = np.clip(np.exp(draw.normal(6.3, 1.2, 4000)).astype(int) + 1, 1, 4096)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True), strict=True)}
    plan = packing.make_plan(histogram)
    assert plan[:, 2].max() < sizes.sum() / 4096 * 1.01 + 1
    assert len(packing.make_plan({})) == 0 and packing.make_plan({4096: 3})[:, 2].tolist() == [0]


def test_nearest_equals_brute_force(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.standard_normal(32).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (501, [0.0] * 32), (502, [float("nan")] * 32), (503, [1.0, 2.0]), (None, rows[1][1]), (3, rows[3][1])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    ids = np.array([i for i, _ in rows[:430]])
    v = np.array([x for _, x in rows[:430]], float)
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    want = []
    for q in range(0, 430, 50):
        score = (v * v[q]).sum(axis=1)
        near = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
        want += [(q, r + 1, int(ids[k])) for r, k in enumerate(near)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(want)


def test_licenses(spark, corpus, empty):
    texts = ["Under the MIT License. Apache License, Version 2.0; under the mit-license", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 */", "cc by ncx CC BY-NC", "SPDX-License-Identifier: MIT OR"]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df).collect()}
    assert got[0] == (13, 3, 0, 9, "apache-2,mit", "apache-2,mit", 1.0)
    assert got[1][-3:] == ("", "apache-2,gpl-3,mit", 1.0)
    assert got[2][1:5] == (1, 3, 3, "cc-by-nc") and got[3][-2:] == ("", 0.5)
    assert got[4] == got[5] == (0, 0, None, None, "", "", 0.5)
    assert licenses.scan(empty).count() == 0
    for r in licenses.scan(corpus[0].where("doc_id < 200")).collect():
        text = next(t for i, t in corpus[1] if i == r.doc_id)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
        places = [k for p in licenses.BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))


def test_tiles_cover_reordered_passages(spark, empty):
    number = lambda text: np.array([hash(w) & (2**63 - 1) for w in text.split()], np.uint64)
    assert decontaminate.tile(number("z a b c d y e f g z"), number("e f g x a b c d"), 3) == [(1, 4, 4), (6, 0, 3)]
    item = " ".join(f"w{i}" for i in range(24))
    moved = " ".join([*(f"w{i}" for i in range(12, 24)), "other", *(f"w{i}" for i in range(12))])
    docs = [(1, f"before {item.upper()}, after"), (2, moved), (3, "w1 w2 w3 w4 w5 w6"), (4, None), (5, ""), (6, "s1 s2 s3"), (6, "x"), (None, item)]
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "s1 s2 s3"), (7, item)], "item_id long, text string")
    got = {(r.doc_id, r.contaminated) for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, True), (2, True), (3, False), (4, False), (5, False), (6, True), (None, False)}
    assert decontaminate.decontaminate(empty, items).count() == 0


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**7, None), (10**7, ""), (None, "a")], "doc_id long, text string"))
    got = quality.score_quality(more, labels).toPandas()
    assert len(got) == docs.count() + 3 and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.9
    none = quality.score_quality(more, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_language_of_pages(spark):
    folder = "/root/testdata/sf0.001"
    names, model = language.train(spark.read.parquet(f"{folder}/documents.parquet"))
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    odd = [(10**6, None, None), (10**6 + 1, "nowhere", ""), (10**6 + 2, "http://a.example.com/", '<html lang="xx">')]
    got = language.identify(pages.unionByName(spark.createDataFrame(odd, pages.schema)), names, model)
    right = got.join(pages.select("page_id", F.regexp_extract("url", "https?://[^/]+/([a-z]*)", 1).alias("own")), "page_id")
    assert right.where("own = language").count() >= 0.97 * pages.count()
    assert got.count() == pages.count() + 3 and got.where("language is null").count() == 0
    assert language.identify(pages, [], np.zeros((0, 4))).where("language is not null").count() == 0


def test_secrets(spark, empty):
    draw = np.random.default_rng(2)
    key = lambda: "".join(draw.choice(list("0123456789abcdef"), 40))
    docs = [(i, f'some words here token = "{key()}" and more') for i in range(60)] + [(100 + i, f"commit {key()} was merged") for i in range(60)]
    docs += [(300, None), (301, ""), (302, "x" * 50_000), (303, docs[0][1])]
    df = spark.createDataFrame([(i, t, "src") for i, t in docs], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.find_secrets(df, F.col("source")).collect()}
    assert all(got[i].n_secrets == 1 and got[100 + i].n_secrets == 0 for i in range(60))
    start, end, _ = got[303].secrets[0]
    assert docs[0][1][start - 1] == docs[0][1][end] == '"' and got[300].n_secrets == got[301].n_secrets == got[302].n_candidates == 0
    assert secret_scan.find_secrets(empty, F.col("source")).count() == 0


def test_empty_tables(spark, empty):
    assert substrings.remove_repeated(empty).count() == 0
    assert jaccard.similar_groups(empty).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
