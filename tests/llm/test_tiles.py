"""Greedy string tiling against its plain form, on repetitive sequences, and coverage of whole tables by brute force."""

import os
import re
import sys
import time

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))

from skyqa.llm import decontaminate  # noqa: E402


def plain_tiles(doc, item, shortest):
    """Mark the longest common run of unmarked words, the first in ``doc`` and then in ``item``, until none is long enough."""
    free_doc, free_item, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        run = [[0] * (len(item) + 1) for _ in range(len(doc) + 1)]
        for i in range(len(doc) - 1, -1, -1):
            for j in range(len(item) - 1, -1, -1):
                if free_doc[i] and free_item[j] and doc[i] == item[j] and doc[i]:
                    run[i][j] = run[i + 1][j + 1] + 1
        for i in range(len(doc)):
            for j in range(len(item)):
                if run[i][j] > best[2]:
                    best = (i, j, run[i][j])
        if best[2] < shortest:
            return tiles
        i, j, n = best
        free_doc[i : i + n], free_item[j : j + n] = [False] * n, [False] * n
        tiles.append(best)


def test_equal_to_plain_greedy_tiling():
    draw = np.random.default_rng(4)
    for _ in range(2000):
        letters = int(draw.integers(1, 6))
        doc, item = (draw.integers(0 if letters > 2 else 1, letters + 1, int(draw.integers(0, 26))) for _ in range(2))
        shortest = int(draw.integers(1, 5))
        want = plain_tiles(doc.tolist(), item.tolist(), shortest)
        assert decontaminate.tile(doc.astype(np.uint64), item.astype(np.uint64), shortest) == want


def test_repetitive_and_long_sequences_take_no_pairs():
    one = np.full(20_000, 7, np.uint64)
    draw = np.random.default_rng(2)
    many = draw.integers(1, 1 << 62, 32_000).astype(np.uint64)
    few = draw.integers(1, 3, 20_000).astype(np.uint64)
    start = time.perf_counter()
    assert decontaminate.tile(one, one[:5000]) == [(0, 0, 5000)]
    assert time.perf_counter() - start < 1
    assert decontaminate.tile(many, many) == [(0, 0, 32_000)]
    assert sum(n for _, _, n in decontaminate.tile(few, few[::-1][:3000].copy())) > 1500
    assert time.perf_counter() - start < 20


def test_coverage_is_that_of_plain_tiling(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    draw = np.random.default_rng(9)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(draw.choice(words[:25], int(n)))) for k, n in enumerate([3, 5, 12, 20, 20, 30])]
    items += [(6, None), (7, ""), (None, "w1 w2 w3 w4 w5 w6"), (2, items[2][1])]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(int(draw.integers(0, 5))):
            text = (items[int(draw.integers(0, 6))][1]).split()
            a = int(draw.integers(0, len(text)))
            parts += text[a : a + int(draw.integers(3, 25))] + list(draw.choice(words, int(draw.integers(0, 4))))
        docs.append((k, " ".join(parts).upper() + "!"))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "w1 " * 3000), (103, items[4][1]), (103, items[3][1])]
    held = {i: re.findall(r"[a-z0-9]+", t) for i, t in items if t and i is not None}
    want = {}
    for d, t in docs:
        own = re.findall(r"[a-z0-9]+", (t or "").lower())
        if d is None or len(own) > 1000:
            continue
        for i, item in held.items():
            seed = min(5, len(item))
            runs = {tuple(item[k : k + seed]) for k in range(len(item) - seed + 1)}
            if any(tuple(own[k : k + seed]) in runs for k in range(len(own) - seed + 1)):
                share = sum(n for _, _, n in plain_tiles(own, item, seed)) / len(item)
                want[d, i] = max(share, want.get((d, i), 0))
    got = decontaminate.coverage(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert {(r.doc_id, r.item_id): r.covered for r in got.collect() if r.doc_id != 102} == want
    assert len(want) > 40
