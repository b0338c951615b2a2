"""Links of each text against brute force, whatever steers the work."""

import numpy as np
import pytest

import brute
from skyqa.llm import jaccard


def all_links(rows, percent=80, size=5):
    """``(doc_id, links of the row's set to other sets)`` of each ``(doc_id, text)``."""
    sets = []
    for _, t in rows:
        w = brute.SPACED.findall(brute.lower(t))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    known = {s for (i, _), s in zip(rows, sets, strict=True) if i is not None and s}
    n = {s: sum(100 * len(s & o) >= percent * len(s | o) for o in known) - 1 for s in known}
    return [(i, 0 if i is None else n.get(s, 0)) for (i, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize(("frequent", "block"), [(16, 2048), (2, 7)])
def test_every_link_is_counted(spark, monkeypatch, tmp_path, frequent, block):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    draw = np.random.default_rng(7)
    base = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "b"])), (3, " ".join([*base, "c"]))]  # three that are all similar
    rows += [(4, rows[1][1]), (5, rows[1][1].upper()), (2, "another row of that id"), (None, " ".join([*base, "d"])), (6, None), (7, "")]
    for group in range(2):
        for i in range(60):
            words = [f"g{group}_{k}" for k in range(120)]
            for k in draw.choice(120, int(draw.integers(1, 5)), replace=False):
                words[k] = f"y{draw.integers(1000)}"
            rows.append((100 * (group + 1) + i, " ".join(words)))
    for i in range(25):  # a chain: only neighbours are similar
        rows.append((1000 + i, " ".join(f"s{k}" for k in range(8 * i, 8 * i + 100))))
    got = [(r.doc_id, r.n_links) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(all_links(rows), key=order)
    assert {i: n for i, n in got if i in (1, 3, 4, 5)} == {1: 2, 3: 2, 4: 2, 5: 2}


def test_shared_tokens_of_dense_and_thin_blocks():
    draw = np.random.default_rng(3)
    for rows, cols, tokens, most in ((40, 50, 30, 20), (90, 80, 4000, 30), (1, 3, 10, 5), (150, 150, 6000, 400)):
        left, right = ([np.unique(draw.integers(0, tokens, draw.integers(1, most)).astype(np.uint64)) for _ in range(n)] for n in (rows, cols))
        want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
        assert jaccard._common(left, right).tolist() == want


def test_a_large_group_of_near_copies_is_not_verified_pair_by_pair(spark, monkeypatch, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    verify, sent = jaccard._verify, []

    def counted(pairs, *rest):
        sent.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verify", counted)
    draw = np.random.default_rng(11)
    rows = []
    for i in range(500):  # those with one other word link with one another, those with two only by chance
        words = [f"g{k}" for k in range(120)]
        for k in draw.choice(120, int(draw.integers(1, 3)), replace=False):
            words[k] = f"y{draw.integers(1000)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.n_links for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(all_links(rows))
    assert sum(got.values()) > 50_000
    assert sum(sent) < 8_000


@pytest.mark.parametrize("grow", [2, 8])
def test_few_partners_at_a_time_lose_no_link(spark, monkeypatch, tmp_path, grow):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 9)
    monkeypatch.setattr(jaccard, "PARTNERS", 1)
    monkeypatch.setattr(jaccard, "PARTNERS_GROW", grow)
    draw = np.random.default_rng(5)
    rows = []
    for i in range(150):  # most pairs are just below or above the threshold
        words = [f"g{k}" for k in range(100)]
        for k in draw.choice(100, int(draw.integers(1, 5)), replace=False):
            words[k] = f"y{draw.integers(30)}"
        rows.append((i, " ".join(words)))
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted(all_links(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute.groups(rows))


def test_likeliest_pairs_of_each_place():
    one, two = np.array([0, 0, 0, 1, 5]), np.array([1, 2, 3, 2, 6])
    share = np.array([0.5, 0.45, 0.4, 0.49, 0.41])
    assert jaccard._likeliest(one, two, share, 1).tolist() == [True, False, True, True, True]
    assert jaccard._likeliest(one, two, share, 3).all()
    assert jaccard._likeliest(one[:0], two[:0], share[:0], 1).tolist() == []


def test_a_component_asks_for_partners_once():
    draw = np.random.default_rng(13)
    cells = np.tile(draw.integers(0, 3, jaccard._CELLS), (33, 1))
    cells[np.arange(33), draw.integers(0, jaccard._CELLS, 33)] += 1
    rows = np.zeros((33, 7), np.int64)  # one list of 30 members of one component and three others
    rows[:, 4], rows[:, 5], rows[:, 6] = np.arange(33), cells.sum(axis=1), np.maximum(np.arange(33) - 29, 0)
    for partners, most in ((0, 3), (4, 16)):
        (pairs, more), = jaccard._fitting_pairs(rows, cells.astype(np.uint8), 80, partners)
        assert 3 <= len(pairs) <= most
        assert more.tolist() == [0]
    (pairs, more), = jaccard._fitting_pairs(rows, cells.astype(np.uint8), 80, 1000)
    assert len(pairs) == 30 * 3 + 3 and more.tolist() == []


def test_connecting_pairs_are_the_likeliest_forest():
    one, two = np.array([0, 0, 1, 3, 4, 3]), np.array([1, 2, 2, 4, 5, 5])
    share = np.array([0.4, 0.45, 0.5, 0.41, 0.41, 0.41])
    assert jaccard._connecting(one, two, share).tolist() == [False, True, True, True, False, True]
    assert jaccard._connecting(one[:0], two[:0], share[:0]).tolist() == []
    draw = np.random.default_rng(1)
    for sides, pairs in ((40, 300), (200, 150)):
        one, two = np.sort(draw.integers(0, sides, (2, pairs)), axis=0)
        one, two = one[one != two], two[one != two]
        share = draw.integers(1, 20, len(one)) / 40
        root, kept = list(range(sides)), []
        for k in np.lexsort((two, one, -share)).tolist():  # the likeliest first, unless connected already
            a, b = root[one[k]], root[two[k]]
            if a != b:
                root = [a if r == b else r for r in root]
                kept.append(k)
        assert np.flatnonzero(jaccard._connecting(one, two, share)).tolist() == sorted(kept)
