"""Kept summaries, statistics of several key sets from one pass, and how often the rows are read."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyqa.functions import quantiles
from skyqa.functions.frames import cut
from skyqa.functions.quantiles import describe_columns
from skyqa.functions.summaries import MARGIN, WHOLE_GROUP, Request, merged, refine, sample_std, summarise
from skyqa.operators import stats
from skyqa.operators.stats import KeySet, colour_range, describe_by_key, describe_sets, dimension_ranges, key_summaries


_SEEN = {}


def input_records(spark):
    """Records that all stages so far have read from files.

    Spark forgets old stages in a long session, so what was seen of them is kept; only differences mean anything.
    """
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    quantiles = gateway.new_array(gateway.jvm.double, 0)
    stages = store.stageList(gateway.jvm.java.util.ArrayList(), False, False, quantiles, gateway.jvm.java.util.ArrayList())
    for i in range(stages.size()):
        stage = stages.apply(i)
        _SEEN[spark.sparkContext.applicationId, stage.stageId(), stage.attemptId()] = stage.inputRecords()
    return sum(_SEEN.values())


@pytest.fixture
def field(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 20_000
    pdf = pd.DataFrame(
        {
            "band": np.where(rng.random(n) < 0.7, "a", "b"),
            "tract": rng.choice([1, 2, 3, 4], n, p=[0.6, 0.3, 0.0995, 0.0005]),
            "visit": rng.integers(0, 5, n),
            "tail": rng.lognormal(0, 5, n) * rng.choice([-1, 1], n),
            "tied": np.where(rng.random(n) < 0.6, 3.0, rng.normal(size=n)),
            "gappy": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)),
            "flag": rng.random(n) < 0.5,
        }
    )
    pdf.loc[7, "tail"] = np.inf
    spark.createDataFrame(pdf).repartition(6).write.parquet(f"{tmp_path}/rows")
    return spark.read.parquet(f"{tmp_path}/rows"), pdf.replace([np.inf, -np.inf], np.nan)


def close(row, skip):
    """The numbers of a row for a comparison; a gap is told from any value."""
    return pytest.approx([-1e300 if x is None else x for x in list(row)[skip:]], rel=1e-9)


def plain(row, skip):
    return [-1e300 if x is None else x for x in list(row)[skip:]]


PROBS = (0.0, 0.01, 0.3, 0.5, 0.99, 1.0)


@pytest.mark.parametrize("limit", [10**6, 40])
def test_one_pass_answers_requests_of_several_keys(spark, field, limit):
    df, pdf = field
    fine = cut(summarise(df, ["band", "tract"], ["tail", "tied", "gappy"]))
    some = cut(summarise(df, ["tract"], ["tail"], F.col("flag")))
    before = input_records(spark)
    found = refine(
        df,
        [
            Request(["band", "tract"], ["tail", "tied"], PROBS, fine),
            Request([], ["gappy", "tail"], (0.005, 0.995), cut(merged(fine, []))),
            Request(["tract"], ["tail"], (0.5,), some, F.col("flag")),
        ],
        limit,
    )
    got = [{tuple(r)[:-1]: r.q for r in f.collect()} for f in found]
    assert input_records(spark) - before == len(pdf)
    for (key, g), c in ((x, c) for x in pdf.groupby(["band", "tract"]) for c in ("tail", "tied")):
        assert got[0].pop((*key, c)) == pytest.approx([g[c].quantile(p) for p in PROBS], rel=1e-12)
    for c in ("gappy", "tail"):
        assert got[1].pop((c,)) == pytest.approx([pdf[c].quantile(p) for p in (0.005, 0.995)], rel=1e-12)
    for key, g in pdf[pdf.flag].groupby("tract"):
        assert got[2].pop((key, "tail")) == pytest.approx([g["tail"].quantile(0.5)], rel=1e-12)
    assert got == [{}, {}, {}]


def test_wrong_bounds_cost_a_pass_and_no_rows(spark, field):
    df, pdf = field
    other = summarise(df.withColumn("tail", F.col("tail") * 0 + 1e9), [], ["tail"])  # a sketch of other values
    (q,) = refine(df, [Request([], ["tail"], PROBS, cut(other))], 10**6)
    assert q.first().q == pytest.approx([pdf["tail"].quantile(p) for p in PROBS], rel=1e-12)


def test_merged_summaries_are_those_of_the_coarser_groups(spark, field):
    df, pdf = field
    held = key_summaries(df, ["band", "tract", "visit"], ["tail", "gappy"])
    assert {f.name for f in held.schema} >= {"band", "tract", "visit", "metric", "complete", "rows", "count", "sketch"}
    rows = merged(held.where("not complete"), ["band"]).withColumn("std", sample_std()).collect()
    for r in rows:
        v = pdf[pdf.band == r.band][r.metric]
        assert (r.rows, r["count"]) == (len(v), v.count())
        assert (r["mean"], r["std"], r["min"], r["max"]) == pytest.approx((v.mean(), v.std(), v.min(), v.max()), rel=1e-9)
    sketch = merged(held.where("not complete and metric = 'gappy'"), [])
    near = sketch.select(F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("m")).first().m
    assert abs((pdf["gappy"].dropna() < near).mean() - 0.5) < MARGIN


@pytest.mark.parametrize("cells", [10**9, 0])
def test_sets_of_nested_keys(spark, field, cells):
    df, _ = field
    fewer = [c for c in df.columns if c not in ("gappy", "tract", "band", "visit")]
    sets = {
        "visit": KeySet(["tract", "band", "visit"], ["tail", "tied"]),
        "all": KeySet(["tract"], ["tail", "gappy"], (0.1, 0.9)),
        "fewer": KeySet(["tract", "band"], ["tail"], complete=fewer),
        "same": KeySet(["tract", "band"], ["tied"]),
    }
    before = input_records(spark)
    got = describe_sets(df, sets, array_cells=cells)
    rows = {n: t.collect() for n, t in got.items()}
    assert input_records(spark) - before <= (2 if cells else 3) * 20_000
    for name, s in sets.items():
        rows_of_set = df if name != "fewer" else df.select("tract", "band", *fewer)
        want = describe_by_key(rows_of_set, s.keys, s.columns, s.percentiles)
        assert got[name].columns == want.columns
        key = lambda r: tuple(str(x) for x in r[: len(s.keys) + 1])  # noqa: E731, B023
        for a, b in zip(sorted(rows[name], key=key), sorted(want.collect(), key=key), strict=True):
            assert key(a) == key(b) and plain(a, len(s.keys) + 1) == close(b, len(s.keys) + 1)


def test_sets_must_be_nested(spark, field):
    with pytest.raises(ValueError, match="not among"):
        describe_sets(field[0], {"a": KeySet(["band"], ["tail"]), "b": KeySet(["tract", "visit"], ["tail"])})
    kept = key_summaries(field[0], ["band"], ["tail"])
    with pytest.raises(ValueError, match="do not tell"):
        describe_sets(field[0], {"a": KeySet(["band"], ["tail"], complete=["flag"])}, summaries=kept)


def test_kept_summaries_save_the_first_pass(spark, field, tmp_path):
    df, _ = field
    key_summaries(df, ["band", "tract"], ["tail", "gappy"]).write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    sets = {"band": KeySet(["band"], ["tail"]), "both": KeySet(["band", "tract"], ["tail", "gappy"]), "all": KeySet([], ["gappy"], (0.2,), complete=())}
    before = input_records(spark)
    got = {n: t.collect() for n, t in describe_sets(df, sets, summaries=kept).items()}
    assert 20_000 <= input_records(spark) - before < 40_000  # the rows once, beside the few summaries
    for name, s in sets.items():
        want = describe_sets(df, {name: s})[name].collect()
        key = lambda r: tuple(str(x) for x in r[: len(s.keys) + 1])  # noqa: E731, B023
        for a, b in zip(sorted(got[name], key=key), sorted(want, key=key), strict=True):
            assert plain(a, len(s.keys) + 1) == close(b, len(s.keys) + 1)
    stats = spark.createDataFrame([("min", 0.0), ("max", 1.0)], "statistic string, ra double").cache()
    before = input_records(spark)
    a = dimension_ranges(df, stats, ["tail"], position=["ra"], summaries=kept).collect()
    assert 20_000 <= input_records(spark) - before < 40_000
    assert sorted(map(tuple, a)) == sorted(map(tuple, dimension_ranges(df, stats, ["tail"], position=["ra"]).collect()))


def test_kept_summaries_of_groups_without_a_finer_key(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", None, 5.0)], "k string, t int, v double")
    kept = key_summaries(df, ["k", "t"], ["v"])
    sets = {"k": KeySet(["k"], ["v"], (0.5,)), "t": KeySet(["k", "t"], ["v"], (0.5,)), "any": KeySet(["k"], ["v"], (0.5,), complete=())}
    for name, s in sets.items():
        want = describe_sets(df, {name: s})[name]
        got = describe_sets(df, sets, summaries=kept)[name]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_and_unfilled_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", float("nan"))], "k string, v double")
    got = {r.k: r for r in describe_columns(df, ["k"], ["v"], [0.5], summaries=cut(summarise(df, ["k"], ["v"]))).collect()}
    assert (got["a"]["count"], got["a"].q) == (0, [None]) and (got["b"]["count"], got["b"].q) == (1, [1.0])
    none = df.where("k = 'z'")
    assert describe_columns(none, [], ["v"], [0.5]).first()["count"] == 0
    assert describe_sets(none, {"x": KeySet(["k"], ["v"])})["x"].count() == 0
    assert colour_range(none, "v", position=[]).first().lo is None
    assert WHOLE_GROUP * MARGIN >= 4


@pytest.mark.parametrize(("name", "scans"), [("describe_large_groups", 2), ("colour_range", 2), ("dimension_ranges", 2), ("stats_union", 2), ("describe_by_key", 2)])
def test_scans_of_the_queries(spark, small, name, scans):
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    df = entry.queries()[name]
    before = input_records(spark)
    df(spark, small).collect()
    assert input_records(spark) - before <= scans * rows + 10  # a table of one row counts too


def test_large_sets_beside_small_groups(spark, field, monkeypatch):
    df, _ = field
    sets = {"fine": KeySet(["band", "tract"], ["tail", "gappy"]), "band": KeySet(["band"], ["tied", "gappy"], (0.1, 0.9)), "all": KeySet([], ["tail"], (0.01, 0.99), complete=())}
    by = df.groupBy("band", "tract").count().agg(F.max("count")).first()[0]
    key = lambda r, n: tuple(str(x) for x in r[: n + 1])
    summarised = []
    real = stats._masked_summaries
    monkeypatch.setattr(stats, "_masked_summaries", lambda *a: summarised.append(1) or real(*a))
    got = describe_sets(df, sets, array_cells=by * 5, max_group_rows=max(by, 2000))
    assert list(got) == list(sets) and not summarised  # no sketch for each of the small groups
    for name, s in sets.items():
        n = len(s.keys)
        a, b = (sorted(t.collect(), key=lambda r: key(r, n)) for t in (got[name], describe_sets(df, {name: s})[name]))
        assert [plain(r, n + 1) for r in a] == [close(r, n + 1) for r in b]


def test_small_groups_with_kept_summaries_are_not_refined(spark, field, monkeypatch):
    df, _ = field
    keys, columns = ["band", "tract"], ["tail", "gappy"]
    kept = cut(key_summaries(df, keys, columns))
    want = sorted(describe_by_key(df, keys, columns).collect(), key=lambda r: tuple(map(str, r[:3])))
    rows = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    with monkeypatch.context() as m:
        m.setattr(quantiles, "refine", None)  # each value would be exchanged by itself
        m.setattr(describe_columns, "__defaults__", (None, 1_000_000, rows * 2, None))
        got = sorted(describe_by_key(df, keys, columns, summaries=kept).collect(), key=lambda r: tuple(map(str, r[:3])))
    assert [tuple(r[:3]) for r in got] == [tuple(r[:3]) for r in want]
    assert [plain(r, 3) for r in got] == [close(r, 3) for r in want]
