import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skyqa.functions.quantiles import ARRAY_CELLS, describe_columns, quantiles
from skyqa.operators.stats import (
    PERCENTILES,
    colour_range,
    describe_by_key,
    dimension_ranges,
    info_counts,
    percentile_label,
    selection_title,
    summary_table,
)

PROBS = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]


def wanted(pdf, keys, columns):
    rows = {}
    groups = [((), pdf)] if not keys else pdf.groupby(keys, dropna=False)
    for key, g in groups:
        for c in columns:
            v = g[c].replace([np.inf, -np.inf], np.nan).dropna()
            rows[(*key, c)] = (len(v), *([v.quantile(p) for p in PROBS] if len(v) else [None] * len(PROBS)))
    return rows


def check(df, pdf, keys, columns, limit, cells=ARRAY_CELLS):
    got = describe_columns(df, keys, columns, PROBS, max_group_rows=limit, array_cells=cells).collect()
    want = wanted(pdf, keys, columns)
    assert len(got) == len(want)
    for r in got:
        w = want[(*[r[k] for k in keys], r.metric)]
        assert r["count"] == w[0]
        for a, b in zip(r.q, w[1:], strict=True):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12, abs=1e-12)


# arrays; the sorted window; some groups split; all groups split
@pytest.mark.parametrize(("limit", "cells"), [(10**6, 10**6), (10**6, 0), (400, 0), (7, 0)])
def test_grouped_against_pandas(spark, limit, cells):
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame(
        {
            # one key holds most of the rows, one a single row
            "k": np.r_[np.zeros(n - 301), np.ones(300), [2.0]].astype("int64"),
            "heavy_tail": rng.lognormal(0, 6, n) * rng.choice([-1, 1], n),
            # one value makes up most of the column
            "tied": np.where(rng.random(n) < 0.7, 0.0, rng.normal(size=n)),
            "constant": np.full(n, 4.25),
            "gappy": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)),
            "empty": np.full(n, np.nan),
        }
    )
    pdf.loc[5, "heavy_tail"] = np.inf
    columns = [c for c in pdf.columns if c != "k"]
    df = spark.createDataFrame(pdf).repartition(6)
    check(df, pdf, ["k"], columns, limit, cells)
    check(df, pdf, [], columns, limit, cells)


def test_many_keys_take_the_whole_row_exchange(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 200, 2000), "a": rng.normal(size=2000), "b": rng.integers(0, 5, 2000)})
    df = spark.createDataFrame(pdf)
    for cells in (0, ARRAY_CELLS):
        check(df, pdf, ["k"], ["a", "b"], 10**6, cells)
        made = describe_columns(df, ["k"], ["a", "b"], PROBS, array_cells=cells)
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60),
    st.integers(1, 50),
)
def test_split_equals_sorted(spark, values, limit):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles(df, [], ["v"], PROBS, max_group_rows=limit).collect()[0].q
    assert got == pytest.approx([float(np.quantile(values, p)) for p in PROBS], rel=1e-9, abs=1e-9)


def test_null_keys_stay_a_group(spark):
    rows = [(None, float(i)) for i in range(50)] + [("x", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for limit in (1000, 10):
        got = {r.k: (r["count"], r.q[0]) for r in describe_columns(df, ["k"], ["v"], [0.5], max_group_rows=limit).collect()}
        assert got == {None: (50, 24.5), "x": (1, 1.0)}


@pytest.mark.parametrize("limit", [10**6, 2])
def test_describe_is_complete_case(spark, limit):
    rows = [
        ("a", 1, 1.0, 10.0, True),
        ("a", 1, 3.0, 20.0, True),
        ("a", 1, None, 30.0, True),
        ("a", 1, 5.0, float("inf"), True),
        ("a", 1, 7.0, 40.0, None),
        ("b", 1, 2.0, 2.0, False),
        ("c", 2, None, 1.0, True),
    ]
    df = spark.createDataFrame(rows, "filter string, tract int, m double, n double, flag boolean")
    got = describe_by_key(df, ["filter", "tract"], max_group_rows=limit)
    assert got.columns == ["filter", "tract", "statistic", "m", "n"]
    table = {(r.filter, r.statistic): (r.m, r.n) for r in got.collect()}
    assert len(table) == 3 * (5 + len(PERCENTILES))
    assert table["a", "count"] == (2.0, 2.0)
    assert table["a", "mean"] == (2.0, 15.0)
    assert table["a", "std"] == pytest.approx((2.0**0.5, 50.0**0.5))
    assert table["a", "25%"] == (1.5, 12.5)
    # one row: no std
    assert table["b", "std"] == (None, None) and table["b", "99%"] == (2.0, 2.0)
    # no complete row: the key stays
    assert table["c", "count"] == (0.0, 0.0) and table["c", "mean"] == (None, None)


def test_labels():
    assert [percentile_label(p) for p in PERCENTILES] == ["1%", "5%", "25%", "50%", "75%", "95%", "99%"]


def test_ranges_from_stats_and_data(spark):
    df = spark.createDataFrame([(float(i), float(i), 10.0 * i) for i in range(101)], "ra double, m double, extra double")
    stats = describe_by_key(df.selectExpr("'a' as filter", "ra", "m"), ["filter"])
    got = {r.column: (r.lo, r.hi) for r in dimension_ranges(df, stats, ["m", "extra"], ["ra"]).collect()}
    assert got == {"ra": (0.0, 100.0), "m": (1.0, 99.0), "extra": (10.0, 990.0)}
    plain = {r.column: (r.lo, r.hi) for r in dimension_ranges(df, stats, ["m", "extra"], ["ra"], None).collect()}
    assert plain == {"ra": (0.0, 100.0), "m": (0.0, 100.0), "extra": (0.0, 1000.0)}


def test_colour_range_override_wins(spark):
    df = spark.createDataFrame([(float(i), 1.0, 2.0) for i in range(1001)], "m double, ra double, dec double")
    got = {r.column: (r.lo, r.hi) for r in colour_range(df, "m", override={"ra": (0, 9)}).collect()}
    assert got == {"m": (5.0, 995.0), "ra": (0.0, 9.0), "dec": (2.0, 2.0)}


def test_summary_and_title(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "m double")
    got = {r.statistic: r.m for r in summary_table(df, ["m"]).collect()}
    assert got["count"] == 3.0 and got["mean"] == pytest.approx(7 / 3)
    assert selection_title(df, "m").collect()[0].title == "mean = 2.333, std = 1.528 (3)"


def test_info_counts_use_active_tracts(spark):
    coadd = spark.createDataFrame([("r", 1), ("g", 1), ("r", 2)], "filter string, tract int")
    visit = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "tract int, visit int")
    objects = spark.range(5)
    assert tuple(info_counts(coadd, visit, objects).collect()[0]) == (2, 3, 5)
    assert tuple(info_counts(coadd, visit, None, [1]).collect()[0]) == (1, 2, 0)
