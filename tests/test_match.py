import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skyqa.operators.match import (
    match_counts,
    match_difference,
    match_pivot,
    match_table_values,
    neighbours,
    sky_match,
)


def frame(ra, dec):
    return pd.DataFrame({"id": np.arange(len(ra)), "ra": np.asarray(ra, float), "dec": np.asarray(dec, float)})


def vectors(df):
    a, d = np.radians(df.ra.values), np.radians(df.dec.values)
    return np.c_[np.cos(a) * np.cos(d), np.sin(a) * np.cos(d), np.sin(d)]


def brute(left, right, radius, k):
    reach, b, out = 2 * math.sin(math.radians(radius) / 2), vectors(right), {}
    for i, a in zip(left.id, vectors(left), strict=True):
        chord = np.sqrt(((b - a) ** 2).sum(1))
        order = np.lexsort((right.id.values, chord))[:k]
        out[i] = [int(right.id.values[j]) for j in order if chord[j] < reach]
    return out


def found(spark, left, right, radius, k, leaf):
    got = neighbours(spark.createDataFrame(left), spark.createDataFrame(right), radius, k, leaf=leaf).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.id, r.neighbour)):
        out.setdefault(r.id, [])
        if r.id_2 is not None:
            out[r.id].append(r.id_2)
            assert r.distance < radius
    return out


def test_worked_example(spark):
    left, right = frame([1, 1], [2, 3]), frame([1.1, 1.2, 6], [2.1, 2.2, 10])
    got = neighbours(spark.createDataFrame(left), spark.createDataFrame(right), 0.3, 2).orderBy("id", "neighbour").collect()
    assert [(r.id, r.neighbour, r.id_2) for r in got] == [(0, 1, 0), (0, 2, 1), (1, 1, None)]
    assert [r.distance for r in got[:2]] == pytest.approx([0.1413761, 0.28274768], abs=1e-7)


def crowded(n, rng):
    """Half in a clump across RA 0 with many copies of one position, half around the pole."""
    half = n // 2
    made = frame(
        np.r_[rng.normal(0, 1e-3, half) % 360, rng.uniform(0, 360, n - half)],
        np.r_[rng.normal(10, 1e-3, half), rng.uniform(85, 90, n - half)],
    )
    made.loc[: n // 5, ["ra", "dec"]] = [0.0005, 10.0]
    return made


@pytest.mark.parametrize(("radius", "k", "leaf"), [(1.0, 1, 10_000), (1.0, 3, 8), (0.001, 2, 4), (180.0, 2, 32)])
def test_against_all_pairs(spark, radius, k, leaf):
    rng = np.random.default_rng(4)
    left, right = crowded(500, rng), crowded(700, rng)
    assert found(spark, left, right, radius, k, leaf) == brute(left, right, radius, k)


def test_two_clumps_apart(spark):
    rng = np.random.default_rng(5)
    left = frame(rng.normal(10, 1e-4, 400), rng.normal(0, 1e-4, 400))
    right = frame(rng.normal(10.5, 1e-4, 600), rng.normal(0, 1e-4, 600))
    assert found(spark, left, right, 1.0, 2, 16) == brute(left, right, 1.0, 2)


def test_equal_distances_take_the_lower_id(spark):
    left = frame([10.0], [0.0])
    right = pd.DataFrame({"id": [9, 4, 7, 2], "ra": [10.0] * 4, "dec": [0.0] * 4})
    for leaf in (100, 1):
        assert found(spark, left, right, 0.1, 3, leaf) == {0: [2, 4, 7]}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.floats(0.01, 30), st.integers(1, 3), st.sampled_from([2, 64]))
def test_any_field(spark, seed, radius, k, leaf):
    rng = np.random.default_rng(seed)
    left = frame(rng.uniform(355, 365, 60) % 360, rng.uniform(-90, -80, 60))
    right = frame(rng.uniform(355, 365, 80) % 360, rng.uniform(-90, -80, 80))
    assert found(spark, left, right, radius, k, leaf) == brute(left, right, radius, k)


@pytest.mark.parametrize("leaf", [4, 10_000])
def test_repeated_left_ids_are_rows_of_their_own(spark, leaf):
    rng = np.random.default_rng(8)
    left, right = frame(rng.uniform(0, 1, 120), rng.uniform(0, 1, 120)), frame(rng.uniform(0, 1, 200), rng.uniform(0, 1, 200))
    left["id"] %= 30
    left = pd.concat([left, left.head(40)], ignore_index=True)
    want = []
    for i in range(len(left)):
        row = left.iloc[[i]]
        near = brute(row, right, 0.1, 2)[row.id.iloc[0]]
        want += [(int(row.id.iloc[0]), n, r) for n, r in enumerate(near or [None], 1)]
    got = neighbours(spark.createDataFrame(left), spark.createDataFrame(right), 0.1, 2, leaf=leaf).collect()
    order = lambda t: (t[0], t[1], -1 if t[2] is None else t[2])
    assert sorted(((r.id, r.neighbour, r.id_2) for r in got), key=order) == sorted(want, key=order)


def test_missing_positions_and_empty_sides(spark):
    schema = "id long, ra double, dec double"
    left = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (3, 5.0, 5.0)], schema)
    got = neighbours(left, spark.createDataFrame([], schema), 1.0).orderBy("id").collect()
    assert [(r.id, r.id_2) for r in got] == [(1, None), (2, None), (3, None)]


CATALOGUE = "id long, ra double, dec double, detect_isPrimary boolean, psfMag double, x_magDiff double, m double, label string"


def catalogues(spark):
    left = spark.createDataFrame(
        [
            (1, 10.0, 0.0, True, 20.0, 1.0, 5.0, "star"),
            (2, 20.0, 0.0, True, 21.0, 2.0, 6.0, "star"),
            (3, 30.0, 0.0, False, 22.0, 3.0, 7.0, "galaxy"),
        ],
        CATALOGUE,
    )
    right = spark.createDataFrame(
        [
            (7, 10.0, 0.0001, True, 20.5, 1.5, 9.0, "galaxy"),
            (8, 10.0, 0.00001, False, 0.0, 0.0, 0.0, "star"),
            (9, 30.0, 0.0, True, 0.0, 0.0, 0.0, "star"),
        ],
        CATALOGUE,
    )
    return left, right


def test_only_primary_rows_match(spark):
    matched = sky_match(*catalogues(spark), radius_arcsec=0.5)
    got = {r.id: (r.match_id, r.match_distance) for r in matched.collect()}
    assert got[1][0] == 7 and got[1][1] == pytest.approx(0.36, abs=1e-9)
    assert got[2] == (None, None) and 3 not in got
    assert tuple(match_counts(matched).collect()[0]) == (1, 1)


def test_difference_is_second_minus_first(spark):
    left, right = catalogues(spark)
    got = match_difference(left, right, ["m", "x_magDiff"], 0.5, ["label"]).orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 3]
    assert got[0].m == 4.0 and got[0].x_mag == pytest.approx(1.0) and got[0].label == "star"
    assert got[1].m is None and got[2].m is None and got[2].match_distance is None


def test_catalogues_are_checked(spark):
    left, right = catalogues(spark)
    with pytest.raises(ValueError, match="detect_isPrimary"):
        sky_match(left.drop("detect_isPrimary"), right)
    with pytest.raises(ValueError, match="not unique"):
        sky_match(left.unionByName(left), right)


def test_match_table(spark):
    objects = spark.createDataFrame([(1, True), (2, False), (3, True)], "object_id long, calib_psf_used boolean")
    matches = spark.createDataFrame(
        [(1, 10, 100), (1, 11, None), (2, 10, 101), (3, 11, 102)], "object_id long, visit int, match_id long"
    )
    sources = spark.createDataFrame(
        [(10, 100, 1.5), (10, 101, 2.5), (11, 102, 3.5), (11, 100, 9.9)], "visit int, match_id long, m double"
    )
    long = match_table_values(objects, matches, sources, "m")
    assert sorted(tuple(r) for r in long.collect()) == [(1, 10, 1.5), (3, 11, 3.5)]
    wide = match_pivot(long, [10, 11], "m").orderBy("object_id").collect()
    assert [tuple(r) for r in wide] == [(1, 1.5, None), (3, None, 3.5)]
