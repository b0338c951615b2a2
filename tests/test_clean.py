import math

from skyqa.functions.clean import finite_or_null, is_complete, magnitude, named, null_non_finite
from skyqa.operators.ingest import complete_cases, derived_column, normalize, union_with_key

NAN, INF = float("nan"), float("inf")


def test_non_finite_become_null(spark):
    df = spark.createDataFrame([(1.0, 1), (NAN, 2), (INF, 3), (-INF, 4), (None, 5)], "v double, i int")
    got = df.select(finite_or_null(named("v")).alias("v"), "i").orderBy("i").collect()
    assert [r.v for r in got] == [1.0, None, None, None, None]
    assert null_non_finite(df, ["i"]).where("isnan(v)").count() == 1


def test_complete_needs_every_column(spark):
    rows = [(1.0, True, "p"), (NAN, True, "p"), (1.0, None, "p"), (1.0, True, None), (-INF, True, "p")]
    df = spark.createDataFrame(rows, "v double, f boolean, patch string")
    assert [r[0] for r in df.select(is_complete(df)).collect()] == [True, False, False, False, False]
    assert complete_cases(df).count() == 1
    assert complete_cases(df, ["patch"]).count() == 4


def test_magnitude_of_bad_flux(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (-5.0,), (INF,), (NAN,), (None,)], "f double")
    got = [r[0] for r in df.select(magnitude(named("f"))).collect()]
    assert got[0] == -5.0 and got[1:] == [None] * 5


def test_normalize(spark):
    df = spark.createDataFrame(
        [(math.pi, -math.pi / 2, 10.0, INF, "1,1", 7), (0.0, 0.0, 0.0, 2.0, "1,2", 8)],
        "coord_ra double, coord_dec double, base_PsfFlux_instFlux double, `Kron-PSF_magDiff_mmag` double, "
        "patchId string, ccdId int",
    )
    got = normalize(df).collect()
    assert (got[0].ra, got[0].dec, got[0].psfMag) == (180.0, -90.0, -2.5)
    assert got[0]["Kron-PSF_magDiff_mmag"] is None and got[1].psfMag is None
    assert (got[0].patch, got[0].ccd) == ("1,1", 7)
    assert "patchId" not in got[0].asDict()


def test_names_with_dots_and_dashes(spark):
    df = spark.createDataFrame([(1.0, INF)], "`a.b` double, `c-d` double")
    assert null_non_finite(df).collect()[0].asDict() == {"a.b": 1.0, "c-d": None}


def test_union_with_key_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    got = union_with_key({10: a, 20: b}, "visit").orderBy("visit").collect()
    assert [tuple(r[c] for c in ("x", "y", "visit")) for r in got] == [(1, None, 10), (2, 3, 20)]


def test_derived_column(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert derived_column(df, "c", "a * b + 1").collect()[0].c == 7.0
