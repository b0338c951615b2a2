"""Positional matching and the match table. The SQL compares all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalogue import crowded_pair, first_cat, r, rounded, second_cat, table, with_ctes
from checks.registry import SQL, check
from skyqa.functions.frames import scratch_path
from skyqa.functions.observed import Watch
from skyqa.operators.match import (
    match_counts,
    match_difference,
    match_pivot,
    match_table_values,
    neighbours,
    sky_match,
)


def _vec(table_name: str, where: str = "true") -> str:
    return f"""select id, cos(radians(ra)) * cos(radians("dec")) as x, sin(radians(ra)) * cos(radians("dec")) as y,
    sin(radians("dec")) as z from {table_name} where {where}"""


_PAIRS = "select v.id as id, w.id as id_2, sqrt(power(v.x - w.x, 2) + power(v.y - w.y, 2) + power(v.z - w.z, 2)) as chord from v, w"


def knn(v: str, w: str, radius: str, k: int) -> dict[str, str]:
    return {
        "v": v,
        "w": w,
        "near": f"""select *, row_number() over (partition by id order by chord, id_2) as neighbour from ({_PAIRS}) p
        where chord < 2 * sin(radians({radius}) / 2) qualify neighbour <= {k}""",
        "matched": """select v.id as id, cast(coalesce(neighbour, 1) as int) as neighbour, id_2,
        degrees(2 * asin(chord / 2)) as distance from v left join near on v.id = near.id""",
    }


_FIRST_PRIMARY, _SECOND_PRIMARY = _vec("first_cat", '"detect_isPrimary"'), _vec("second_cat", '"detect_isPrimary"')
_ARCSEC2 = knn(_FIRST_PRIMARY, _SECOND_PRIMARY, "2e0 / 3600", 1)


@check(
    "sky_match_knn",
    with_ctes(
        f"select id, neighbour, id_2, {r('distance', digits=8)} from matched",
        "first_cat",
        "second_cat",
        **knn(_vec("first_cat"), _vec("second_cat"), "5e0", 3),
    ),
)
def _(spark, sf):
    return rounded(neighbours(first_cat(spark, sf), second_cat(spark, sf), 5.0, 3), 8)


# every position lies in one crowded cube, and most positions have copies
@check(
    "sky_match_crowded",
    with_ctes(
        f"select id, neighbour, id_2, {r('distance', digits=8)} from matched",
        "crowd_a",
        "crowd_b",
        **knn(_vec("crowd_a"), _vec("crowd_b"), "5e-1", 2),
    ),
)
def _(spark, sf):
    left, right = crowded_pair(spark, sf)
    return rounded(neighbours(left, right, 0.5, 2), 8)


@check(
    "sky_match",
    with_ctes(
        f"select id, id_2 as match_id, {r('distance * 3600', 'match_distance')} from matched",
        "first_cat",
        "second_cat",
        **_ARCSEC2,
    ),
)
def _(spark, sf):
    return rounded(sky_match(first_cat(spark, sf), second_cat(spark, sf), 2.0))


@check(
    "sky_match_counts",
    with_ctes(
        "select count(id_2) as n_matched, count(*) - count(id_2) as n_unmatched from matched",
        "first_cat",
        "second_cat",
        **_ARCSEC2,
    ),
)
def _(spark, sf):
    return match_counts(sky_match(first_cat(spark, sf), second_cat(spark, sf), 2.0))


# the same counts, observed while the match is written
@check("sky_match_observed", SQL["sky_match_counts"])
def _(spark, sf):
    watch = Watch()
    matched = sky_match(first_cat(spark, sf), second_cat(spark, sf), 2.0, watch=watch)
    matched.write.parquet(scratch_path(spark, "match"))
    found = watch.counts()["match"]
    return spark.createDataFrame([(found["n_matched"], found["n_unmatched"])], "n_matched long, n_unmatched long")


@check(
    "match_difference",
    with_ctes(
        f"""select a.id as id, {r('a.ra', 'ra')}, {r('a."dec"', 'dec')},
        {r('b.shape - a.shape', 'shape')},
        {r('(b."kron_magDiff" + b."psfMag") - (a."kron_magDiff" + a."psfMag")', 'kron_mag')},
        {r('m.distance * 3600', 'match_distance')}
        from first_cat a left join (select * from matched where id_2 is not null) m on a.id = m.id
        left join second_cat b on m.id_2 = b.id""",
        "first_cat",
        "second_cat",
        **_ARCSEC2,
    ),
)
def _(spark, sf):
    return rounded(
        match_difference(first_cat(spark, sf), second_cat(spark, sf), ["shape", "kron_magDiff"], 2.0, ["ra", "dec"])
    )


# match table: the first order of each customer and month is the matched source

_OBJECTS = "select c_custkey as object_id from customer where c_acctbal > 0"
_MATCHES = """select o_custkey as object_id, month(o_orderdate) as visit, min(o_orderkey) as match_id
from orders group by 1, 2"""
_SOURCES = "select month(o_orderdate) as visit, o_orderkey as match_id, o_totalprice as price from orders"
_LONG = """select m.object_id as object_id, cast(m.visit as int) as visit, price from matches m
join objects o on m.object_id = o.object_id join sources s on m.visit = s.visit and m.match_id = s.match_id"""
_TABLES = {"objects": _OBJECTS, "matches": _MATCHES, "sources": _SOURCES}


def _long(spark, sf):
    objects = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("object_id"), (F.col("c_acctbal") > 0).alias("calib_psf_used")
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("object_id"),
        F.month("o_orderdate").alias("visit"),
        F.col("o_orderkey").alias("match_id"),
        F.col("o_totalprice").alias("price"),
    )
    links = orders.groupBy("object_id", "visit").agg(F.min("match_id").alias("match_id"))
    return match_table_values(objects, links, orders.drop("object_id"), "price")


@check("match_table_values", with_ctes(f"select object_id, visit, {r('price')} from ({_LONG}) t", **_TABLES))
def _(spark, sf):
    return rounded(_long(spark, sf))


@check(
    "match_pivot",
    with_ctes(
        "select object_id, "
        + ", ".join(r(f"max(case when visit = {v} then price end)", f"visit_{v}") for v in range(1, 13))
        + f" from ({_LONG}) t group by object_id",
        **_TABLES,
    ),
)
def _(spark, sf):
    return rounded(match_pivot(_long(spark, sf), range(1, 13), "price"))
