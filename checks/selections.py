"""Ingest steps, filters, slices and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalogue import KEYS, METRICS, VALUES, VISIT_KEYS, catalogue, r, raw_catalogue, rounded, table, with_ctes
from checks.registry import check
from checks.statistics import STATE, STATE_SQL, _others, describe_sql
from skyqa.operators.filters import (
    FilterState,
    coadd_slice,
    query_filter,
    sky_points,
    state_filter,
    stats_slice,
    visit_slice,
    visits_long,
)
from skyqa.operators.ingest import (
    complete_cases,
    decimate,
    derived_column,
    normalize,
    project_columns,
    sample_fraction,
    sample_per_key,
    union_with_key,
)
from skyqa.operators.stats import describe_by_key
from skyqa.sources.readers import load_key, scan

_KEY_COLUMNS = "band, tract, visit, patch"
_VALUES_SQL = ", ".join(r(f'"{c}"', c) for c in VALUES)
_FLAGS_SQL = "flag_used, flag_bad"
_ROW = f"{_KEY_COLUMNS}, {_VALUES_SQL}, {_FLAGS_SQL}"


@check(
    "normalize",
    with_ctes(
        f"""select {_KEY_COLUMNS}, {_FLAGS_SQL}, {r('coord_ra')}, {r('coord_dec')},
        {r('degrees(coord_ra)', 'ra')}, {r('degrees(coord_dec)', 'dec')},
        {r('case when flux > 0 then -2.5e0 * log10(flux) end', 'psfMag')},
        {r('flux')}, {r('metric_a')}, {r('metric_b')} from cat""",
        "cat",
    ),
)
def _(spark, sf):
    return rounded(normalize(raw_catalogue(spark, sf), flux="flux"))


@check(
    "project_dataset",
    with_ctes(
        f"""select {r('coord_dec')}, {r('coord_ra')}, flag_bad, flag_used, {r('metric_a')}, patch,
        visit, band, tract from cat""",
        "cat",
    ),
)
def _(spark, sf):
    raw = raw_catalogue(spark, sf)
    flags, position = ["flag_used", "flag_bad"], ["coord_ra", "coord_dec", "patch"]
    return rounded(project_columns(raw, METRICS, flags, position, VISIT_KEYS, without=["metric_b"]))


@check("complete_cases", with_ctes(f'select {_ROW} from nrm where metric_b is not null and "psfMag" is not null', "nrm"))
def _(spark, sf):
    return rounded(complete_cases(catalogue(spark, sf)))


@check(
    "derived_column",
    with_ctes(
        f"""select {_KEY_COLUMNS}, {r('"psfMag" - metric_a / 1e1 + coalesce(metric_b, 0)', 'colour')} from nrm""", "nrm"
    ),
)
def _(spark, sf):
    made = derived_column(catalogue(spark, sf), "colour", "psfMag - metric_a / 1e1 + coalesce(metric_b, 0)")
    return rounded(made.select(*VISIT_KEYS, "patch", "colour"))


@check(
    "derived_column_events",
    f"select event_id, {r('value * 1.8e0 + 3.2e1', 'warm')}, hour(ts) as visit from events",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    made = derived_column(derived_column(events, "warm", "value * 1.8e0 + 3.2e1"), "visit", "cast(hour(ts) as bigint)")
    return rounded(made.select("event_id", "warm", "visit"))


_COADD_ROW = f"{r('metric_a')}, {r('metric_b')}, flag_used, flag_bad, {r('ra')}, {r('dec')}, band, {r('psfMag')}, patch"
_COADD = ["ra", "dec", "band", "psfMag", "patch"]
_COMPLETE = 'metric_a is not null and metric_b is not null and "psfMag" is not null'


@check(
    "coadd_slice", with_ctes(f"select {_COADD_ROW} from nrm where band = 'A' and tract in (3, 5, 8) and {_COMPLETE}", "nrm")
)
def _(spark, sf):
    rows, _warnings = coadd_slice(
        catalogue(spark, sf), "A", METRICS, [3, 5, 8, -1], filter_name="band", tract_name="tract", columns=_COADD
    )
    return rounded(rows)


@check("coadd_slice_all_tracts", with_ctes(f"select {_COADD_ROW} from nrm where band = 'N' and {_COMPLETE}", "nrm"))
def _(spark, sf):
    rows, _warnings = coadd_slice(
        catalogue(spark, sf), "N", METRICS, [-1, -2], filter_name="band", tract_name="tract", columns=_COADD
    )
    return rounded(rows)


_VISIT_ROW = (
    f"band, tract, visit, flag_used, flag_bad, {r('ra')}, {r('dec')}, {r('psfMag')}, {r('metric_a')}, {r('metric_b')}"
)
_VISIT = ["band", "tract", "visit", "flag_used", "flag_bad", "ra", "dec", "psfMag"]


@check(
    "visit_slice",
    with_ctes(f"select {_VISIT_ROW} from nrm where band = 'R' and metric_a is not null and metric_b is not null", "nrm"),
)
def _(spark, sf):
    return rounded(visit_slice(catalogue(spark, sf), "R", METRICS, filter_name="band", columns=_VISIT))


@check(
    "visit_slice_one",
    with_ctes(
        f"select {_VISIT_ROW} from nrm where band = 'R' and visit = 7 and metric_a is not null and metric_b is not null",
        "nrm",
    ),
)
def _(spark, sf):
    return rounded(visit_slice(catalogue(spark, sf), "R", METRICS, 7, filter_name="band", columns=_VISIT))


@check(
    "visits_long",
    with_ctes(
        " union all ".join(
            f"select band, tract, visit, '{m}' as metric, {r(m, 'value')} from nrm where {m} is not null"
            for m in ("metric_a", "metric_b", "flux")
        ),
        "nrm",
    ),
)
def _(spark, sf):
    long, _missing = visits_long(catalogue(spark, sf), VISIT_KEYS, [*METRICS, "flux", "metric_z"])
    return rounded(long)


@check("state_filter", with_ctes(f"select {_ROW} from nrm where {STATE_SQL}", "nrm"))
def _(spark, sf):
    return rounded(state_filter(catalogue(spark, sf), STATE))


@check(
    "box_select",
    with_ctes(
        f"""select {_ROW} from nrm where ra >= 1e2 and ra < 2e2 and metric_a >= 5 and metric_a < 45
        and "dec" >= -2e1 and "dec" < 4e1 and flag_used and not flag_bad""",
        "nrm",
    ),
)
def _(spark, sf):
    # the box replaces the older range of ra; metric_a keeps its own
    return rounded(state_filter(catalogue(spark, sf), STATE.with_box("ra", "dec", (100.0, -20.0, 200.0, 40.0))))


@check(
    "sky_points",
    with_ctes(
        f"""select {r('ra')}, {r('dec')}, {r('metric_a')}, {r('metric_b')}, {r('mag')}, patch, tract
        from (select *, -"psfMag" as mag from nrm) t
        where band = 'N' and mag >= 0 and mag < 11 and flag_used and {_COMPLETE}""",
        "nrm",
    ),
)
def _(spark, sf):
    cat = catalogue(spark, sf).withColumn("mag", -F.col("psfMag"))
    state = FilterState(flags=("flag_used",))
    return rounded(sky_points(cat, METRICS, 11.0, "N", "mag", state, label_name="band"))


@check(
    "query_filter",
    with_ctes(
        f"select {_ROW} from nrm where flag_used and not flag_bad and (metric_a > 40 or flux < 0 and patch = 3)", "nrm"
    ),
)
def _(spark, sf):
    return rounded(
        query_filter(
            catalogue(spark, sf), {"flag_used": True, "flag_bad": False}, "metric_a > 40 or flux < 0 and patch = 3"
        )
    )


@check(
    "stats_slice",
    with_ctes(
        f"""select * exclude (band, tract) from {describe_sql('nrm', KEYS, VALUES, _others(KEYS))}
        where band = 'A' and tract in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)""",
        "nrm",
    ),
)
def _(spark, sf):
    stats = describe_by_key(catalogue(spark, sf), KEYS, VALUES)
    return rounded(stats_slice(stats, "A", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], "band", drop_keys=True))


@check(
    "scan_pruned",
    f"""select l_orderkey, l_partkey, {r('l_extendedprice')} from lineitem
    where (l_returnflag = 'A' and l_linenumber in (1, 4)) or (l_returnflag = 'N' and l_quantity > 40)""",
)
def _(spark, sf):
    tests = [
        [("l_returnflag", "==", "A"), ("l_linenumber", "in", [1, 4])],
        [("l_returnflag", "==", "N"), ("l_quantity", ">", 40)],
    ]
    return rounded(scan(spark, f"{sf}/lineitem.parquet", tests, ["l_orderkey", "l_partkey", "l_extendedprice"]))


@check(
    "load_key",
    f"""select l_orderkey, l_suppkey, {r('l_quantity')} from lineitem
    where l_returnflag = 'R' and l_linenumber = 3""",
)
def _(spark, sf):
    key = {"l_returnflag": "R", "l_linenumber": 3}
    return rounded(load_key(spark, f"{sf}/lineitem.parquet", key, ["l_orderkey", "l_suppkey", "l_quantity"], True))


@check("union_with_key", with_ctes(f"select {_ROW} from nrm", "nrm"))
def _(spark, sf):
    cat = catalogue(spark, sf)
    visits = [row[0] for row in cat.select("visit").distinct().collect()]
    return rounded(union_with_key({v: cat.where(F.col("visit") == v).drop("visit") for v in visits}, "visit"))


# an integer hash that both engines can compute
_MIX = "(c_custkey * 48271 + 7) % 2147483647"


@check("sample_fraction", f"select c_custkey, c_nationkey from customer where {_MIX} % 1000000 < 250000")
def _(spark, sf):
    return sample_fraction(table(spark, sf, "customer"), 0.25, by=F.expr(_MIX)).select("c_custkey", "c_nationkey")


@check(
    "sample_n_per_key",
    f"""select c_custkey, c_nationkey from customer
    qualify row_number() over (partition by c_nationkey order by {_MIX}, c_custkey) <= 5""",
)
def _(spark, sf):
    drawn = sample_per_key(table(spark, sf, "customer"), ["c_nationkey"], 5, "c_custkey", order=F.expr(_MIX))
    return drawn.select("c_custkey", "c_nationkey")


@check("decimate", f"select c_custkey, c_name from customer order by {_MIX}, c_custkey limit 500")
def _(spark, sf):
    return decimate(table(spark, sf, "customer"), "c_custkey", 500, order=F.expr(_MIX)).select("c_custkey", "c_name")
