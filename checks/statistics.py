"""Statistics tables, ranges and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalogue import KEYS, METRICS, VALUES, VISIT_KEYS, catalogue, r, raw_catalogue, rounded, with_ctes
from checks.registry import SQL, check
from skyqa.functions.frames import cut, scratch_path
from skyqa.operators.filters import FilterState
from skyqa.operators.schema import column_profile
from skyqa.operators.stats import (
    PERCENTILES,
    SHORT_PERCENTILES,
    KeySet,
    colour_range,
    describe_by_key,
    describe_sets,
    dimension_ranges,
    dimension_values,
    extent,
    info_counts,
    key_summaries,
    patch_count,
    percentile_label,
    selection_title,
    summary_table,
    union_stats,
)
from skyqa.sources.layout import write_stats

STATE = FilterState({"ra": (30.0, 300.0), "metric_a": (5.0, 45.0)}, flags=("flag_used",), bad_flags=("flag_bad",))
STATE_SQL = "ra >= 3e1 and ra < 3e2 and metric_a >= 5 and metric_a < 45 and flag_used and not flag_bad"

ALL = ["band", "tract", "visit", "patch", "ra", "dec", "psfMag", "flux", "metric_a", "metric_b"]


def describe_sql(source: str, keys: list[str], columns: list[str], others: list[str], probs=PERCENTILES) -> str:
    """Statistics rows by SQL: one aggregate per key, then one select per statistic."""
    ok = " and ".join(f'"{c}" is not null' for c in others)
    f = "filter (where ok)"
    parts = []
    for c in columns:
        q = f'"{c}"'
        parts.append(
            f'count({q}) {f} as "{c}|count", avg({q}) {f} as "{c}|mean", stddev_samp({q}) {f} as "{c}|std", '
            f'min({q}) {f} as "{c}|min", max({q}) {f} as "{c}|max"'
        )
        parts += [f'quantile_cont({q}, {p}) {f} as "{c}|{percentile_label(p)}"' for p in probs]
    key = ", ".join(keys)
    group = f"group by {key}" if keys else ""
    agg = f"select {key + ',' if keys else ''} {', '.join(parts)} from (select *, {ok} as ok from {source}) t {group}"
    stats = ["count", "mean", "std", "min", *[percentile_label(p) for p in probs], "max"]
    rows = [
        f"select {key + ',' if keys else ''} '{s}' as statistic, "
        + ", ".join(r(f'"{c}|{s}"', c) for c in columns)
        + " from agg"
        for s in stats
    ]
    return f"(with agg as ({agg}) {' union all '.join(rows)})"


def _others(keys: list[str], without: tuple[str, ...] = ()) -> list[str]:
    columns = [*ALL, "flag_used", "flag_bad"]
    return [c for c in columns if c not in keys and c not in without]


@check("describe_by_key", with_ctes(f"select * from {describe_sql('nrm', KEYS, VALUES, _others(KEYS))}", "nrm"))
def _(spark, sf):
    return rounded(describe_by_key(catalogue(spark, sf), KEYS, VALUES))


@check(
    "describe_by_visit", with_ctes(f"select * from {describe_sql('nrm', VISIT_KEYS, VALUES, _others(VISIT_KEYS))}", "nrm")
)
def _(spark, sf):
    return rounded(describe_by_key(catalogue(spark, sf), VISIT_KEYS, VALUES))


@check(
    "describe_short",
    with_ctes(f"select * from {describe_sql('nrm', ['band'], VALUES, _others(['band']), SHORT_PERCENTILES)}", "nrm"),
)
def _(spark, sf):
    return rounded(describe_by_key(catalogue(spark, sf), ["band"], VALUES, SHORT_PERCENTILES))


# the same answer when no group may be brought together
@check("describe_large_groups", with_ctes(f"select * from {describe_sql('nrm', ['band'], VALUES, _others(['band']))}", "nrm"))
def _(spark, sf):
    cat = catalogue(spark, sf)
    summaries = cut(key_summaries(cat, ["band"], VALUES))
    return rounded(describe_by_key(cat, ["band"], VALUES, max_group_rows=1000, summaries=summaries))


def summary_sql(columns: list[str], where: str) -> str:
    forms = {"count": "count({})::double", "mean": "avg({})", "std": "stddev_samp({})"}
    rows = [
        f"select '{s}' as statistic, " + ", ".join(r(f.format(f'"{c}"'), c) for c in columns) + f" from nrm where {where}"
        for s, f in forms.items()
    ]
    return with_ctes(" union all ".join(rows), "nrm")


@check("summary_table", summary_sql(VALUES, STATE_SQL))
def _(spark, sf):
    return rounded(summary_table(catalogue(spark, sf), VALUES, STATE))


@check(
    "selection_title",
    with_ctes(
        f"""select {r('avg(flux)', 'mean')}, {r('stddev_samp(flux)', 'std')}, count(*) as n,
        printf('mean = %.3f, std = %.3f (%d)', avg(flux), stddev_samp(flux), count(*)) as title
        from nrm where {STATE_SQL}""",
        "nrm",
    ),
)
def _(spark, sf):
    return rounded(selection_title(catalogue(spark, sf), "flux", STATE))


def _union_sql() -> str:
    forced = describe_sql("nrm", KEYS, VALUES, _others(KEYS), SHORT_PERCENTILES)
    fewer = [c for c in VALUES if c != "metric_b"]
    unforced = describe_sql("nrm", KEYS, fewer, _others(KEYS, ("metric_b",)), SHORT_PERCENTILES)
    visit = describe_sql("nrm", VISIT_KEYS, VALUES, _others(VISIT_KEYS), SHORT_PERCENTILES)
    out = ["band", "tract", "statistic", *VALUES]
    names = ", ".join(f'"{c}"' for c in out)
    gaps = ", ".join("cast(null as double) as metric_b" if c == "metric_b" else f'"{c}"' for c in out)
    return with_ctes(
        f"select 'coadd_forced' as dataset, {names}, cast(null as int) as visit from {forced} "
        f"union all select 'coadd_unforced', {gaps}, null from {unforced} "
        f"union all select 'visit', {names}, visit from {visit}",
        "nrm",
    )


@check("stats_union", _union_sql())
def _(spark, sf):
    fewer = [c for c in VALUES if c != "metric_b"]
    filled = [c for c in ALL + ["flag_used", "flag_bad"] if c not in [*KEYS, "metric_b"]]
    tables = describe_sets(
        catalogue(spark, sf),
        {
            "coadd_forced": KeySet(KEYS, VALUES, SHORT_PERCENTILES),
            "coadd_unforced": KeySet(KEYS, fewer, SHORT_PERCENTILES, filled),
            "visit": KeySet(VISIT_KEYS, VALUES, SHORT_PERCENTILES),
        },
    )
    return rounded(union_stats(tables))


@check(
    "dimension_ranges",
    with_ctes(
        f"""select col as "column", {r('lo')}, {r('hi')} from (
        select 'ra' as col, min(ra) filter (where statistic = 'min') as lo, max(ra) filter (where statistic = 'max') as hi from s
        union all select 'dec', min("dec") filter (where statistic = 'min'), max("dec") filter (where statistic = 'max') from s
        union all select 'psfMag', min("psfMag") filter (where statistic = 'min'), max("psfMag") filter (where statistic = 'max') from s
        union all select 'metric_a', min(metric_a) filter (where statistic = '1%'), max(metric_a) filter (where statistic = '99%') from s
        union all select 'metric_b', min(metric_b) filter (where statistic = '1%'), max(metric_b) filter (where statistic = '99%') from s
        union all select 'flux', quantile_cont(flux, 0.01), quantile_cont(flux, 0.99) from nrm) t""",
        "nrm",
        s=f"select * from {describe_sql('nrm', KEYS, [c for c in VALUES if c != 'flux'], _others(KEYS))}",
    ),
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    sets = {"tracts": KeySet(KEYS, [c for c in VALUES if c != "flux"]), "all": KeySet([], ["flux"], (0.01, 0.99), complete=())}
    tables = describe_sets(cat, sets)
    return rounded(dimension_ranges(cat, tables["tracts"], [*METRICS, "flux"], totals=tables["all"]))


# statistics and kept summaries as they lie beside each other in storage; a metric that the statistics lack
@check("dimension_ranges_kept", SQL["dimension_ranges"])
def _(spark, sf):
    cat = catalogue(spark, sf)
    paths = [scratch_path(spark, name) for name in ("stats", "summaries")]
    write_stats(key_summaries(cat, KEYS, VALUES), paths[1])
    summaries = spark.read.parquet(paths[1])
    write_stats(describe_by_key(cat, KEYS, [c for c in VALUES if c != "flux"], summaries=summaries), paths[0])
    return rounded(dimension_ranges(cat, spark.read.parquet(paths[0]), [*METRICS, "flux"], summaries=summaries))


@check(
    "colour_range",
    with_ctes(
        f"""select 'metric_a' as "column", {r('quantile_cont(metric_a, 0.005)', 'lo')},
        {r('quantile_cont(metric_a, 0.995)', 'hi')} from nrm
        union all select 'ra', {r('min(ra)', 'lo')}, {r('max(ra)', 'hi')} from nrm
        union all select 'dec', -9e1, 9e1""",
        "nrm",
    ),
)
def _(spark, sf):
    return rounded(colour_range(catalogue(spark, sf), "metric_a", override={"dec": (-90.0, 90.0)}))


@check(
    "extent",
    with_ctes(
        " union all ".join(
            f"""select '{c}' as "column", {r(f'min("{c}")', 'lo')}, {r(f'max("{c}")', 'hi')} from nrm"""
            for c in ("ra", "dec", "flux", "metric_a")
        ),
        "nrm",
    ),
)
def _(spark, sf):
    return rounded(extent(catalogue(spark, sf), ["ra", "dec", "flux", "metric_a"]))


@check(
    "dimension_values",
    with_ctes(
        """select distinct 'band' as dimension, band as value from nrm
        union all select distinct 'patch', cast(patch as varchar) from nrm
        union all select distinct 'tract', cast(tract as varchar) from nrm
        union all select * from (values ('flag_used', 'true'), ('flag_used', 'false'), ('flag_bad', 'true'), ('flag_bad', 'false'))""",
        "nrm",
    ),
)
def _(spark, sf):
    return dimension_values(catalogue(spark, sf), ["band", "patch", "tract"])


@check(
    "info_counts",
    with_ctes(
        f"""select (select count(distinct tract) from nrm) as tract_count,
        (select count(distinct visit) from nrm) as visit_count,
        (select count(*) from nrm where {STATE_SQL}) as object_count""",
        "nrm",
    ),
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    return info_counts(cat.select(*KEYS), cat.select(*VISIT_KEYS), cat.where(STATE.predicate()))


@check("patch_count", with_ctes("select count(*) as patch_count from (select distinct tract, patch from nrm)", "nrm"))
def _(spark, sf):
    return patch_count(catalogue(spark, sf))


def _profile_sql() -> str:
    rows = []
    for c, role, kind in (
        ("band", "key", "text"),
        ("tract", "key", "int"),
        ("ra", "key", "double"),
        ("psfMag", "key", "double"),
        ("flux", "metric", "double"),
        ("metric_a", "metric", "double"),
        ("metric_b", "metric", "double"),
        ("flag_used", "flag", "bool"),
        ("flag_bad", "flag", "bool"),
    ):
        lo_hi = f'{r(f"""min("{c}")::double""", "lo")}, {r(f"""max("{c}")::double""", "hi")}'
        if kind in ("text", "bool"):
            lo_hi = "cast(null as double) as lo, cast(null as double) as hi"
        true = f'count(*) filter (where "{c}")' if kind == "bool" else "cast(null as bigint)"
        rows.append(
            f"""select '{c}' as "column", '{role}' as role, true as present, count("{c}") as filled,
            cast(0 as bigint) as non_finite, {lo_hi}, {true} as n_true from nrm"""
        )
    rows.append(
        """select 'metric_z', 'missing', false, cast(0 as bigint), cast(0 as bigint), cast(null as double),
        cast(null as double), cast(null as bigint)"""
    )
    return with_ctes(" union all ".join(rows), "nrm")


@check("column_profile", _profile_sql())
def _(spark, sf):
    wanted = ["band", "tract", "ra", "psfMag", "flux", *METRICS, "flag_used", "flag_bad", "metric_z"]
    reserved = ("patch", "dec", "psfMag", "ra", "band", "tract", "visit")
    return rounded(column_profile(catalogue(spark, sf), wanted, reserved))


# a raw table with values that are not finite: the logarithm of zero and of a negative flux
@check(
    "column_profile_raw",
    with_ctes(
        f"""select 'ratio' as "column", 'metric' as role, true as present,
        count(*) filter (where flux <> 0) as filled, count(*) filter (where flux = 0) as non_finite,
        {r('min(case when flux <> 0 then metric_a / flux end)', 'lo')},
        {r('max(case when flux <> 0 then metric_a / flux end)', 'hi')}, cast(null as bigint) as n_true from flat""",
        "cat",
        flat="select greatest(flux, 0e0) as flux, metric_a from cat",
    ),
)
def _(spark, sf):
    flux = F.greatest(F.col("flux"), F.lit(0.0))
    ratio = F.when(flux == 0, F.lit(float("inf"))).otherwise(F.col("metric_a") / F.nullif(flux, F.lit(0.0)))
    return rounded(column_profile(raw_catalogue(spark, sf).select(ratio.alias("ratio"))))
