"""Per-visit series and normalised summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalogue import METRICS, VALUES, VISIT_KEYS, catalogue, r, rounded, table, with_ctes
from checks.registry import check
from checks.statistics import _others, describe_sql
from skyqa.operators.stats import describe_by_key
from skyqa.operators.visits import (
    visit_box_whisker,
    visit_mean_std,
    visit_minmax_median,
    visit_normalized,
    visit_series,
    visit_series_long,
)

SERIES = ["flux", "metric_a", "metric_b"]


def mean_series(spark, sf):
    """The explorer's top plot: normalise, describe each visit, one series per metric."""
    stats = describe_by_key(catalogue(spark, sf), VISIT_KEYS, VALUES, percentiles=())
    return rounded(visit_series(stats, "A", SERIES, filter_name="band"))


_COMPLETE = " and ".join(f'"{c}" is not null' for c in _others(VISIT_KEYS))
check(
    "visit_series",
    with_ctes(
        f"""select visit, {r('median(flux)', 'flux')}, {r('median(metric_a)', 'metric_a')},
        {r('median(metric_b)', 'metric_b')} from (
          select tract, visit, avg(flux) filter (where ok) as flux, avg(metric_a) filter (where ok) as metric_a,
          avg(metric_b) filter (where ok) as metric_b
          from (select *, {_COMPLETE} as ok from nrm where band = 'A') t group by tract, visit) t
        group by visit""",
        "nrm",
    ),
)(mean_series)


@check(
    "visit_series_long",
    with_ctes(
        " union all ".join(
            f"""select cast(visit as varchar) as visit, '{m}_95%' as series, {r(f'median({m})', 'value')}
            from {describe_sql('nrm', VISIT_KEYS, VALUES, _others(VISIT_KEYS))} s
            where band = 'R' and statistic = '95%' group by visit"""
            for m in SERIES
        ),
        "nrm",
    ),
)
def _(spark, sf):
    # percentiles of the statistics table are rounded in both engines before the median
    stats = rounded(describe_by_key(catalogue(spark, sf), VISIT_KEYS, VALUES))
    long, _missing = visit_series_long(stats, "R", [*SERIES, "metric_z"], "95%", filter_name="band")
    return rounded(long)


def _moments_sql(columns: list[str], source: str, visit: str = "visit") -> str:
    return " union all ".join(
        f"""select {visit}, '{c}' as metric, count({c}) as n, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}
        from {source} where {c} is not null group by {visit}"""
        for c in columns
    )


@check("visit_mean_std", with_ctes(_moments_sql(SERIES, "nrm"), "nrm"))
def _(spark, sf):
    return rounded(visit_mean_std(catalogue(spark, sf), SERIES))


def _scaled(centre: str, spread: str, source: str, columns: list[str], keep: str) -> str:
    """Every row normalised over the whole table, as the definition says."""
    cols = []
    for c in columns:
        lo, d = centre.format(c), spread.format(c)
        cols.append(f"({c} - (select {lo} from {source})) / (select case when {d} = 0 then 1 else {d} end from {source}) as {c}")
    return f"select {keep}, {', '.join(cols)} from {source}"


_MINMAX = _scaled("min({})", "(max({0}) - min({0}))", "nrm", SERIES, "visit")
_ROBUST = _scaled("median({})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))", "nrm", SERIES, "visit")


@check("visit_minmax_mean", with_ctes(f"select visit, metric, n, mean from ({_moments_sql(SERIES, 'scaled')}) t", "nrm", scaled=_MINMAX))
def _(spark, sf):
    return rounded(visit_normalized(catalogue(spark, sf), SERIES, "minmax").drop("std"))


@check("visit_robust_mean", with_ctes(f"select visit, metric, n, mean from ({_moments_sql(SERIES, 'scaled')}) t", "nrm", scaled=_ROBUST))
def _(spark, sf):
    return rounded(visit_normalized(catalogue(spark, sf), SERIES, "robust").drop("std"))


@check("visit_error_bars", with_ctes(_moments_sql(SERIES, "scaled"), "nrm", scaled=_MINMAX))
def _(spark, sf):
    return rounded(visit_normalized(catalogue(spark, sf), SERIES, "minmax"))


_EVENTS = "select cast(hour(ts) as int) as visit, value, value * value as square from events"


def _events(spark, sf):
    return table(spark, sf, "events").select(
        F.hour("ts").alias("visit"), "value", (F.col("value") * F.col("value")).alias("square")
    )


@check(
    "visit_error_bars_events",
    with_ctes(
        _moments_sql(["value", "square"], "scaled"),
        ev=_EVENTS,
        scaled=_scaled("median({})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))", "ev", ["value", "square"], "visit"),
    ),
)
def _(spark, sf):
    return rounded(visit_normalized(_events(spark, sf), ["value", "square"], "robust"))


@check(
    "visit_minmax_median",
    with_ctes(
        " union all ".join(
            f"select visit, '{c}' as metric, {r(f'median({c})', 'median')} from scaled where {c} is not null group by visit"
            for c in METRICS
        ),
        "nrm",
        scaled=_scaled("min({})", "(max({0}) - min({0}))", "nrm", METRICS, "visit"),
    ),
)
def _(spark, sf):
    return rounded(visit_minmax_median(catalogue(spark, sf), METRICS))


def _box_sql(columns: list[str], source: str, by: str = "visit") -> str:
    def one(c: str) -> str:
        return f"""select {by}, '{c}' as metric, {r('any_value(q1)', 'q1')}, {r('any_value(q2)', 'median')},
        {r('any_value(q3)', 'q3')},
        {r(f'min({c}) filter (where {c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))', 'lower')},
        {r(f'max({c}) filter (where {c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))', 'upper')},
        count(*) filter (where not ({c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))) as n_outliers,
        count({c}) as n
        from {source} t join (select {by}, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as q2,
          quantile_cont({c}, 0.75) as q3 from {source} group by {by}) b using ({by})
        where {c} is not null group by {by}"""

    return " union all ".join(one(c) for c in columns)


@check("visit_box_whisker", with_ctes(_box_sql(SERIES, "nrm"), "nrm"))
def _(spark, sf):
    return rounded(visit_box_whisker(catalogue(spark, sf), SERIES))


@check("visit_box_whisker_minmax", with_ctes(_box_sql(SERIES, "scaled"), "nrm", scaled=_MINMAX))
def _(spark, sf):
    return rounded(visit_box_whisker(catalogue(spark, sf), SERIES, normalizer="minmax"))


@check("visit_box_whisker_robust", with_ctes(_box_sql(SERIES, "scaled"), "nrm", scaled=_ROBUST))
def _(spark, sf):
    return rounded(visit_box_whisker(catalogue(spark, sf), SERIES, normalizer="robust"))


def _scaled_by_key(columns: list[str], keys: str) -> str:
    """Every row scaled to [0, 1] within its key."""
    cols = [
        f"""({c} - min({c}) over w) / (case when max({c}) over w = min({c}) over w then 1e0
        else max({c}) over w - min({c}) over w end) as {c}"""
        for c in columns
    ]
    return f"select {keys}, visit, {', '.join(cols)} from nrm window w as (partition by {keys})"


@check("visit_box_whisker_by_band", with_ctes(_box_sql(SERIES, "scaled", "band, visit"), "nrm", scaled=_scaled_by_key(SERIES, "band")))
def _(spark, sf):
    return rounded(visit_box_whisker(catalogue(spark, sf), SERIES, normalizer="minmax", by=["band"]))


def _by_key_sql(value: str, name: str, count: str, keys: str) -> str:
    return " union all ".join(
        f"""select {keys}, visit, '{c}' as metric, {count.format(c)} {r(value.format(c), name)} from scaled
        where {c} is not null group by {keys}, visit"""
        for c in SERIES
    )


@check(
    "visit_minmax_mean_by_tract",
    with_ctes(_by_key_sql("avg({})", "mean", "count({}) as n,", "band, tract"), "nrm", scaled=_scaled_by_key(SERIES, "band, tract")),
)
def _(spark, sf):
    return rounded(visit_normalized(catalogue(spark, sf), SERIES, "minmax", keys=["band", "tract"]).drop("std"))


@check(
    "visit_minmax_median_by_tract",
    with_ctes(_by_key_sql("median({})", "median", "", "band, tract"), "nrm", scaled=_scaled_by_key(SERIES, "band, tract")),
)
def _(spark, sf):
    return rounded(visit_minmax_median(catalogue(spark, sf), SERIES, keys=["band", "tract"]))


@check("visit_box_whisker_events",with_ctes(_box_sql(["value", "square"], "ev"), ev=_EVENTS))
def _(spark, sf):
    return rounded(visit_box_whisker(_events(spark, sf), ["value", "square"]))
