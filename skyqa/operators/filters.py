"""Row selection: filter state, catalogue slices and user expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, named
from skyqa.functions.observed import Watch
from skyqa.operators.ingest import complete_cases
from skyqa.operators.schema import flag_columns

# Columns that every visit slice carries beside the metrics.
VISIT_SLICE_COLUMNS = (
    "filter",
    "tract",
    "visit",
    "calib_psf_used",
    "calib_psf_candidate",
    "calib_photometry_reserved",
    "qaBad_flag",
    "ra",
    "dec",
    "psfMag",
)

# Columns that every coadd slice carries beside metrics and flags.
COADD_SLICE_COLUMNS = ("ra", "dec", "filter", "psfMag", "patch")


def _all_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def in_range(column: str, lo: float | None, hi: float | None) -> Column:
    """``lo <= column < hi``; a bound that is None or not finite is left out."""
    tests = []
    if lo is not None and math.isfinite(lo):
        tests.append(named(column) >= F.lit(lo))
    if hi is not None and math.isfinite(hi):
        tests.append(named(column) < F.lit(hi))
    return _all_of(tests)


@dataclass(frozen=True)
class FilterState:
    """Ranges per column, flags that must be set and flags that must not be set."""

    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    flags: tuple[str, ...] = ()
    bad_flags: tuple[str, ...] = ()

    def predicate(self) -> Column:
        """Everything as one condition. A flag in both lists must not be set, and a flag
        state goes before a range of the same column."""
        flags = {**dict.fromkeys(self.flags, True), **dict.fromkeys(self.bad_flags, False)}
        tests = [in_range(c, lo, hi) for c, (lo, hi) in self.ranges.items() if c not in flags]
        tests += [named(f) if state else ~named(f) for f, state in flags.items()]
        return _all_of(tests)

    def with_box(self, x: str, y: str, bounds: tuple[float, float, float, float]) -> FilterState:
        """Select a box ``(left, bottom, right, top)``, replacing older ranges of x and y."""
        left, bottom, right, top = bounds
        return replace(self, ranges={**self.ranges, x: (left, right), y: (bottom, top)})

    def reset(self) -> FilterState:
        """The empty state."""
        return FilterState()


def state_filter(df: DataFrame, state: FilterState) -> DataFrame:
    """Rows that satisfy the filter state."""
    return df.where(state.predicate())


def coadd_slice(
    df: DataFrame,
    filter_value: str,
    metrics: Sequence[str],
    tracts: Sequence[int],
    known_tracts: Sequence[int] | None = None,
    filter_name: str = "filter",
    tract_name: str = "tract",
    columns: Sequence[str] | None = None,
    watch: Watch | None = None,
) -> tuple[DataFrame, list[str]]:
    """Complete rows of one filter and some tracts, with warnings beside the frame.

    Unknown tracts are reported and left out; without ``known_tracts`` the asked ones are
    looked up in the table. If no known tract is asked for, every tract is used, which
    needs no tract test at all. Both tests are on partition columns. With a ``watch`` the first use of
    the frame also counts its rows, and warns if there are none.
    """
    if known_tracts is None:
        asked = df.where(named(tract_name).isin(list(tracts))).select(named(tract_name))
        known_tracts = [r[0] for r in asked.distinct().collect()]
    known = set(known_tracts)
    warnings = [f"tract {t} is not in the data" for t in tracts if t not in known]
    valid = sorted(known.intersection(tracts))
    where = named(filter_name) == F.lit(filter_value)
    if valid:
        where = where & named(tract_name).isin(valid)
    else:
        warnings.append("no known tract selected, using all tracts")
    carried = COADD_SLICE_COLUMNS if columns is None else columns
    wanted = list(dict.fromkeys([*metrics, *flag_columns(df), *carried]))
    rows = complete_cases(df.where(where).select(*[named(c) for c in wanted]))
    return _watched(rows, watch, "coadd rows", f"no complete rows of filter {filter_value}"), warnings


def _watched(rows: DataFrame, watch: Watch | None, name: str, text: str) -> DataFrame:
    if watch is None:
        return rows
    return watch.on(rows, name, {"n": F.count(F.lit(1))}, lambda found: [] if found["n"] else [text])


def visit_slice(
    df: DataFrame,
    filter_value: str,
    metrics: Sequence[str],
    visit: int | None = None,
    filter_name: str = "filter",
    visit_name: str = "visit",
    columns: Sequence[str] = VISIT_SLICE_COLUMNS,
    tracts: Sequence[int] = (),
    tract_name: str = "tract",
    watch: Watch | None = None,
) -> DataFrame:
    """Rows of one filter (and one visit, and some tracts) in which every metric has a value.

    With a ``watch`` the first use of the frame also counts its rows, and warns if there are none.
    """
    where = named(filter_name) == F.lit(filter_value)
    if visit is not None:
        where = where & (named(visit_name) == F.lit(int(visit)))
    if tracts:
        where = where & named(tract_name).isin(list(tracts))
    wanted = list(dict.fromkeys([*columns, *metrics]))
    rows = df.where(where).select(*[named(c) for c in wanted])
    rows = complete_cases(rows, list(metrics)) if metrics else rows
    what = f"no rows of filter {filter_value}" + ("" if visit is None else f", visit {visit}")
    return _watched(rows, watch, "visit rows", what)


def visits_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Every filter and metric at once: ``keys..., metric, value`` without missing values.

    Metrics that the table lacks are returned beside the frame, which is empty if it lacks all.
    """
    present = [m for m in metrics if m in df.columns]
    if not present:
        metric, value = F.lit("").alias("metric"), F.lit(0.0).alias("value")
        return df.where(F.lit(False)).select(*[named(k) for k in keys], metric, value), list(metrics)
    wide = df.select(
        *[named(k) for k in keys], *[finite_or_null(named(m).cast("double")).alias(m) for m in present]
    )
    ids, values = [named(k) for k in keys], [named(m) for m in present]
    long = wide.unpivot(ids, values, "metric", "value").where(F.col("value").isNotNull())
    return long, [m for m in metrics if m not in df.columns]


def sky_points(
    df: DataFrame,
    values: Sequence[str],
    max_mag: float,
    label: str,
    mag: str = "psfMag",
    state: FilterState | None = None,
    ids: Sequence[str] = ("patch", "tract"),
    label_name: str = "label",
    position: tuple[str, str] = ("ra", "dec"),
    complete: bool = True,
) -> DataFrame:
    """Points of one class with ``0 <= mag < max_mag``: position, values, magnitude and ids.

    Only rows with a value in every column take part, unless ``complete`` is off.
    """
    where = in_range(mag, 0.0, max_mag) & (named(label_name) == F.lit(label))
    if state is not None:
        where = where & state.predicate()
    wanted = dict.fromkeys([*position, *values, mag, *[i for i in ids if i in df.columns]])
    rows = complete_cases(df) if complete else df
    return rows.where(where).select(*[named(c) for c in wanted])


def query_filter(
    df: DataFrame, flags: Mapping[str, bool] | None = None, expression: str | None = None
) -> DataFrame:
    """Flag states AND a user's SQL condition. The condition is taken as one unit, so an
    ``or`` in it cannot escape the flags. With neither, the table is unchanged."""
    tests = [named(f) if state else ~named(f) for f, state in (flags or {}).items()]
    if expression and expression.strip():
        tests.append(F.expr(expression))
    return df.where(_all_of(tests)) if tests else df


def stats_slice(
    stats: DataFrame,
    filter_value: str | None = None,
    tracts: Sequence[int] = (),
    filter_name: str = "filter",
    tract_name: str = "tract",
    drop_keys: bool = False,
) -> DataFrame:
    """Statistics rows of one filter and some tracts (no tracts: all of them)."""
    tests = []
    if filter_value is not None:
        tests.append(named(filter_name) == F.lit(filter_value))
    if tracts:
        tests.append(named(tract_name).isin(list(tracts)))
    rows = stats.where(_all_of(tests)) if tests else stats
    return rows.drop(filter_name, tract_name) if drop_keys else rows


def visit_stats_slice(
    stats: DataFrame, tracts: Sequence[int] = (), tract_name: str = "tract", watch: Watch | None = None
) -> DataFrame:
    """Visit statistics of some tracts (no tracts: all). With a ``watch`` the first use warns if there are none."""
    rows = stats_slice(stats, None, tracts, tract_name=tract_name)
    return _watched(rows, watch, "visit statistics", f"no visit statistics for tracts {sorted(tracts) or 'at all'}")
