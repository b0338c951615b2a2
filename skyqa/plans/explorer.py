"""The explorer's main request: from a metric selection to the tables behind its plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyqa.functions.observed import Watch
from skyqa.operators.filters import (
    FilterState,
    coadd_slice,
    query_filter,
    stats_slice,
    visit_slice,
    visit_stats_slice,
)
from skyqa.operators.raster import Axis, scatter_density_multi
from skyqa.operators.stats import dimension_ranges, info_counts, summary_table
from skyqa.operators.visits import visit_series_long
from skyqa.sources.readers import read_stats


@dataclass(frozen=True)
class Catalogue:
    """An opened data folder: lazy tables, statistics, and what they offer."""

    coadd: DataFrame
    visit: DataFrame
    stats: Mapping[str, DataFrame]
    version: str
    filters: tuple[str, ...]
    tracts: tuple[int, ...]

    @property
    def coadd_stats(self) -> DataFrame:
        return self.stats[f"coadd_{self.version}"]


@dataclass(frozen=True)
class Request:
    """What the user has chosen for one filter."""

    filter_value: str
    metrics: tuple[str, ...]
    tracts: tuple[int, ...] = ()
    visit: int | None = None
    statistic: str = "mean"
    flags: Mapping[str, bool] = field(default_factory=dict)
    expression: str = ""
    state: FilterState = FilterState()
    bins: int = 512


def open_catalogue(spark: SparkSession, root: str, version: str = "unforced") -> Catalogue:
    """Open a folder written by the repartition job. Only its statistics are read."""
    stats = read_stats(spark, root)
    keys = stats[f"coadd_{version}"].select("filter", "tract").distinct().collect()
    return Catalogue(
        coadd=spark.read.parquet(f"{root}/coadd_{version}"),
        visit=spark.read.parquet(f"{root}/visit"),
        stats=stats,
        version=version,
        filters=tuple(sorted({r[0] for r in keys})),
        tracts=tuple(sorted({r[1] for r in keys})),
    )


def explore(
    catalogue: Catalogue, request: Request, watch: Watch | None = None
) -> tuple[dict[str, DataFrame], list[str]]:
    """Every table behind the plots of one selection, lazily, and the warnings.

    ``series`` per-visit metric series, ``rows`` the selected objects, ``ranges`` display
    ranges, ``density`` the scatter and sky layers of all metrics, ``summary`` their summary
    rows and ``info`` the counts. Unknown metrics and tracts are reported and left out; without
    a known metric there is no density or summary, and without a known tract all are used,
    in every table alike. With a visit, rows and ranges are those of the visit catalogue.

    With a ``watch``, the first use of ``rows`` counts them and the first use of ``series`` counts its
    statistics; both warn if there are none.
    """
    source = catalogue.coadd if request.visit is None else catalogue.visit
    metrics: Sequence[str] = [m for m in request.metrics if m in source.columns]
    warnings = [f"no metric {m}" for m in request.metrics if m not in source.columns]
    tracts = tuple(t for t in request.tracts if t in catalogue.tracts)
    if request.visit is None:
        rows, unknown = coadd_slice(
            catalogue.coadd, request.filter_value, metrics, request.tracts, catalogue.tracts
        )
        stats = stats_slice(catalogue.coadd_stats, request.filter_value, tracts)
        warnings += unknown
    else:
        rows = visit_slice(catalogue.visit, request.filter_value, metrics, request.visit, tracts=tracts)
        stats = stats_slice(catalogue.stats["visit"], request.filter_value, tracts)
        stats = stats.where(stats["visit"] == request.visit)
        warnings += [f"tract {t} is not in the data" for t in request.tracts if t not in tracts]
        if not tracts:
            warnings.append("no known tract selected, using all tracts")
    rows = query_filter(rows, request.flags, request.expression)
    visit_stats = visit_stats_slice(catalogue.stats["visit"], tracts, watch=watch)
    series, missing = visit_series_long(visit_stats, request.filter_value, metrics, request.statistic)
    warnings += [f"no visit statistics for {m}" for m in missing]
    shown = rows
    if watch is not None:
        none = "no objects are left by the selection"
        shown = watch.on(rows, "objects", {"n": F.count(F.lit(1))}, lambda found: [] if found["n"] else [none])
    tables = {
        "series": series,
        "rows": shown,
        "ranges": dimension_ranges(rows, stats, metrics),
        "info": info_counts(catalogue.coadd_stats, catalogue.stats["visit"], rows, tracts),
    }
    if metrics:
        x, ra, dec = (Axis(c, request.bins) for c in ("psfMag", "ra", "dec"))
        values = [Axis(m, request.bins) for m in metrics]
        tables["density"] = scatter_density_multi(rows, x, values, ra, dec, request.state)
        tables["summary"] = summary_table(rows, metrics, request.state)
    return tables, warnings
