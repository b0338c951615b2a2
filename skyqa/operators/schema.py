"""Column roles, told from a schema alone, and the one-pass column profile.

The fixed values below are the column lists and reserved names of the catalogue format.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyqa.functions.clean import is_floating, named

# Metric columns of a catalogue.
METRICS = (
    "base_Footprint_nPix",
    "Gaussian-PSF_magDiff_mmag",
    "Kron-PSF_magDiff_mmag",
    "CModel-PSF_magDiff_mmag",
    "traceSdss_pixel",
    "traceSdss_fwhm_pixel",
    "psfTraceSdssDiff_percent",
    "e1ResidsSdss_milli",
    "e2ResidsSdss_milli",
    "deconvMoments",
    "compareUnforced_Gaussian_magDiff_mmag",
    "compareUnforced_Kron_magDiff_mmag",
    "compareUnforced_CModel_magDiff_mmag",
    "base_PsfFlux_instFlux",
    "base_PsfFlux_instFluxErr",
)

# Flag columns of a catalogue.
FLAGS = (
    "calib_psf_used",
    "calib_psf_candidate",
    "calib_photometry_reserved",
    "merge_measurement_i2",
    "merge_measurement_i",
    "merge_measurement_r2",
    "merge_measurement_r",
    "merge_measurement_z",
    "merge_measurement_y",
    "merge_measurement_g",
    "merge_measurement_N921",
    "merge_measurement_N816",
    "merge_measurement_N1010",
    "merge_measurement_N387",
    "merge_measurement_N515",
    "qaBad_flag",
)

# Position and identifier columns that are read beside metrics and flags.
POSITIONS = ("coord_ra", "coord_dec", "patchId")
VISIT_KEYS = ("ccdId", "filter", "tract", "visit")

# Columns that are neither a metric nor a flag.
RESERVED = ("patch", "dec", "psfMag", "ra", "filter", "dataset", "tract", "visit", "ccd", "label")


@dataclass(frozen=True)
class CatalogueKind:
    """One of the three catalogue tables: its name, keys and the metrics it lacks, and how
    many keys a chunk of an incremental load has."""

    name: str
    keys: tuple[str, ...]
    bucket_by: str
    absent_metrics: tuple[str, ...] = ()
    extra_columns: tuple[str, ...] = ()
    chunk_keys: int = 20

    def metric_columns(self) -> list[str]:
        return [m for m in METRICS if m not in self.absent_metrics]

    def flag_columns(self) -> list[str]:
        return list(FLAGS)

    def columns(self) -> list[str]:
        """Every column to read, sorted by name."""
        return sorted({*self.metric_columns(), *FLAGS, *POSITIONS, *self.extra_columns})


_AGAINST_UNFORCED = tuple(m for m in METRICS if m.startswith("compareUnforced_"))

COADD_FORCED = CatalogueKind("coadd_forced", ("filter", "tract"), "patch")
COADD_UNFORCED = CatalogueKind("coadd_unforced", ("filter", "tract"), "patch", _AGAINST_UNFORCED)
VISIT = CatalogueKind(
    "visit",
    ("filter", "tract", "visit"),
    "ccd",
    (*_AGAINST_UNFORCED, "CModel-PSF_magDiff_mmag"),
    VISIT_KEYS,
    chunk_keys=80,
)
KINDS = {k.name: k for k in (COADD_FORCED, COADD_UNFORCED, VISIT)}


def flag_columns(df: DataFrame) -> list[str]:
    """Boolean columns, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def unit_columns(df: DataFrame) -> list[str]:
    """Columns that carry the unit of a metric."""
    return [c for c in df.columns if "_unit" in c]


def metric_columns(df: DataFrame, reserved: Sequence[str] = RESERVED) -> list[str]:
    """Everything that is not a flag, a unit or a reserved name, sorted by name."""
    skip = {*flag_columns(df), *unit_columns(df), *reserved}
    return sorted(c for c in df.columns if c not in skip)


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Numeric columns outside ``skip``, sorted by name. Flags are not numeric."""
    return sorted(
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip
    )


def key_and_value_columns(
    df: DataFrame, values: Sequence[str] | None = None, reserved: Sequence[str] = RESERVED
) -> tuple[list[str], list[str]]:
    """Key dimensions (reserved names and flags) and value dimensions (the rest, or a subset)."""
    keys = {*reserved, *flag_columns(df)}
    rest = [c for c in df.columns if c not in keys]
    return [c for c in df.columns if c in keys], [c for c in rest if values is None or c in values]


def split_available(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """The wanted columns that the table has, and those it lacks."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def role_of(df: DataFrame, reserved: Sequence[str] = RESERVED) -> dict[str, str]:
    """``flag``, ``unit``, ``key`` or ``metric`` for every column."""
    flags, units = set(flag_columns(df)), set(unit_columns(df))

    def role(c: str) -> str:
        if c in flags:
            return "flag"
        if c in units:
            return "unit"
        return "key" if c in reserved else "metric"

    return {c: role(c) for c in df.columns}


def column_profile(
    df: DataFrame, wanted: Sequence[str] | None = None, reserved: Sequence[str] = RESERVED
) -> DataFrame:
    """One row per column, from one aggregate pass over the table.

    ``column, role, present, filled, non_finite, lo, hi, n_true``: ``filled`` counts finite
    values, ``lo`` and ``hi`` are their range (numeric columns only) and ``n_true`` counts
    the set rows of a flag. Wanted columns that the table lacks are listed as not present.
    """
    wanted = list(df.columns) if wanted is None else list(dict.fromkeys(wanted))
    roles = role_of(df, reserved)
    types = {f.name: f.dataType for f in df.schema.fields}
    inf = F.lit(float("inf"))
    aggregates, rows = [], []
    for i, name in enumerate(wanted):
        if name not in types:
            rows.append((name, "missing", False, F.lit(0), F.lit(0), None, None, None))
            continue
        col, kind = named(name), types[name]
        finite = F.when(F.abs(col) < inf, col) if is_floating(kind) else col
        aggregates.append(F.count(finite).alias(f"filled{i}"))
        filled, bad, lo, hi, true = F.col(f"filled{i}"), F.lit(0), None, None, None
        if is_floating(kind):
            aggregates.append(F.count(col).alias(f"all{i}"))
            bad = F.col(f"all{i}") - filled
        if isinstance(kind, T.NumericType):
            aggregates += [F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}")]
            lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        if isinstance(kind, T.BooleanType):
            aggregates.append(F.count_if(col).alias(f"true{i}"))
            true = F.col(f"true{i}")
        rows.append((name, roles[name], True, filled, bad, lo, hi, true))
    one_row = df.agg(*aggregates) if aggregates else df.sparkSession.range(1)
    null = F.lit(None)
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(role).alias("role"),
            F.lit(present).alias("present"),
            filled.cast("long").alias("filled"),
            bad.cast("long").alias("non_finite"),
            (null if lo is None else lo).cast("double").alias("lo"),
            (null if hi is None else hi).cast("double").alias("hi"),
            (null if true is None else true).cast("long").alias("n_true"),
        )
        for name, role, present, filled, bad, lo, hi, true in rows
    ]
    return one_row.select(F.inline(F.array(*entries)))


def magnitude_names(columns: Sequence[str]) -> dict[str, str]:
    """``<x>_magDiff -> <x>_mag`` for names that end so."""
    found = ((c, re.fullmatch(r"(.+_mag)Diff", c)) for c in columns)
    return {c: m.group(1) for c, m in found if m}
