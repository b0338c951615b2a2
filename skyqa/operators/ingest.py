"""Turning raw catalogue tables into clean ones, and sampling them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyqa.functions.clean import is_complete, magnitude, named, null_non_finite
from skyqa.operators.schema import CatalogueKind

# Raw names and the names used after normalising.
RENAMES = {"patchId": "patch", "ccdId": "ccd"}

_SAMPLE_SCALE = 1_000_000


def normalize(
    df: DataFrame,
    ra: str = "coord_ra",
    dec: str = "coord_dec",
    flux: str = "base_PsfFlux_instFlux",
    renames: Mapping[str, str] = RENAMES,
) -> DataFrame:
    """Add ``ra`` and ``dec`` in degrees and ``psfMag``; NaN and infinities become NULL."""
    derived = df.withColumns(
        {"ra": F.degrees(named(ra)), "dec": F.degrees(named(dec)), "psfMag": magnitude(named(flux))}
    )
    return null_non_finite(derived).withColumnsRenamed(dict(renames))


def project_dataset(df: DataFrame, kind: CatalogueKind) -> DataFrame:
    """The columns of one catalogue kind, sorted by name, plus its keys where present."""
    keys = [k for k in kind.keys if k in df.columns and k not in kind.columns()]
    return df.select(*[named(c) for c in [*kind.columns(), *keys]])


def project_columns(df: DataFrame, *column_sets: Sequence[str], without: Sequence[str] = ()) -> DataFrame:
    """The union of several column sets, less some names, sorted by name."""
    return df.select(*[named(c) for c in sorted(set().union(*column_sets) - set(without))])


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which every column (or every named column) holds a finite value."""
    return df.where(is_complete(df, columns))


def derived_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column computed by a SQL expression over the other columns."""
    return df.withColumn(name, F.expr(expression))


def union_with_key(frames: Mapping[object, DataFrame], key: str, data_type: str = "int") -> DataFrame:
    """Stack frames, each labelled with its key; columns missing from one are NULL there."""
    labelled = [f.withColumn(key, F.lit(value).cast(data_type)) for value, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def sample_fraction(
    df: DataFrame, fraction: float, seed: int = 0, by: Column | str | None = None
) -> DataFrame:
    """A random share of the rows.

    Without ``by`` this is Spark's own sampling, which depends on the partitioning. With
    ``by`` (an id column, or a ready integer hash) the same rows come back in any layout.
    """
    if by is None:
        return df.sample(fraction=fraction, seed=seed)
    mixed = F.xxhash64(named(by), F.lit(seed)) if isinstance(by, str) else by
    return df.where(F.pmod(mixed, F.lit(_SAMPLE_SCALE)) < F.lit(int(fraction * _SAMPLE_SCALE)))


def _shuffled(id_column: str, seed: int, order: Column | None) -> list[Column]:
    mixed = F.xxhash64(named(id_column), F.lit(seed)) if order is None else order
    return [mixed, named(id_column)]


def sample_per_key(
    df: DataFrame,
    keys: Sequence[str],
    n: int,
    id_column: str,
    seed: int = 0,
    order: Column | None = None,
) -> DataFrame:
    """At most ``n`` rows of every key, drawn by a hash of the id and so repeatable.

    Spark limits each key to ``n`` rows before the exchange, so a hot key ships no more
    than ``n`` rows per input task.
    """
    pick = W.partitionBy(*[named(k) for k in keys]).orderBy(*_shuffled(id_column, seed, order))
    return df.withColumn("__pick", F.row_number().over(pick)).where(F.col("__pick") <= n).drop("__pick")


def decimate(
    df: DataFrame, id_column: str, max_samples: int, seed: int = 0, order: Column | None = None
) -> DataFrame:
    """At most ``max_samples`` random rows of the whole table, repeatable by seed."""
    return df.orderBy(*_shuffled(id_column, seed, order)).limit(max_samples)
