"""Missing-value rules and catalogue unit conversions as Column expressions.

A missing measurement is SQL NULL everywhere in this package. NaN and the two
infinities are turned into NULL where a table enters, because Spark counts NaN
as a value, sorts it above every number and lets it poison averages.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """A column by its exact name, including names with dots or dashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def finite_or_null(value: Column) -> Column:
    """NULL for NaN and both infinities. NaN compares above +inf, so one test is enough."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def null_non_finite(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Apply :func:`finite_or_null` to every floating column, or to those named."""
    wanted = None if columns is None else set(columns)
    return df.select(
        *[
            finite_or_null(named(f.name)).alias(f.name)
            if is_floating(f.dataType) and (wanted is None or f.name in wanted)
            else named(f.name)
            for f in df.schema.fields
        ]
    )


def is_complete(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """True where every column holds a value (finite, for floating columns)."""
    names = df.columns if columns is None else columns
    types = {f.name: f.dataType for f in df.schema.fields}
    # each value appears once: repeated in a test, a derived value is computed again, and a
    # filter over many columns outgrows what the JVM compiles
    tests = [
        F.coalesce(F.abs(named(n)) < F.lit(float("inf")), F.lit(False))
        if is_floating(types[n])
        else named(n).isNotNull()
        for n in names
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def magnitude(flux: Column) -> Column:
    """``-2.5 log10(flux)``; NULL for a flux that is zero, negative or not finite."""
    return finite_or_null(F.lit(-2.5) * F.log10(flux))
