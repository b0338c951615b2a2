"""Comparing two versions of a catalogue by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from skyqa.functions.frames import scratch_path
from skyqa.operators.filters import FilterState
from skyqa.operators.ingest import complete_cases
from skyqa.operators.match import match_difference
from skyqa.operators.stats import summary_table


def compare_catalogues(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    radius_arcsec: float = 0.5,
    keep: Sequence[str] = ("ra", "dec"),
    id_column: str = "id",
    state: FilterState | None = None,
    destination: str | None = None,
) -> dict[str, DataFrame]:
    """``differences`` of the matched rows and their ``summary`` after a filter.

    The match is written once (to ``destination`` or the shared scratch folder) and both
    tables read it from there.
    """
    spark = left.sparkSession
    path = destination or scratch_path(spark, "compare")
    complete_cases(
        match_difference(left, right, values, radius_arcsec, keep, id_column)
    ).write.mode("overwrite").parquet(path)
    differences = spark.read.parquet(path)
    compared = [c for c in differences.columns if c not in (id_column, *keep)]
    return {"differences": differences, "summary": summary_table(differences, compared, state)}
