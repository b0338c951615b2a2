"""Partition keys (filter, tract, visit): listing, checking and grouping them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyqa.functions.clean import named
from skyqa.functions.frames import broadcast_if_small, join_on


def enumerate_keys(
    metadata: DataFrame,
    nested: str = "visits",
    filter_name: str = "filter",
    tract_name: str = "tract",
    visit_name: str | None = "visit",
) -> DataFrame:
    """Flatten ``map<filter, map<tract, array<visit>>>`` rows into one row per key.

    With ``visit_name=None`` the two-level keys (filter, tract) come back.
    """
    by_tract = metadata.select(F.explode(named(nested)).alias(filter_name, "__tracts")).select(
        named(filter_name), F.explode("__tracts").alias(tract_name, "__visits")
    )
    if visit_name is None:
        return by_tract.select(named(filter_name), named(tract_name)).distinct()
    return by_tract.select(
        named(filter_name), named(tract_name), F.explode("__visits").alias(visit_name)
    )


def existing_keys(keys: DataFrame, available: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys for which data exists."""
    # distinct first: one row per key goes into the join, not one per object
    return join_on(keys, available.select(*[named(k) for k in on]).distinct(), on, "left_semi")


def key_chunks(keys: DataFrame, by: str, chunk_size: int) -> DataFrame:
    """Number the keys of each ``by`` value into strided chunks of at most ``chunk_size``.

    There is always at least one chunk. The input is a list of distinct partition keys,
    which is metadata: one row per partition of a table, not per object.
    """
    rest = [named(c) for c in keys.columns if c != by]
    here = W.partitionBy(named(by))
    n = F.count(F.lit(1)).over(here)
    n_chunks = F.greatest(F.lit(1), F.ceil(n / F.lit(chunk_size))).cast("int")
    position = F.row_number().over(here.orderBy(*rest)) - 1
    return keys.withColumn("chunk", F.pmod(position, n_chunks))


def keys_by_chunk(keys: DataFrame, by: str, key: str, chunk_size: int) -> DataFrame:
    """The keys of each ``by`` value as sorted lists of bounded length, one per chunk."""
    return (
        key_chunks(keys, by, chunk_size)
        .groupBy(named(by), "chunk")
        .agg(F.sort_array(F.collect_list(named(key))).alias(f"{key}s"))
    )


def _number(text: Column) -> Column:
    """Integer of a text, NULL if it is none. The pattern goes first because a cast that
    fails costs an exception per row."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def tracts_from_paths(paths: DataFrame, path: str = "path", tract: str = "tract") -> DataFrame:
    """Distinct tract numbers: the digits after the last dash of a name that says ``tract``."""
    digits = F.regexp_extract(named(path), r"tract[^/]*-([0-9]+)(?:\.[^/]*)?(?:/|$)", 1)
    number = F.when(F.contains(named(path), F.lit("tract")), _number(digits))
    return paths.select(number.alias(tract)).where(named(tract).isNotNull()).distinct()


def filters_from_paths(
    paths: DataFrame, path: str = "path", folder: str = "plots", filter_name: str = "filter"
) -> DataFrame:
    """Distinct folder names directly below ``folder``."""
    below = F.regexp_extract(named(path), rf"(?:^|/){folder}/([^/]+)/", 1)
    return paths.select(below.alias(filter_name)).where(F.length(named(filter_name)) > 0).distinct()


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of a table, sorted."""
    columns = [named(k) for k in keys]
    return df.select(*columns).distinct().orderBy(*columns)


def valid_tracts(wanted: DataFrame, present: DataFrame, tract: str = "tract") -> DataFrame:
    """The wanted tracts that are present; all present tracts if none is."""
    here = present.select(named(tract)).distinct()
    asked = wanted.select(named(tract)).distinct().withColumn("__asked", F.lit(True))
    marked = here.join(broadcast_if_small(asked), tract, "left")
    none_found = ~F.coalesce(marked.agg(F.bool_or(F.col("__asked").isNotNull())).scalar(), F.lit(False))
    return marked.where(F.col("__asked").isNotNull() | none_found).select(named(tract))


def selection_keys(
    selections: DataFrame,
    active: DataFrame,
    text: str = "selection",
    keep: Sequence[str] = (),
    tract: str = "tract",
) -> DataFrame:
    """Typed tract lists (``"9615, 9697"``) as distinct ids that are active.

    Works on a table of saved selections; blanks and entries that are no number are
    dropped. ``keep`` names columns that identify a selection.
    """
    entries = F.explode(F.split(F.replace(named(text), F.lit(" "), F.lit("")), ",")).alias("__entry")
    number = _number(F.col("__entry")).alias(tract)
    numbers = selections.select(*[named(k) for k in keep], entries).select(*[named(k) for k in keep], number)
    asked = numbers.where(named(tract).isNotNull()).distinct()
    found = asked.join(active.select(named(tract)).distinct(), tract, "left_semi")
    return found.select(*[named(k) for k in keep], named(tract))
