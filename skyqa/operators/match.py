"""Positional matching of catalogues, matched differences and the match-table join.

Positions become unit vectors, so neither RA = 0 nor the poles need special treatment.
Vectors are bucketed into cubes and joined by cube, an ordinary equi-join. Only the left
side is copied, into the cubes its search sphere touches (about two on average).

Cubes crowded with right positions are not joined as a whole. They are split level by
level, and a left row follows only the sub-cubes that can still hold one of its ``k``
nearest, until what is left is small. That keeps the work per left row bounded however
crowded the sky is, and the result exact: a sub-cube is dropped only when enough
positions are known to be nearer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyqa.functions.clean import finite_or_null, named
from skyqa.functions.frames import broadcast_if_small, cut, join_on
from skyqa.functions.observed import Watch
from skyqa.operators.schema import magnitude_names

#: Right positions in one cube up to which left rows are compared with all of them.
LEAF = 128

_CUBE_RADII = 8.0
_SPLIT = 4.0
_SLACK = 1e-9
_CUBE = ("cx", "cy", "cz")
_SUB = ("sx", "sy", "sz")


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    """``x, y, z`` of a position in degrees."""
    a, d = F.radians(ra), F.radians(dec)
    return [(F.cos(a) * F.cos(d)).alias("x"), (F.sin(a) * F.cos(d)).alias("y"), F.sin(d).alias("z")]


def chord_of(angle_deg: float) -> float:
    """Chord of an angle on the unit sphere."""
    return 2.0 * math.sin(math.radians(min(angle_deg, 180.0)) / 2.0)


def angle_of(chord: Column) -> Column:
    """Angle in degrees of a chord on the unit sphere."""
    return F.degrees(2 * F.asin(F.least(chord / 2, F.lit(1.0))))


def _length(parts: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def _places(df: DataFrame, id_column: str, ra: str, dec: str) -> DataFrame:
    """One column ``at``: the id and the position of every row."""
    position = {"ra": finite_or_null(named(ra).cast("double")), "dec": finite_or_null(named(dec).cast("double"))}
    return df.select(F.struct(named(id_column).alias("id"), *[c.alias(n) for n, c in position.items()]).alias("at"))


def _placed(places: DataFrame) -> DataFrame:
    return places.where(F.col("at.ra").isNotNull() & F.col("at.dec").isNotNull())


def _cube_of(size: float, names: Sequence[str]) -> dict[str, Column]:
    return {n: F.floor(F.col(v) / F.lit(size)) for n, v in zip(names, "xyz", strict=True)}


def neighbours(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    k: int = 1,
    left_id: str = "id",
    right_id: str = "id",
    ra: str = "ra",
    dec: str = "dec",
    leaf: int = LEAF,
    unique_ids: bool = False,
) -> DataFrame:
    """The up to ``k`` nearest right rows strictly within ``radius`` degrees of each left row.

    Returns ``left_id, neighbour, right_id, distance``: ``neighbour`` counts from 1 and
    ``distance`` is in degrees. A left row without any neighbour has one row with NULLs.
    Equal distances are ordered by the right id. Rows without a position match nothing.

    Left ids may repeat: neighbours belong to an id at a position, and each row of it gets
    them. Known to be unique (``unique_ids``), the left rows need no exchange to merge copies.
    """
    reach = chord_of(radius)
    size = reach * _CUBE_RADII
    lefts = _placed(_places(left, left_id, ra, dec)).withColumnRenamed("at", "lid")
    if not unique_ids:
        lefts = lefts.distinct()
    lefts = lefts.select("lid", *unit_vector(F.col("lid.ra"), F.col("lid.dec")))
    rights = _placed(_places(right, right_id, ra, dec)).select(
        F.col("at.id").alias("rid"), *unit_vector(F.col("at.ra"), F.col("at.dec"))
    )
    rights = rights.withColumns(_cube_of(size, _CUBE))

    wide = reach * (1 + _SLACK) + 1e-15
    touched = lefts
    for name, axis in zip(_CUBE, "xyz", strict=True):
        # a cube is wider than the search sphere, so it touches one cube or two
        low, high = (F.floor((F.col(axis) + side * wide) / F.lit(size)) for side in (-1, 1))
        touched = touched.withColumn(
            name, F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high)))
        )

    crowded = cut(rights.groupBy(*_CUBE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf).drop("n"))
    if crowded.isEmpty():
        pairs = _pairs(touched, rights, _CUBE)
    else:
        marked = broadcast_if_small(crowded)
        on = list(_CUBE)
        pairs = _pairs(touched, rights.join(marked, on, "left_anti"), _CUBE).unionByName(
            _crowded_pairs(
                touched.join(marked, on, "left_semi"), rights.join(marked, on, "left_semi"), reach, size, k, leaf
            )
        )
    nearest = W.partitionBy("lid").orderBy("chord", "rid")
    ranked = (
        pairs.where(F.col("chord") < F.lit(reach))
        .withColumn("neighbour", F.row_number().over(nearest))
        .where(F.col("neighbour") <= k)
        .select("lid", "neighbour", F.col("rid").alias("__rid"), angle_of(F.col("chord")).alias("distance"))
    )
    rows = _places(left, left_id, ra, dec)
    return rows.join(ranked, F.col("at") == F.col("lid"), "left").select(
        F.col("at.id").alias(left_id),
        F.coalesce("neighbour", F.lit(1)).alias("neighbour"),
        F.col("__rid").alias(right_id if right_id != left_id else f"{right_id}_2"),
        "distance",
    )


def _pairs(lefts: DataFrame, rights: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left and right rows of the same cube with their chord."""
    here = lefts.select("lid", *[F.col(v).alias(f"l{v}") for v in "xyz"], *on)
    there = rights.select("rid", *[F.col(v).alias(f"r{v}") for v in "xyz"], *on)
    chord = _length([F.col(f"l{v}") - F.col(f"r{v}") for v in "xyz"])
    return here.join(there, list(on)).select("lid", chord.alias("chord"), "rid")


def _crowded_pairs(
    front: DataFrame, rights: DataFrame, reach: float, size: float, k: int, leaf: int
) -> DataFrame:
    """Candidate pairs inside crowded cubes; holds the ``k`` nearest of every left row there."""
    # copies of one position are as near as each other: the k lowest ids stand for all of them
    same = W.partitionBy("x", "y", "z").orderBy("rid")
    points = cut(
        rights.withColumn("__copy", F.row_number().over(same))
        .where(F.col("__copy") <= k)
        .groupBy("x", "y", "z", *_CUBE)
        .agg(F.collect_list("rid").alias("rids"))
    )
    front = front.withColumn("bound", F.lit(float(reach)))
    found = []
    while True:
        size /= _SPLIT
        points = points.withColumns(_cube_of(size, _SUB))
        boxes = points.groupBy(*_CUBE, *_SUB).agg(
            F.count(F.lit(1)).alias("positions"),
            F.sum(F.size("rids")).alias("members"),
            *[f(v).alias(f"{n}{v}") for v in "xyz" for n, f in (("lo", F.min), ("hi", F.max))],
        )
        opened = cut(_open_cubes(front, boxes, k))
        parents = list(_CUBE)
        shifted = [F.col(s).alias(c) for s, c in zip(_SUB, _CUBE, strict=True)]
        carried = ["lid", "x", "y", "z", "bound"]
        inside = points.select("x", "y", "z", "rids", *shifted)
        small = opened.where(F.col("positions") <= leaf).select(*carried, *shifted)
        large = opened.where(F.col("positions") > leaf)
        found.append(_pairs(small, inside.withColumn("rid", F.explode("rids")), _CUBE))
        if large.isEmpty():
            break
        still = broadcast_if_small(cut(large.select(*shifted).distinct()))
        front = large.select(*carried, *shifted)
        points = cut(inside.join(still, parents, "left_semi"))
    return reduce(DataFrame.unionByName, found)


def _open_cubes(front: DataFrame, boxes: DataFrame, k: int) -> DataFrame:
    """Replace each cube a left row follows by those sub-cubes that may hold a neighbour."""

    def off(v: str) -> Column:
        return F.greatest(F.col(f"lo{v}") - F.col(v), F.col(v) - F.col(f"hi{v}"), F.lit(0.0))

    def far(v: str) -> Column:
        return F.greatest(F.abs(F.col(f"lo{v}") - F.col(v)), F.abs(F.col(f"hi{v}") - F.col(v)))

    met = front.join(boxes, list(_CUBE)).withColumns(
        {"near": _length([off(v) for v in "xyz"]), "far": _length([far(v) for v in "xyz"])}
    )
    # a sub-cube with k members bounds the distance of the k-th neighbour
    safe = F.min(F.when(F.col("members") >= k, F.col("far"))).over(W.partitionBy("lid"))
    return (
        met.withColumn("bound", F.least("bound", safe))
        .where(F.col("near") * (1 - _SLACK) <= F.col("bound"))
        .select("lid", "x", "y", "z", "bound", "positions", *_SUB)
    )


def primary(df: DataFrame, flag: str = "detect_isPrimary") -> DataFrame:
    """The primary detections of a catalogue."""
    return df.where(named(flag))


def _check_catalogue(df: DataFrame, needed: Sequence[str], id_column: str, check_ids: bool) -> None:
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"catalogue lacks {', '.join(missing)}")
    if check_ids and not df.groupBy(named(id_column)).count().where("count > 1").isEmpty():
        raise ValueError(f"{id_column} is not unique")


def sky_match(
    left: DataFrame,
    right: DataFrame,
    radius_arcsec: float = 0.5,
    id_column: str = "id",
    ra: str = "ra",
    dec: str = "dec",
    flag: str = "detect_isPrimary",
    check_ids: bool = True,
    leaf: int = LEAF,
    watch: Watch | None = None,
) -> DataFrame:
    """Nearest primary right row of each primary left row: ``id, match_id, match_distance``.

    Distances are in arcseconds. One-way: several left rows may share a right row. Left
    rows without a match have NULLs. With a ``watch`` the first use of the frame also counts the rows with
    and without a match.
    """
    for df in (left, right):
        _check_catalogue(df, [id_column, ra, dec, flag], id_column, check_ids)
    found = neighbours(
        primary(left, flag), primary(right, flag), radius_arcsec / 3600.0, 1, id_column, id_column, ra, dec, leaf,
        unique_ids=check_ids,
    )
    matched = found.select(
        named(id_column),
        named(f"{id_column}_2").alias("match_id"),
        (F.col("distance") * 3600.0).alias("match_distance"),
    )
    if watch is None:
        return matched
    counts = {"n_matched": F.count("match_id"), "n_unmatched": F.count_if(F.col("match_id").isNull())}
    return watch.on(matched, "match", counts, lambda n: [] if n["n_matched"] else ["no row has a match"])


def match_counts(matched: DataFrame) -> DataFrame:
    """One row: how many left rows are matched and how many are not."""
    return matched.agg(
        F.count("match_id").alias("n_matched"),
        (F.count(F.lit(1)) - F.count("match_id")).alias("n_unmatched"),
    )


def magnitudes_from_differences(df: DataFrame, mag: str = "psfMag") -> DataFrame:
    """Add ``<x>_mag = <x>_magDiff + psfMag`` for every column that ends in ``_magDiff``."""
    return df.withColumns({new: named(c) + named(mag) for c, new in magnitude_names(df.columns).items()})


def match_difference(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    radius_arcsec: float = 0.5,
    keep: Sequence[str] = (),
    id_column: str = "id",
    ra: str = "ra",
    dec: str = "dec",
    flag: str = "detect_isPrimary",
    check_ids: bool = True,
    leaf: int = LEAF,
) -> DataFrame:
    """Value columns of the matched right row **minus** those of the left row.

    Key columns (``keep``) are those of the left row. Left rows without a match, including
    those that are not primary, keep NULL differences. ``_magDiff`` columns are compared
    as magnitudes: their difference is under the name that ends in ``_mag``.
    """
    matched = sky_match(left, right, radius_arcsec, id_column, ra, dec, flag, check_ids, leaf)
    renamed = magnitude_names(values)
    compared = [renamed.get(v, v) for v in values]
    first = magnitudes_from_differences(left).select(
        named(id_column), *[named(c) for c in keep], *[named(v).alias(f"__1_{v}") for v in compared]
    )
    second = magnitudes_from_differences(right).select(
        named(id_column).alias("match_id"), *[named(v).alias(f"__2_{v}") for v in compared]
    )
    pairs = matched.where(F.col("match_id").isNotNull()).join(second, "match_id")
    return first.join(pairs, id_column, "left").select(
        named(id_column),
        *[named(c) for c in keep],
        *[(named(f"__2_{v}") - named(f"__1_{v}")).alias(v) for v in compared],
        "match_distance",
    )


def match_table_values(
    objects: DataFrame,
    matches: DataFrame,
    sources: DataFrame,
    value: str,
    flag: str = "calib_psf_used",
    object_id: str = "object_id",
    visit: str = "visit",
    match_id: str = "match_id",
) -> DataFrame:
    """Long match table: ``object_id, visit, value`` of the flagged objects.

    ``matches`` links objects to the sources of each visit; ``sources`` holds the values.
    """
    flagged = objects.where(named(flag)).select(named(object_id))
    links = join_on(matches, flagged, [object_id], "left_semi").where(named(match_id).isNotNull())
    values = sources.select(named(visit), named(match_id), named(value))
    return links.join(values, [visit, match_id]).select(named(object_id), named(visit), named(value))


def match_pivot(
    long: DataFrame,
    visits: Sequence[int],
    value: str,
    object_id: str = "object_id",
    visit: str = "visit",
    prefix: str = "visit_",
) -> DataFrame:
    """Wide match table: one row per object and one column per listed visit."""
    picked = [F.max(F.when(named(visit) == F.lit(v), named(value))).alias(f"{prefix}{v}") for v in visits]
    return long.groupBy(named(object_id)).agg(*picked)
