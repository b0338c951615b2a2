"""The given tables seen as object catalogues, in one SQL text that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyqa.functions.clean import named
from skyqa.operators.ingest import normalize

KEYS = ["band", "tract"]
VISIT_KEYS = ["band", "tract", "visit"]
METRICS = ["metric_a", "metric_b"]
VALUES = ["dec", "flux", "metric_a", "metric_b", "psfMag", "ra"]

# one raw catalogue row per line item
_RAW = {
    "band": "l_returnflag",
    "tract": "cast(l_suppkey as int)",
    "visit": "l_linenumber",
    "patch": "l_partkey % 9",
    "coord_ra": "radians((l_orderkey * 7919 % 3600000) / 1e4)",
    "coord_dec": "radians((l_partkey * 104729 % 1600000) / 1e4 - 8e1)",
    "flux": "l_extendedprice - 2e3",
    "metric_a": "l_quantity",
    "metric_b": "case when l_tax > 7e-2 and l_linenumber = 7 then null else l_discount + 0e0 end",
    "flag_used": "l_linestatus = 'O'",
    "flag_bad": "l_tax > 7e-2",
}
_CAT = ",\n".join(f"{e} as {n}" for n, e in _RAW.items())

# after normalising
_NRM = """select band, tract, visit, patch, degrees(coord_ra) as ra, degrees(coord_dec) as dec,
case when flux > 0 then -2.5e0 * log10(flux) end as "psfMag",
flux, metric_a, metric_b, flag_used, flag_bad from cat"""

_FIRST = {
    "id": "c_custkey",
    "ra": "(c_custkey * 7919 % 3600000) / 1e4",
    "dec": "(c_custkey * 104729 % 1600000) / 1e4 - 8e1",
    "detect_isPrimary": "c_mktsegment <> 'BUILDING'",
    "psfMag": "c_acctbal / 1e3",
    "kron_magDiff": "c_nationkey / 1e1",
    "shape": "c_acctbal + 0e0",
}
_SECOND = _FIRST | {
    "ra": "(c_custkey * 7919 % 3600000) / 1e4 + (c_custkey % 4) / 3.6e3",
    "detect_isPrimary": "c_nationkey <> 3",
    "psfMag": "c_acctbal / 1e3 + 5e-1",
    "shape": "c_acctbal * 1.5e0",
}
# a crowded field: a thousand positions in a tenth of a degree, the rest are copies of them
_CROWD_A = {
    "id": "c_custkey",
    "ra": "1e1 + 5e-2 * sin((c_custkey * 7919 % 1000) * 1.7e0)",
    "dec": "5e-2 * cos((c_custkey * 7919 % 1000) * 2.3e0)",
}
_CROWD_B = _CROWD_A | {"ra": "1e1 + 1e-4 + 5e-2 * sin((c_custkey * 7919 % 1000) * 1.7e0)"}

_BOXES = {
    "tract": "cast(s_suppkey as int)",
    "x0": "(s_suppkey * 7919 % 3560) / 1e1",
    "x1": "(s_suppkey * 7919 % 3560) / 1e1 + 4e0",
    "y0": "(s_suppkey * 104729 % 1560) / 1e1 - 8e1",
    "y1": "(s_suppkey * 104729 % 1560) / 1e1 - 7.6e1",
}
# strips of the sky that overlap at their edges
_STRIPS = {
    "tract": "n_nationkey",
    "x0": "n_nationkey * 1.44e1",
    "x1": "n_nationkey * 1.44e1 + 1.5e1",
    "y0": "-8e1 + 0e0 * n_nationkey",
    "y1": "8e1 + 0e0 * n_nationkey",
}


def _sql(columns: dict[str, str], table: str) -> str:
    return "select " + ", ".join(f'{e} as "{n}"' for n, e in columns.items()) + f" from {table}"


CTES = {
    "cat": f"select {_CAT} from lineitem",
    "nrm": _NRM,
    "first_cat": _sql(_FIRST, "customer"),
    "second_cat": _sql(_SECOND, "customer"),
    "crowd_a": _sql(_CROWD_A, "customer"),
    "crowd_b": _sql(_CROWD_B, "customer"),
    "boxes": _sql(_BOXES, "supplier"),
    "strips": _sql(_STRIPS, "nation"),
}
_NEEDS = {"nrm": ["cat"]}


def with_ctes(sql: str, *names: str, **more: str) -> str:
    """A query with the catalogue views it needs in front."""
    wanted: dict[str, str] = {}
    for n in names:
        for needed in [*_NEEDS.get(n, []), n]:
            wanted[needed] = CTES[needed]
    wanted |= more
    views = ",\n".join(f"{n} as (\n{q}\n)" for n, q in wanted.items())
    return f"with {views}\n{sql}" if views else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).select(*[F.expr(e).alias(n) for n, e in columns.items()])


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", _RAW)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised catalogue, without the raw positions."""
    return normalize(raw_catalogue(spark, sf_dir), flux="flux").drop("coord_ra", "coord_dec")


def first_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", _FIRST)


def second_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", _SECOND)


def crowded_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _view(spark, sf_dir, "customer", _CROWD_A), _view(spark, sf_dir, "customer", _CROWD_B)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supplier", _BOXES)


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "nation", _STRIPS)


# Means of decimals often end in an exact half of the last digit kept, where one engine's
# sum is a bit below and the other's a bit above. Rounding the half a little off centre
# makes both go the same way; it also turns -0.0 into 0.0.
_OFF_CENTRE = 0.123


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for a comparison across engines."""
    shift = F.lit(_OFF_CENTRE / 10**digits)
    return df.select(
        *[
            F.round(named(f.name) + shift, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else named(f.name)
            for f in df.schema.fields
        ]
    )


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """The SQL of :func:`rounded` for one expression."""
    return f'{plain_r(expression, digits)} as "{name or expression}"'


def plain_r(expression: str, digits: int = 6) -> str:
    return f"round(({expression}) + {_OFF_CENTRE / 10**digits!r}, {digits})"
