"""Frame helpers: shared storage, lineage cuts, checked broadcasts, key joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyqa.functions.clean import named

#: Rows up to which a materialised side is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 200_000
#: Bytes of their text form up to which this holds.
BROADCAST_BYTES = 64 << 20

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a ``local`` master may fall back to a temporary folder: there the driver and
    the tasks are one machine.
    """
    folder = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_CONF} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="skyqa-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/skyqa-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame reliably in shared storage and drop its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting the rows and the bytes of their text form.

    Meant for a frame that is cheap to count: one that was :func:`cut` or a file listing.
    """
    text = F.to_json(F.struct(*[named(c) for c in df.columns]), {"ignoreNullFields": "false"})
    found = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= limit and (found["bytes"] or 0) <= size else df


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on named keys in which NULL keys match each other; keys appear once."""
    hidden = {k: f"__right_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(hidden)
    condition = [named(k).eqNullSafe(named(h)) for k, h in hidden.items()]
    return left.join(other, condition, how).drop(*hidden.values())
