"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyqa.functions.frames import BROADCAST_ROWS
from skyqa.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node it reaches) for every node of ``links(a, b)``.

    Links are rewired towards the smallest neighbour, first those to larger nodes, then those to smaller ones,
    until each component is a star around its smallest node. A node of many links is never gathered: its smallest neighbour is
    an aggregate, and the join that spreads it can be split. Repeated links and links to itself change nothing.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
        small = F.broadcast if 2 * state[0] <= BROADCAST_ROWS else lambda nodes: nodes  # each edge has two nodes at most
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = edges.select(F.inline(ends))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(small(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        edges = written(large.join(small(low), "u").select(F.inline(ends)).where("u > v").distinct(), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
