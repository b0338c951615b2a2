"""Near copies among vectors: hashing by quantised random projections, exact cosine checks.

Unit vectors are projected on Gaussian directions (a p-stable family for Euclidean distance), shifted and cut into cells;
``hashes`` cells together are a key of one table, and near vectors meet in at least one of many tables. Whoever meets is
compared exactly. Equal vectors are one node with a count. Nodes very near to one of them form a ball around it: two members of a ball
are linked by the triangle inequality of angles, so they need no comparison, and two balls are often decided
by the angle between their centres. Only balls in between are compared member by member, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyqa.functions.frames import cut
from skyqa.llm.components import components
from skyqa.llm.tables import written
from skyqa.llm.words import as_long, mix

#: Least cosine of a link.
COSINE = 0.9
#: Width of a cell, fewest cells of a key, and the chance with which a pair exactly at the least cosine shall meet.
WIDTH, HASHES, RECALL = 2.5, 14, 0.99
#: Random vectors a key should hold; more rows get longer keys and more tables.
KEY_ROWS = 64
#: Tables in which centres of balls are looked for (this steers the work only).
CENTRE_TABLES = 8
#: Members of a ball compared as one block.
BLOCK = 256
#: Sign bits that rule out pairs whose angle is far too large, and standard deviations of their count that are allowed.
CODE_BITS, CODE_WIDTH = 128, 6.0
#: Angles this near to a limit are decided by comparing the vectors themselves.
_SLACK = 1e-6


def meeting_chance(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at a Euclidean distance fall into one cell of one projection."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_plan(rows: int, cosine: float = COSINE, recall: float = RECALL, hashes: int | None = None) -> tuple[int, int]:
    """Cells of a key and number of tables: a pair at ``cosine`` meets with chance ``recall``, whatever the number of rows."""
    if hashes is None:
        apart = meeting_chance(math.sqrt(2))  # unrelated vectors are at right angles
        hashes = max(HASHES, math.ceil(math.log(max(rows, 1) / KEY_ROWS) / -math.log(apart)))
    near = meeting_chance(math.sqrt(2 - 2 * cosine)) ** hashes
    return hashes, math.ceil(math.log(1 - recall) / math.log1p(-near))


def _directions(d: int, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(d)
    return (
        draw.standard_normal((d, CODE_BITS)),
        draw.standard_normal((d, tables * hashes)),
        draw.uniform(0, WIDTH, tables * hashes),
    )


def table_keys(unit: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """``[vector, table]``: the key of each unit vector in each table, a 64-bit hash of its cells, the table and the dimension."""
    _, turn, shift = _directions(unit.shape[1], hashes, tables)
    cells = np.floor((unit @ turn + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), tables, hashes)
    key = mix(np.arange(tables, dtype=np.uint64)[None, :] + np.uint64(unit.shape[1] << 20) + np.zeros((len(unit), 1), np.uint64))
    for k in range(hashes):
        key = mix(key ^ cells[:, :, k])
    return key


def sign_codes(unit: np.ndarray) -> np.ndarray:
    """``[vector, 2]``: signs of further projections as two 64-bit words. The share of unlike signs follows the angle."""
    turn = _directions(unit.shape[1], 1, 1)[0]
    return np.packbits(unit @ turn > 0, axis=1, bitorder="little").view("<u8")


def unit_vectors(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, unit vectors)`` in double precision, for each number of components."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(np.asarray(lists.offsets))
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        v = np.asarray(lists.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), d)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares of tiny or huge components in range
        yield rows, v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _usable(column: str) -> str:
    finite = f"forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return f"coalesce(size({column}) > 0 and {finite} and exists({column}, x -> x <> 0), false)"


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, hashes: int | None = None, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Rows link if the cosine of their vectors is ``cosine`` or more in double precision on the given components; no pair below is
    linked, and a pair at ``cosine`` is found with chance ``recall``, a nearer one with a higher one. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest id reachable, ``kept`` marks the row that has it.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, as do rows without an id (their component is NULL,
    and they are kept). Vectors with different numbers of components do not link. Rows that repeat an id or a vector are
    vectors of their own. An empty table gives no rows. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("v"))
    rows = rows.withColumn("takes_part", F.col("vec_id").isNotNull() & F.expr(_usable("v")))
    # -0.0 and 0.0 are one value; equal vectors are those with two equal 64-bit hashes
    plain = F.expr("transform(v, x -> if(x = 0, x - x, x))")
    prints = {"h": F.xxhash64(F.lit(1), plain), "g": F.xxhash64(F.lit(2), plain)}
    nodes = written(
        rows.where("takes_part").select("vec_id", "v", *[c.alias(k) for k, c in prints.items()])
        .groupBy("h", "g").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    hashes, tables = table_plan(nodes.count(), cosine, recall, hashes)
    members = written(_members(nodes, cosine, hashes), "balls")
    balls = cut(
        members.groupBy("leader").agg(
            F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("members"), F.max("angle").alias("radius"), F.min("low").alias("low")
        )
    )
    met = cut(_decided(_met(nodes, members, balls, cosine, hashes, tables), nodes, balls, cosine))
    partial = cut(_compared(nodes, members, balls, met.where("state = 'open'"), cosine))

    # rows linked with a whole ball, with single members of others, and with the others of the own ball
    near = met.where("state = 'all'")
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole = both.join(balls.select(F.col("leader").alias("b"), "rows"), "b").groupBy(F.col("a").alias("leader")).agg(F.sum("rows").alias("whole"))
    single = partial.where("node is not null").groupBy("node").agg(F.sum("n").alias("single"))
    links = near.select("a", "b").unionByName(partial.where("node is null").select("a", "b"))
    groups = components(links).join(balls.select(F.col("leader").alias("node"), "low"), "node")
    lowest = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    of_ball = groups.join(lowest, "component").select(F.col("node").alias("leader"), "component_id")
    by_ball = balls.join(whole, "leader", "left").join(of_ball, "leader", "left")
    by_ball = by_ball.select("leader", F.col("rows") - 1 + F.coalesce("whole", F.lit(0)), F.coalesce("component_id", "low"))
    by_node = (
        members.select("node", "leader").join(by_ball.toDF("leader", "in_balls", "component_id"), "leader").join(single, "node", "left")
        .join(nodes.select("node", "h", "g"), "node")
        .select("h", "g", (F.col("in_balls") + F.coalesce("single", F.lit(0))).alias("n_links"), "component_id")
    )
    keyed = rows.select("vec_id", *[F.when(F.col("takes_part"), c).alias(k) for k, c in prints.items()])
    found = keyed.join(by_node, ["h", "g"], "left")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _code_limit(angle: str) -> str:
    """SQL of the unlike sign bits that two vectors within an angle have at most, but for a chance of about 1e-9."""
    p = f"least({angle} / pi(), 0.5D)"
    return f"{CODE_BITS} * {p} + {CODE_WIDTH} * sqrt({CODE_BITS} * {p} * (1 - {p}))"


def _keyed(rows: DataFrame, hashes: int, tables: int, n_tables: int) -> DataFrame:
    """``rows`` with ``v`` replaced by ``keys``, those of the first ``n_tables`` of ``tables`` tables, and the sign code ``c, d``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("v")
            keys, codes = np.zeros((batch.num_rows, n_tables), np.uint64), np.zeros((batch.num_rows, 2), np.uint64)
            for own, unit in unit_vectors(batch.column(at)):
                keys[own], codes[own] = table_keys(unit, hashes, tables)[:, :n_tables], sign_codes(unit)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_tables), pa.array(as_long(keys.ravel())))
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, lists, *(pa.array(as_long(c.copy())) for c in codes.T)], names)

    kept = [f for f in rows.schema.fields if f.name != "v"]
    names = [*(f.name for f in kept), "keys", "c", "d"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(hashed, f"{schema}, keys array<long>, c long, d long")


def _cosines(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b, v, o_v)`` as ``a, b, cos``, exactly."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = np.zeros(batch.num_rows)
            others = {len(u[0]): (rows, u) for rows, u in unit_vectors(batch.column(3)) if len(rows)}
            for rows, u in unit_vectors(batch.column(2)):
                their, o = others.get(u.shape[1], (np.zeros(0, np.int64), np.zeros((0, u.shape[1]))))
                same, i, j = np.intersect1d(rows, their, assume_unique=True, return_indices=True)
                cos[same] = (u[i] * o[j]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos)], ["a", "b", "cos"])

    return pairs.select("a", "b", "v", "o_v").mapInArrow(compared, "a long, b long, cos double")


def _with_vectors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(nodes.select(F.col("node").alias("a"), "v"), "a").join(nodes.select(F.col("node").alias("b"), F.col("v").alias("o_v")), "b")


def _members(nodes: DataFrame, cosine: float, hashes: int) -> DataFrame:
    """``node, leader, angle, copies, low``: the ball of each node.

    In some tables each node is compared with the smallest node of its key. Nodes without a smaller one within half the angle of
    a link are centres, the others go to the smallest such centre that they met; a node that met none is a ball of its own.
    """
    half = math.acos(cosine) / 2 - _SLACK
    keyed = _keyed(nodes.select("node", "v"), hashes, CENTRE_TABLES, CENTRE_TABLES).withColumn("key", F.explode("keys")).drop("keys")
    first = keyed.groupBy("key").agg(F.min(F.struct(F.col("node").alias("b"), F.col("c").alias("o_c"), F.col("d").alias("o_d"))).alias("first"))
    like = f"bit_count(c ^ first.o_c) + bit_count(d ^ first.o_d) <= {_code_limit(f'{half}D')}"
    met = keyed.join(first, "key").where("node > first.b").where(like)
    pairs = met.select(F.col("node").alias("a"), "first.b").distinct()
    near = cut(_cosines(_with_vectors(pairs, nodes)).where(F.col("cos") >= math.cos(half)))
    follower = near.select(F.col("a").alias("b")).distinct()
    own = near.join(follower, "b", "left_anti").groupBy(F.col("a").alias("node")).agg(F.min(F.struct("b", "cos")).alias("own"))
    angle = F.coalesce(F.acos(F.least("own.cos", F.lit(1.0))), F.lit(0.0))
    return nodes.join(own, "node", "left").select("node", F.coalesce("own.b", "node").alias("leader"), angle.alias("angle"), "copies", "low")


def _met(nodes: DataFrame, members: DataFrame, balls: DataFrame, cosine: float, hashes: int, tables: int) -> DataFrame:
    """``a, b``: pairs of balls of which members meet in a table and that the codes of their centres do not rule out."""
    centres = _keyed(nodes.join(balls.select(F.col("leader").alias("node"), "radius"), "node").select("node", "radius", "v"), 1, 1, 1)
    centres = centres.select(F.col("node").alias("leader"), "radius", F.col("c").alias("lc"), F.col("d").alias("ld"))
    placed = nodes.select("node", "v").join(members.select("node", "leader"), "node").join(centres, "leader")
    keyed = _keyed(placed.select("leader", "radius", "lc", "ld", "v"), hashes, tables, tables)
    seats = keyed.select(F.explode("keys").alias("key"), "leader", "radius", "lc", "ld").dropDuplicates(["key", "leader"])
    others = seats.select("key", *[F.col(c).alias(f"o_{c}") for c in seats.columns[1:]])
    like = f"bit_count(lc ^ o_lc) + bit_count(ld ^ o_ld) <= {_code_limit(f'({math.acos(cosine)}D + radius + o_radius)')}"
    together = seats.join(others, (seats["key"] == others["key"]) & (F.col("leader") < F.col("o_leader")) & F.expr(like))
    return together.select(F.col("leader").alias("a"), F.col("o_leader").alias("b")).distinct()


def _decided(pairs: DataFrame, nodes: DataFrame, balls: DataFrame, cosine: float) -> DataFrame:
    """``a, b, state``: whether all members of two balls are linked (``all``) or some may be (``open``); the others are left out."""
    size = balls.select("leader", "radius", "members")
    found = _cosines(_with_vectors(pairs, nodes))
    for end in "ab":
        found = found.join(size.toDF(end, f"{end}_radius", f"{end}_members"), end)
    limit = math.acos(cosine)
    angle, reach = F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0))), F.col("a_radius") + F.col("b_radius")
    alone = (F.col("a_members") == 1) & (F.col("b_members") == 1)
    state = (
        F.when(alone, F.when(F.col("cos") >= cosine, "all"))
        .when(angle + reach < limit - _SLACK, "all")
        .when(angle - reach < limit + _SLACK, "open")
    )
    return found.select("a", "b", state.alias("state")).where("state is not null")


def _compared(nodes: DataFrame, members: DataFrame, balls: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """Members of undecided pairs of balls against each other: ``node, n`` (rows of the other ball it is linked with), and
    ``a, b`` for each two balls that are linked."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    parts = balls.join(asked, "leader").select("leader", F.ceil(F.col("members") / BLOCK).alias("parts"))
    rows = members.join(parts, "leader").join(nodes.select("node", "v"), "node")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    # about BLOCK members each
    blocks = rows.groupBy("leader", "part").agg(F.collect_list(F.struct("node", "copies", "v")).alias("held"))
    left, right = blocks.select(F.col("leader").alias("a"), "held"), blocks.select(F.col("leader").alias("b"), F.col("held").alias("o_held"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "held", "o_held")
    return met.mapInArrow(lambda batches: _linked(batches, cosine), "a long, b long, node long, n long")


def _linked(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            (ids, copies, u), (o_ids, o_copies, o) = (_block(batch.column(k)[i].values) for k in (2, 3))
            hit = u @ o.T >= cosine
            if not hit.any():
                continue
            n, o_n = hit @ o_copies, copies @ hit
            node = np.concatenate([ids[n > 0], o_ids[o_n > 0]])
            columns = [
                pa.array([*[None] * len(node), batch.column(0)[i].as_py()], pa.int64()),
                pa.array([*[None] * len(node), batch.column(1)[i].as_py()], pa.int64()),
                pa.array([*node.tolist(), None], pa.int64()),
                pa.array([*n[n > 0].tolist(), *o_n[o_n > 0].tolist(), None], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "node", "n"])


def _block(held: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, copies and unit vectors of a block; a ball holds vectors of one size only."""
    (_, unit), = unit_vectors(held.field(2))
    return np.asarray(held.field(0)), np.asarray(held.field(1)), unit
