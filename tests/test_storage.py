import json

import pytest
from pyspark.sql import functions as F

from skyqa.functions.frames import broadcast_if_small, join_on, scratch_path, shared_dir
from skyqa.operators.keys import (
    distinct_keys,
    enumerate_keys,
    existing_keys,
    filters_from_paths,
    key_chunks,
    keys_by_chunk,
    selection_keys,
    tracts_from_paths,
    valid_tracts,
)
from skyqa.sources.layout import (
    load_stats,
    save_bucketed_table,
    write_incremental,
    write_partitioned,
    write_stats,
)
from skyqa.sources.readers import (
    NoDataError,
    list_files,
    load_key,
    read_geojson,
    read_skymap_csv,
    read_with_keys,
    scan,
)
from skyqa.streaming.incremental import append_new_files

KEYS = ["filter", "tract"]
from skyqa.sources import layout, readers


@pytest.fixture
def rows(spark):
    return spark.range(1000).select(
        F.when(F.col("id") < 400, "HSC-R").when(F.col("id") < 700, "HSC-I").otherwise("HSC-G").alias("filter"),
        (9000 + F.col("id") % 3).cast("int").alias("tract"),
        F.concat(F.col("id") % 9, F.lit(","), F.col("id") % 4).alias("patch"),
        (F.col("id") / 7).alias("m"),
    )


def same(a, b):
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_partitioned_write_keeps_the_rows_and_can_be_repeated(spark, rows):
    path = scratch_path(spark, "t")
    write_partitioned(rows, path, KEYS, "patch")
    write_partitioned(rows.where("filter = 'HSC-R'"), path, KEYS, "patch")
    back = scan(spark, path)
    assert same(rows, back)
    # a patch is in one bucket
    assert back.groupBy("patch").agg(F.count_distinct("bucket").alias("n")).where("n > 1").isEmpty()
    write_partitioned(rows.limit(10), path, KEYS, "patch", mode="append")
    assert scan(spark, path).count() == 1010


@pytest.mark.parametrize(("size", "chunks"), [(1, 9), (2, 6), (100, 3)])
def test_incremental_load(spark, rows, size, chunks):
    path = scratch_path(spark, "t")
    assert write_incremental(rows, path, KEYS, "patch", chunk_keys=size) == chunks
    assert same(rows, scan(spark, path))


def test_scan_prunes(spark, rows):
    path = scratch_path(spark, "t")
    write_partitioned(rows, path, KEYS, "patch")
    df = scan(spark, path, [[("filter", "==", "HSC-R"), ("tract", "in", [9000, 9001])], [("m", ">", 140)]], ["m"])
    assert df.count() == rows.where("(filter = 'HSC-R' and tract in (9000, 9001)) or m > 140").count()
    plan = scan(spark, path, [[("filter", "==", "HSC-R"), ("m", ">", 5)]], ["m"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(filter" in plan and "GreaterThan(m,5.0)" in plan
    assert "ReadSchema: struct<m:double>" in plan


def test_load_key(spark, rows):
    path = scratch_path(spark, "t")
    write_partitioned(rows, path, KEYS, "patch")
    key = {"filter": "HSC-I", "tract": 9002}
    assert load_key(spark, path, key, ["m"], True).count() == 100
    empty = load_key(spark, path, key | {"tract": 1})
    assert empty.isEmpty() and "m" in empty.columns
    with pytest.raises(NoDataError):
        load_key(spark, path, key | {"tract": 1}, raise_exception=True)


def test_bucketed_table_joins_without_exchange(spark, rows):
    save_bucketed_table(rows, "bucketed_catalogue", ["filter"], "tract", 4)
    try:
        table = spark.table("bucketed_catalogue")
        assert same(rows, table)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
        joined = table.alias("a").join(table.alias("b"), "tract")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql("drop table bucketed_catalogue")


def test_stats_are_computed_once(spark, rows):
    path = scratch_path(spark, "stats")
    calls = []

    def compute():
        calls.append(1)
        return rows.groupBy("filter").count()

    assert load_stats(spark, path, compute).count() == 3
    assert load_stats(spark, path, compute, ["count"]).columns == ["count"]
    assert calls == [1]


def test_files_get_the_keys_of_the_manifest(spark, rows):
    root = scratch_path(spark, "raw")
    for f, t in (("HSC-R", 9000), ("HSC-I", 9001)):
        rows.where((F.col("filter") == f) & (F.col("tract") == t)).select("patch", "m").write.parquet(f"{root}/{f}-{t}")
    rows.select("patch", "m").write.parquet(f"{root}/unlisted")
    folders = spark.createDataFrame([(f"{root}/HSC-R-9000", "HSC-R", 9000), (f"file:{root}/HSC-I-9001/", "HSC-I", 9001)], "path string, filter string, tract int")
    want = rows.where("(filter = 'HSC-R' and tract = 9000) or (filter = 'HSC-I' and tract = 9001)")
    assert same(want, read_with_keys(spark, folders, KEYS))
    assert same(want, read_with_keys(spark, folders, KEYS, root=root))
    files = list_files(spark, root, "*.parquet").withColumn("k", F.regexp_extract("path", r"/(HSC-.)-(\d+)/", 0))
    files = files.where("k != ''").select(
        "path", F.regexp_extract("path", r"/(HSC-.)-", 1).alias("filter"), F.regexp_extract("path", r"-(\d+)/", 1).cast("int").alias("tract")
    )
    assert same(want, read_with_keys(spark, files, KEYS, ["patch", "m"]))


def test_skymap_rows_are_numbered(spark, tmp_path):
    lines = ["x0,x1,y0,y1"] + [f"{i},{i + 1},0,{i}.5" for i in range(500)]
    path = tmp_path / "skymap.csv"
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        boxes = read_skymap_csv(spark, str(path))
        assert boxes.rdd.getNumPartitions() > 1
        assert sorted((r.tract, r.x0, r.y1) for r in boxes.collect()) == [(i, float(i), i + 0.5) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_geojson_document(spark, tmp_path):
    ring = [[1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [1.0, 0.0]]
    features = [
        {"type": "Feature", "properties": {"tract": t, "name": "t"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        for t in (5, 6)
    ]
    path = tmp_path / "map.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = read_geojson(spark, str(path), {"tract": "int"}).orderBy("tract").collect()
    assert [r.tract for r in got] == [5, 6] and [(p.x, p.y) for p in got[0].ring] == [tuple(p) for p in ring]


def test_new_files_are_appended_once(spark, rows):
    landing, target, checkpoint = (scratch_path(spark, n) for n in ("landing", "target", "progress"))

    def load():
        prepare = lambda df: df.withColumn("twice", F.col("m") * 2)
        append_new_files(spark, landing, rows.schema, target, checkpoint, KEYS, "patch", prepare, max_files=1).awaitTermination()
        return spark.read.parquet(target)

    rows.where("filter = 'HSC-R'").write.mode("append").parquet(landing)
    assert load().count() == 400
    rows.where("filter != 'HSC-R'").write.mode("append").parquet(landing)
    assert same(rows, load())
    assert load().where("twice = m * 2").count() == 1000


def test_keys(spark):
    metadata = spark.createDataFrame([({"r": {1: [10, 11], 2: [12]}, "g": {1: [20]}},)], "visits map<string, map<int, array<int>>>")
    keys = enumerate_keys(metadata)
    assert sorted(tuple(r) for r in keys.collect()) == [("g", 1, 20), ("r", 1, 10), ("r", 1, 11), ("r", 2, 12)]
    assert enumerate_keys(metadata, visit_name=None).count() == 3
    assert existing_keys(keys, spark.createDataFrame([("r", 1)], "filter string, tract int"), KEYS).count() == 2
    assert [tuple(r) for r in distinct_keys(keys, ["filter"]).collect()] == [("g",), ("r",)]
    chunks = key_chunks(keys, "filter", 2).groupBy("filter", "chunk").count()
    assert {(r.filter, r.chunk): r["count"] for r in chunks.collect()} == {("g", 0): 1, ("r", 0): 2, ("r", 1): 1}
    lists = keys_by_chunk(keys, "filter", "visit", 2).collect()
    assert all(len(r.visits) <= 2 for r in lists)


def test_keys_from_paths(spark):
    paths = [("/d/plots/HSC-R/tract-9615/v-1.png",), ("/d/plots/HSC-I/x/tract-9697",), ("/d/other/HSC-Z/tract-9697.fits",), ("/d/plots/tractor",)]
    df = spark.createDataFrame(paths, "path string")
    assert sorted(r.tract for r in tracts_from_paths(df).collect()) == [9615, 9697]
    assert sorted(r.filter for r in filters_from_paths(df).collect()) == ["HSC-I", "HSC-R"]


def test_tract_choice(spark):
    present = spark.createDataFrame([(1,), (2,), (2,)], "tract int")
    for asked, want in (([2, 5], [2]), ([7], [1, 2]), ([], [1, 2])):
        wanted = spark.createDataFrame([(t,) for t in asked], "tract int")
        assert sorted(r.tract for r in valid_tracts(wanted, present).collect()) == want
    typed = spark.createDataFrame([("a", "1, 2,,x, 2"), ("b", "9"), ("c", "")], "who string, selection string")
    got = selection_keys(typed, present, keep=["who"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("a", 2)]


def test_null_keys_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, w int")
    assert [tuple(r) for r in join_on(a, b, ["k"]).collect()] == [(None, 1, 3)]
    assert [tuple(r) for r in join_on(a, b, ["k"], "left_anti").collect()] == [("x", 2)]


def test_broadcast_is_checked(spark):
    def hinted(df, limit):
        return "broadcast" in df.join(broadcast_if_small(df, limit), "id")._jdf.queryExecution().logical().toString().lower()

    df = spark.range(100)
    assert hinted(df, 100) and not hinted(df, 99)
    wide = df.withColumn("text", F.repeat(F.lit("x"), 1000))
    for size, want in ((200_000, True), (50_000, False)):
        plan = broadcast_if_small(wide, 100, size)._jdf.queryExecution().logical().toString().lower()
        assert ("broadcast" in plan) == want


def test_shared_folder_is_the_session_s(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert folder is None or shared_dir(spark) == folder.rstrip("/")


def test_write_stats_replaces(spark, rows):
    path = scratch_path(spark, "stats")
    write_stats(rows.limit(5), path)
    write_stats(rows.limit(2), path)
    assert spark.read.parquet(path).count() == 2


def test_polygons_of_several_parts_and_positions(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    shapes = [("Polygon", square), ("MultiPolygon", [square, [[[5, 5], [6, 5], [5, 5]]]]), ("Point", [1, 2])]
    features = [{"type": "Feature", "properties": {"n": k}, "geometry": {"type": k, "coordinates": c}} for k, c in shapes]
    features.append({"type": "Feature", "properties": {"n": "none"}, "geometry": None})
    path = tmp_path / "shapes.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = readers.read_geojson(spark, str(path), {"n": "string"}).orderBy("feature", "part").collect()
    assert [(r.n, r.feature, r.part, r.ring and len(r.ring)) for r in got] == [
        ("Polygon", 0, 0, 4), ("MultiPolygon", 1, 0, 4), ("MultiPolygon", 1, 1, 3), ("Point", 2, 0, None), ("none", 3, 0, None)
    ]
    assert (got[2].ring[1].x, got[2].ring[1].y) == (6.0, 5.0)
    assert readers.read_geojson(spark, str(path), {}).columns == ["feature", "part", "ring"]


def test_half_written_statistics_are_made_anew(spark, tmp_path):
    path = str(tmp_path / "stats")
    layout.load_stats(spark, path, lambda: spark.range(3))
    assert layout.load_stats(spark, path, lambda: spark.range(9)).count() == 3
    (tmp_path / "stats" / "_SUCCESS").unlink()
    assert layout.load_stats(spark, path, lambda: spark.range(9)).count() == 9


def test_numbered_boxes_need_one_file(spark, tmp_path):
    path = str(tmp_path / "boxes")
    spark.range(4).selectExpr("id + 0.5 as x0").repartition(2).write.option("header", "true").csv(path)
    with pytest.raises(ValueError, match="several files"):
        readers.read_skymap_csv(spark, path)
