"""Keys, written layouts and file formats. Written tables go to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalogue import (
    KEYS,
    VALUES,
    VISIT_KEYS,
    boxes,
    catalogue,
    first_cat,
    r,
    rounded,
    second_cat,
    table,
    with_ctes,
)
from checks.registry import SQL, check
from checks.statistics import _others, describe_sql
from skyqa.functions.frames import scratch_path
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
from skyqa.operators.stats import describe_by_key
from skyqa.sources.changes import update_stats
from skyqa.sources.footers import stored_count, stored_extent, stored_keys
from skyqa.sources.layout import (
    join_buckets,
    load_stats,
    save_bucketed_table,
    write_along_curve,
    write_incremental,
    write_partitioned,
    write_stats,
    write_tables,
)
from skyqa.sources.readers import list_files, load_keys, read_box, read_geojson, read_skymap_csv, read_with_keys

LAYOUT = ["band", "visit"]


@check("distinct_keys", with_ctes("select distinct band, tract from nrm", "nrm"))
def _(spark, sf):
    return distinct_keys(catalogue(spark, sf), KEYS)


def _metadata(spark, sf):
    """``map<band, map<tract, array<visit>>>``, one row per tract."""
    visits = catalogue(spark, sf).groupBy(*KEYS).agg(F.collect_set("visit").alias("visits"))
    by_band = F.map_from_entries(F.collect_list(F.struct("band", F.create_map("tract", "visits"))))
    return visits.groupBy("tract").agg(by_band.alias("visits"))


@check("enumerate_keys", with_ctes("select distinct band, tract, visit from nrm", "nrm"))
def _(spark, sf):
    return enumerate_keys(_metadata(spark, sf), filter_name="band")


@check("enumerate_keys_coadd", with_ctes("select distinct band, tract from nrm", "nrm"))
def _(spark, sf):
    return enumerate_keys(_metadata(spark, sf), filter_name="band", visit_name=None)


@check(
    "existing_keys",
    """select band, tract from (select distinct l_returnflag as band, cast(s_suppkey as int) as tract from lineitem, supplier) k
    where (band, tract) in (select l_returnflag, l_suppkey from lineitem where l_quantity > 45 and l_linenumber = 1)""",
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    available = cat.where((F.col("metric_a") > 45) & (F.col("visit") == 1))
    return existing_keys(cat.select(*KEYS).distinct(), available, KEYS)


@check(
    "key_chunks",
    with_ctes(
        """select band, tract, cast((row_number() over (partition by band order by tract) - 1)
        % greatest(1, ceil(count(*) over (partition by band) / 20e0)::int) as int) as chunk
        from (select distinct band, tract from nrm) k""",
        "nrm",
    ),
)
def _(spark, sf):
    return key_chunks(catalogue(spark, sf).select(*KEYS).distinct(), "band", 20)


_PATHS = "select '/data/plots/' || band || '/tract-' || cast(tract as varchar) || '/visit-' || cast(visit as varchar) || '.png' as path from nrm"


@check(
    "keys_from_paths",
    with_ctes(
        """select 'tract' as kind, cast(tract as varchar) as key from (select distinct tract from nrm) t
        union all select 'filter', band from (select distinct band from nrm) b""",
        "nrm",
    ),
)
def _(spark, sf):
    path = F.concat(F.lit("/data/plots/"), "band", F.lit("/tract-"), "tract", F.lit("/visit-"), "visit", F.lit(".png"))
    paths = catalogue(spark, sf).select(path.alias("path"))
    tracts = tracts_from_paths(paths).select(F.lit("tract").alias("kind"), F.col("tract").cast("string").alias("key"))
    return tracts.unionByName(filters_from_paths(paths).select(F.lit("filter").alias("kind"), F.col("filter").alias("key")))


@check(
    "valid_tracts",
    with_ctes(
        "select distinct tract from nrm where tract in (select c_custkey from customer where c_acctbal > 5e3)", "nrm"
    ),
)
def _(spark, sf):
    wanted = table(spark, sf, "customer").where("c_acctbal > 5e3").select(F.col("c_custkey").cast("int").alias("tract"))
    return valid_tracts(wanted, catalogue(spark, sf))


@check("valid_tracts_none", with_ctes("select distinct tract from nrm", "nrm"))
def _(spark, sf):
    wanted = table(spark, sf, "customer").select((-1 - F.col("c_custkey")).cast("int").alias("tract"))
    return valid_tracts(wanted, catalogue(spark, sf))


@check(
    "selection_keys",
    """select distinct o_orderkey, cast(k as int) as tract from (
      select o_orderkey, unnest([o_orderkey % 60, o_custkey % 60, o_orderkey % 7]) as k from orders) t
    where k in (select s_suppkey from supplier where s_acctbal > 0)""",
)
def _(spark, sf):
    text = F.concat_ws(
        ",",
        (F.col("o_orderkey") % 60).cast("string"),
        F.concat(F.lit(" "), (F.col("o_custkey") % 60).cast("string")),
        F.lit(""),
        F.lit("abc"),
        (F.col("o_orderkey") % 7).cast("string"),
    )
    saved = table(spark, sf, "orders").select("o_orderkey", text.alias("selection"))
    active = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("int").alias("tract"))
    return selection_keys(saved, active, keep=["o_orderkey"])


# written and read back

# every row with all its values, as the table has repeated rows with their number
_ALL = ["band", "tract", "visit", "patch", "ra", "dec", "psfMag", "flux", "metric_a", "metric_b", "flag_used", "flag_bad"]
_PLAIN = ", ".join(r(c) if c in ("ra", "dec", "psfMag", "flux", "metric_a", "metric_b") else f'"{c}"' for c in _ALL)
_ROWS = with_ctes(f"select *, count(*) as n from (select {_PLAIN} from nrm) t group by all", "nrm")


def _rows(df):
    return rounded(df.select(*_ALL)).groupBy(*_ALL).agg(F.count(F.lit(1)).alias("n"))


@check("partition_roundtrip", _ROWS)
def _(spark, sf):
    path = scratch_path(spark, "partitioned")
    cat = catalogue(spark, sf)
    # the second write replaces the partitions of the first
    write_partitioned(cat, path, LAYOUT, "patch")
    write_partitioned(cat.where("band = 'A'"), path, LAYOUT, "patch")
    return _rows(spark.read.parquet(path))


@check("partition_incremental", _ROWS)
def _(spark, sf):
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "incremental")
    write_tables(catalogue(spark, sf), landed, LAYOUT)
    write_incremental(spark.read.parquet(landed), path, LAYOUT, "patch", chunk_keys=4)
    return _rows(spark.read.parquet(path))


@check("write_tables", _ROWS)
def _(spark, sf):
    path = scratch_path(spark, "tables")
    write_tables(catalogue(spark, sf), path, LAYOUT)
    return _rows(spark.read.parquet(path))


@check("read_with_keys", _ROWS)
def _(spark, sf):
    path = scratch_path(spark, "files")
    write_tables(catalogue(spark, sf), path, LAYOUT)
    # the keys come from a manifest, as they do for raw files whose rows lack them
    manifest = list_files(spark, path, "*.parquet").select(
        "path",
        F.regexp_extract("path", "/band=([^/]+)/", 1).alias("band"),
        F.regexp_extract("path", "/visit=([0-9]+)/", 1).cast("int").alias("visit"),
    )
    return _rows(read_with_keys(spark, manifest, LAYOUT, root=path))


# limits, counts and keys of a stored table, for which no column is read
@check("extent_stored", SQL["extent"])
def _(spark, sf):
    path = scratch_path(spark, "by-band")
    write_tables(catalogue(spark, sf), path, ["band"])
    return rounded(stored_extent(spark, path, ["ra", "dec", "flux", "metric_a"]))


@check(
    "counts_stored",
    with_ctes(
        """select count(*) as n, count(*) filter (where visit = 3) as n_visit, count(distinct (band, visit)) as n_keys from nrm""",
        "nrm",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "by-visit")
    write_tables(catalogue(spark, sf), path, LAYOUT)
    n, n_visit = stored_count(spark, path), stored_count(spark, path, {"visit": 3})
    keys = stored_keys(spark, path, LAYOUT).agg(F.count(F.lit(1)).alias("n_keys"))
    return keys.select(F.lit(n).cast("long").alias("n"), F.lit(n_visit).cast("long").alias("n_visit"), "n_keys")


_BOXES = (((30.0, 75.0), (-40.0, 10.0)), ((350.0, 12.0), (0.0, 60.0)))


@check(
    "boxes_along_curve",
    with_ctes(
        f"""select *, count(*) as n from (select {_PLAIN} from nrm where (ra >= 3e1 and ra < 7.5e1 and "dec" >= -4e1 and "dec" < 1e1)
        or ((ra >= 3.5e2 or ra < 1.2e1) and "dec" >= 0 and "dec" < 6e1)) t group by all""",
        "nrm",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "curve")
    write_along_curve(catalogue(spark, sf), path)
    first, second = (read_box(spark, path, x, y) for x, y in _BOXES)
    return _rows(first.unionByName(second))


# both catalogues stored by buckets of their id
@check(
    "join_on_buckets",
    with_ctes(
        f"""select a.id, {r('b.shape - a.shape', 'shape')}, {r('b."psfMag" - a."psfMag"', 'psfMag')}
        from first_cat a join second_cat b on a.id = b.id where a."detect_isPrimary" """,
        "first_cat",
        "second_cat",
    ),
)
def _(spark, sf):
    names = []
    for k, make in enumerate((first_cat, second_cat)):
        path = scratch_path(spark, "buckets")
        names.append(f"buckets_{path.rsplit('-', 1)[1]}")
        columns = {"shape": f"shape_{k}", "psfMag": f"psfMag_{k}", "detect_isPrimary": f"primary_{k}"}
        rows = make(spark, sf).select("id", *columns).withColumnsRenamed(columns)
        save_bucketed_table(rows, names[-1], [], "id", path=path)
    both = join_buckets(spark, *names, "id").where("primary_0")
    return rounded(both.select("id", F.expr("shape_1 - shape_0 as shape"), F.expr("psfMag_1 - psfMag_0 as psfMag")))


@check(
    "load_keys",
    with_ctes(
        f"select *, count(*) as n from (select {_PLAIN} from nrm where tract in (select s_suppkey from supplier where s_acctbal > 5e3)) t group by all",
        "nrm",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "by-tract")
    write_tables(catalogue(spark, sf), path, ["tract"])
    active = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("tract"), "s_acctbal").where("s_acctbal > 5e3")
    return _rows(load_keys(spark, path, active, ["tract"]))


@check(
    "keys_by_chunk",
    with_ctes(
        """select band, chunk, string_agg(cast(tract as varchar), ',' order by tract) as tracts from (
        select band, tract, cast((row_number() over (partition by band order by tract) - 1)
        % greatest(1, ceil(count(*) over (partition by band) / 20e0)::int) as int) as chunk
        from (select distinct band, tract from nrm) k) c group by band, chunk""",
        "nrm",
    ),
)
def _(spark, sf):
    lists = keys_by_chunk(catalogue(spark, sf).select(*KEYS).distinct(), "band", "tract", 20)
    return lists.withColumn("tracts", F.array_join(F.col("tracts").cast("array<string>"), ","))


# a table, one tract of it replaced and one removed: what is described again equals a description of everything
_CHANGED = with_ctes(
    f"select * from {describe_sql('now_nrm', ['tract'], ['flux', 'metric_a'], _others(['tract']), (0.5,))}",
    "nrm",
    now_nrm="""select band, tract, visit, patch, ra, "dec", "psfMag", flux + case when tract = 3 then 1e0 else 0e0 end as flux,
    metric_a, metric_b, flag_used, flag_bad from nrm where tract <> 5""",
)


@check("stats_of_changed_keys", _CHANGED)
def _(spark, sf):
    path, stats = scratch_path(spark, "by-tract"), scratch_path(spark, "stats")
    cat = catalogue(spark, sf)
    describe = lambda df: describe_by_key(df, ["tract"], ["flux", "metric_a"], (0.5,))
    write_tables(cat.where("tract <> 5"), path, ["tract"])
    update_stats(spark, path, stats, ["tract"], describe)
    write_tables(cat.where("tract = 3").withColumn("flux", F.col("flux") + 1), path, ["tract"])
    return rounded(update_stats(spark, path, stats, ["tract"], describe))


@check("stats_roundtrip", with_ctes(f"select * from {describe_sql('nrm', KEYS, VALUES, _others(KEYS))}", "nrm"))
def _(spark, sf):
    path = scratch_path(spark, "stats")
    load_stats(spark, path, lambda: describe_by_key(catalogue(spark, sf), KEYS, VALUES))
    # read, not computed again
    return rounded(load_stats(spark, path, lambda: catalogue(spark, sf)))


_BOX = ", ".join(r(c) for c in ("x0", "x1", "y0", "y1"))


@check("skymap_csv", with_ctes(f"select tract, {_BOX} from boxes", "boxes"))
def _(spark, sf):
    path = scratch_path(spark, "skymap")
    boxes(spark, sf).write.option("header", "true").csv(path)
    return rounded(read_skymap_csv(spark, path))


@check(
    "geojson_polygons",
    with_ctes(
        " union all ".join(
            f"select tract, {i} as corner, {r(x, 'x')}, {r(y, 'y')} from boxes"
            for i, (x, y) in enumerate((("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"), ("x1", "y0")))
        ),
        "boxes",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "geojson")
    ring = F.array(*[F.array(x, y) for x, y in (("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"), ("x1", "y0"))])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("tract").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    # one collection per fifty tracts, one collection per line
    collections = (
        boxes(spark, sf)
        .groupBy(F.expr("tract div 50"))
        .agg(F.collect_list(feature).alias("features"))
        .select(F.lit("FeatureCollection").alias("type"), "features")
    )
    collections.write.json(path)
    polygons = read_geojson(spark, path, {"tract": "int"}, one_document=False)
    rings = polygons.select("tract", F.posexplode("ring").alias("corner", "p"))
    return rounded(rings.select("tract", "corner", "p.x", "p.y"))


@check("stats_by_visit_written", with_ctes(f"select * from {describe_sql('nrm', VISIT_KEYS, ['flux'], _others(VISIT_KEYS), (0.5,))}", "nrm"))
def _(spark, sf):
    path = scratch_path(spark, "visit-stats")
    write_stats(describe_by_key(catalogue(spark, sf), VISIT_KEYS, ["flux"], (0.5,)), path)
    return rounded(spark.read.parquet(path))
