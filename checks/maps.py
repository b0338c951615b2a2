"""Rasters and tract maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.catalogue import KEYS, METRICS, boxes, catalogue, plain_r, r, rounded, strips, table, with_ctes
from checks.registry import check
from checks.statistics import STATE, STATE_SQL
from skyqa.functions.clean import named
from skyqa.functions.frames import scratch_path
from skyqa.operators.raster import (
    Axis,
    adaptive_points,
    raster_layers,
    scatter_density,
    scatter_density_multi,
    sky_raster,
    sky_raster_multi,
)
from skyqa.operators.polygons import points_in_polygons
from skyqa.operators.tracts import (
    map_extent,
    points_in_tracts,
    polygons_of,
    skymap_right_join,
    tract_map,
    tract_polygons,
    tracts_at,
)
from skyqa.sources.readers import read_geojson
from skyqa.sources.pyramid import Grid, open_pyramid, read_view, view_of, write_pyramid

BINS = 64
RA, DEC = Axis("ra", BINS), Axis("dec", BINS)
MAG, FLUX = Axis("metric_a", 32), Axis("flux", 32)


def bin_sql(c: str, n: int, lo: str | None = None, hi: str | None = None) -> str:
    lo = lo or f'(select min("{c}") from nrm)'
    hi = hi or f'(select max("{c}") from nrm)'
    return f'least(floor(("{c}" - {lo}) / ({hi} - {lo}) * {n})::int, {n - 1})'


IX, IY = bin_sql("ra", BINS), bin_sql("dec", BINS)


def raster_sql(value: str, where: str) -> str:
    return with_ctes(
        f"select {IX} as ix, {IY} as iy, count(*) as n, {value} as value from nrm where {where} group by 1, 2", "nrm"
    )


@check("sky_raster", raster_sql(plain_r('avg(flux)'), STATE_SQL))
def _(spark, sf):
    return rounded(sky_raster(catalogue(spark, sf), "flux", "mean", RA, DEC, STATE))


@check("sky_raster_std", raster_sql(plain_r("stddev_pop(metric_a)"), "true"))
def _(spark, sf):
    return rounded(sky_raster(catalogue(spark, sf), "metric_a", "std", RA, DEC))


@check("sky_raster_count", raster_sql("count(*)", "true"))
def _(spark, sf):
    return sky_raster(catalogue(spark, sf), None, "count", RA, DEC)


@check(
    "scatter_density",
    with_ctes(
        f"""select 'scatter' as layer, {bin_sql('metric_a', 32)} as ix, {bin_sql('flux', 32)} as iy, count(*) as n,
        cast(null as double) as value from nrm where {STATE_SQL} group by 2, 3
        union all select 'sky', {IX}, {IY}, count(*), {plain_r('avg(flux)')} from nrm where {STATE_SQL} group by 2, 3""",
        "nrm",
    ),
)
def _(spark, sf):
    return rounded(scatter_density(catalogue(spark, sf), MAG, FLUX, RA, DEC, STATE))


@check(
    "scatter_density_multi",
    with_ctes(
        " union all ".join(
            f"""select '{m}' as metric, 'scatter' as layer, {bin_sql('flux', 32)} as ix, {bin_sql(m, 16)} as iy,
            count(*) as n, cast(null as double) as value from nrm where {m} is not null and {STATE_SQL} group by 3, 4
            union all select '{m}', 'sky', {IX}, {IY}, count(*), {plain_r(f'avg({m})')}
            from nrm where {STATE_SQL} group by 3, 4"""
            for m in METRICS
        ),
        "nrm",
    ),
)
def _(spark, sf):
    values = [Axis(m, 16) for m in METRICS]
    return rounded(scatter_density_multi(catalogue(spark, sf), FLUX, values, RA, DEC, STATE))


@check(
    "raster_layers",
    with_ctes(
        f"""select {bin_sql('metric_a', 32)} as ix, {bin_sql('flux', 32)} as iy, count(*) as n_all,
        count(*) filter (where {STATE_SQL}) as n_selected from nrm group by 1, 2""",
        "nrm",
    ),
)
def _(spark, sf):
    return raster_layers(catalogue(spark, sf), MAG, FLUX, STATE)


@check(
    "sky_raster_multi",
    with_ctes(
        " union all ".join(
            f"""select '{m}' as metric, {IX} as ix, {IY} as iy, {r(f'avg({m})', 'value')} from nrm
            where {m} is not null group by 2, 3"""
            for m in ("flux", "metric_a", "metric_b")
        ),
        "nrm",
    ),
)
def _(spark, sf):
    return rounded(sky_raster_multi(catalogue(spark, sf), ["flux", "metric_a", "metric_b"], RA, DEC))


@check(
    "raster_viewport",
    with_ctes(
        f"""select {bin_sql('ra', 40, '1e2', '1.5e2')} as ix, {bin_sql('dec', 40, '-3e1', '3e1')} as iy,
        count(*) as n, {r('avg(metric_a)', 'value')} from nrm
        where ra between 1e2 and 1.5e2 and "dec" between -3e1 and 3e1 group by 1, 2""",
        "nrm",
    ),
)
def _(spark, sf):
    x, y = Axis("ra", 40, 100.0, 150.0), Axis("dec", 40, -30.0, 30.0)
    return rounded(sky_raster(catalogue(spark, sf), "metric_a", "mean", x, y))


@check(
    "raster_viewport_open",
    with_ctes(
        f"""select {bin_sql('ra', 40, '1e2', '1.5e2')} as ix, {bin_sql('dec', 40)} as iy,
        count(*) as n, {r('avg(metric_a)', 'value')} from nrm where ra between 1e2 and 1.5e2 group by 1, 2""",
        "nrm",
    ),
)
def _(spark, sf):
    # a limit that is not finite is ignored, so dec keeps the extent of the table
    x, y = Axis("ra", 40, 100.0, 150.0), Axis("dec", 40, float("nan"), 30.0)
    return rounded(sky_raster(catalogue(spark, sf), "metric_a", "mean", x, y))


@check(
    "adaptive_points",
    with_ctes(f"""select {r('ra', 'x')}, {r('dec', 'y')}, cast(1 as bigint) as n, {r('flux', 'value')} from nrm""", "nrm"),
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    return rounded(adaptive_points(cat, "flux", x=RA, y=DEC, points=True))


def _centre(c: str, index: str) -> str:
    return (
        f'(select min("{c}") from nrm) + ({index} + 0.5e0) * ((select max("{c}") from nrm) - '
        f'(select min("{c}") from nrm)) / {BINS}'
    )


@check(
    "adaptive_raster",
    with_ctes(
        f"""select {r(_centre('ra', 'ix'), 'x')}, {r(_centre('dec', 'iy'), 'y')}, n, value from (
        select {IX} as ix, {IY} as iy, count(*) as n, {plain_r('avg(flux)')} as value from nrm group by 1, 2) t""",
        "nrm",
    ),
)
def _(spark, sf):
    return rounded(adaptive_points(catalogue(spark, sf), "flux", x=RA, y=DEC, points=False))


# tract metrics and the sky map

_METRICS_SQL = "select band, tract, avg(metric_a) as metric_a, avg(flux) as flux from nrm group by band, tract"
_BOX = ", ".join(r(c) for c in ("x0", "x1", "y0", "y1"))
_MAP_SQL = (
    "select m.tract as tract, m.flux as metric, x0, x1, y0, y1 from m left join boxes on m.tract = boxes.tract "
    "where band = 'R'"
)


def tract_metrics(spark, sf):
    means = [F.avg("metric_a").alias("metric_a"), F.avg("flux").alias("flux")]
    return catalogue(spark, sf).groupBy(*KEYS).agg(*means)


@check("tract_map", with_ctes(f"select tract, {r('metric')}, {_BOX} from ({_MAP_SQL}) t", "nrm", "boxes", m=_METRICS_SQL))
def _(spark, sf):
    return rounded(tract_map(tract_metrics(spark, sf), boxes(spark, sf), "R", "flux", filter_name="band"))


@check(
    "tract_map_extent",
    with_ctes(
        f"""select {r('min(x0) - 5e-1', 'xmin')}, {r('max(x1) + 5e-1', 'xmax')}, {r('min(y0) - 5e-1', 'ymin')},
        {r('max(y1) + 5e-1', 'ymax')} from ({_MAP_SQL}) t""",
        "nrm",
        "boxes",
        m=_METRICS_SQL,
    ),
)
def _(spark, sf):
    shown = tract_map(tract_metrics(spark, sf), boxes(spark, sf), "R", "flux", filter_name="band")
    return rounded(map_extent(shown, 0.5))


@check(
    "tract_polygons",
    with_ctes(
        " union all ".join(
            f"select tract, {r('metric')}, {i} as corner, {r(x, 'x')}, {r(y, 'y')} from ({_MAP_SQL}) t where x0 is not null"
            for i, (x, y) in enumerate((("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"), ("x1", "y0")))
        ),
        "nrm",
        "boxes",
        m=_METRICS_SQL,
    ),
)
def _(spark, sf):
    shown = tract_map(tract_metrics(spark, sf), boxes(spark, sf), "R", "flux", filter_name="band")
    rings = tract_polygons(shown).select("tract", "metric", F.posexplode("ring").alias("corner", "p"))
    return rounded(rings.select("tract", "metric", "corner", "p.x", "p.y"))


@check(
    "skymap_right_join",
    with_ctes(
        f"select m.tract as tract, band, {r('metric_a')}, {r('flux')}, {_BOX} from boxes right join m on m.tract = boxes.tract",
        "nrm",
        "boxes",
        m=_METRICS_SQL,
    ),
)
def _(spark, sf):
    return rounded(skymap_right_join(boxes(spark, sf), tract_metrics(spark, sf)))


def _points(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.expr("(c_custkey * 7919 % 3600000) / 1e4").alias("ra"),
        F.expr("(c_custkey * 104729 % 1600000) / 1e4 - 8e1").alias("dec"),
    )


_POINTS = """select c_custkey, (c_custkey * 7919 % 3600000) / 1e4 as ra,
        (c_custkey * 104729 % 1600000) / 1e4 - 8e1 as "dec" from customer"""
# boxes of three sizes, those near RA 360 reach over it
_ROUND = """select cast(s_suppkey as int) as tract, (s_suppkey * 7919 % 3600) / 1e1 as x0,
        case when (s_suppkey * 7919 % 3600) / 1e1 + 4e1 / (1 + s_suppkey % 3) > 36e1
        then (s_suppkey * 7919 % 3600) / 1e1 + 4e1 / (1 + s_suppkey % 3) - 36e1
        else (s_suppkey * 7919 % 3600) / 1e1 + 4e1 / (1 + s_suppkey % 3) end as x1,
        (s_suppkey * 104729 % 1500) / 1e1 - 8e1 as y0,
        (s_suppkey * 104729 % 1500) / 1e1 - 8e1 + 1e1 / (1 + s_suppkey % 3) as y1 from supplier"""
_IN_ROUND = """from points join boxes on (case when x0 < x1 then ra >= x0 and ra < x1 else ra >= x0 or ra < x1 end)
    and "dec" >= y0 and "dec" < y1"""


def _round(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier_boxes")
    return spark.sql(_ROUND.replace("from supplier", "from supplier_boxes"))


@check("points_in_tracts_wrap", with_ctes(f"select c_custkey, tract {_IN_ROUND}", points=_POINTS, boxes=_ROUND))
def _(spark, sf):
    return points_in_tracts(_points(spark, sf), _round(spark, sf)).select("c_custkey", named("tract"))


@check("tracts_at", with_ctes(f"select distinct tract {_IN_ROUND}", points=_POINTS, boxes=_ROUND))
def _(spark, sf):
    return tracts_at(_points(spark, sf), _round(spark, sf), "ra", "dec")


@check(
    "polygons_of",
    with_ctes(f"select tract, x0, x1 from boxes where tract in (select tract {_IN_ROUND})", points=_POINTS, boxes=_ROUND),
)
def _(spark, sf):
    polygons = _round(spark, sf)
    return polygons_of(tracts_at(_points(spark, sf), polygons, "ra", "dec"), polygons.select("tract", "x0", "x1"))


@check(
    "points_in_tracts",
    with_ctes(
        """select c_custkey, tract from points join strips
        on ra >= x0 and ra < x1 and "dec" >= y0 and "dec" < y1""",
        "strips",
        points="""select c_custkey, (c_custkey * 7919 % 3600000) / 1e4 as ra,
        (c_custkey * 104729 % 1600000) / 1e4 - 8e1 as "dec" from customer""",
    ),
)
def _(spark, sf):
    points = table(spark, sf, "customer").select(
        "c_custkey",
        F.expr("(c_custkey * 7919 % 3600000) / 1e4").alias("ra"),
        F.expr("(c_custkey * 104729 % 1600000) / 1e4 - 8e1").alias("dec"),
    )
    return points_in_tracts(points, strips(spark, sf)).select("c_custkey", named("tract"))


# three viewports of one stored pyramid: the whole sky, a part of it on the finest level, and one whose limits lie inside bins
_GRID = Grid("ra", "dec", (0.0, 360.0), (-90.0, 90.0), levels=7, tile_levels=4, by=("band",))
_VIEWS = {
    "all": ((0.0, 360.0), (-90.0, 90.0), 32, "flux", "mean"),
    "part": ((90.0, 180.0), (-45.0, 0.0), 32, "metric_b", "std"),
    "odd": ((100.0, 301.0), (-50.0, 33.0), 40, None, "count"),
}


def _view_sql(name: str) -> str:
    x, y, most, value, aggregator = _VIEWS[name]
    view = view_of(_GRID, x, y, most)
    n = 1 << view.level
    (x0, x1), (y0, y1) = view.x_bins, view.y_bins
    made = {"mean": f"avg({value})", "std": f"stddev_pop({value})", "count": "count(*)::double"}[aggregator]
    ix, iy = (f"least(floor(({c} - {lo}) / {span} * {n})::int, {n - 1})" for c, lo, span in (("ra", "0e0", "3.6e2"), ("dec", "-9e1", "1.8e2")))
    return f"""select '{name}' as view, band, ix - {x0} as ix, iy - {y0} as iy, count(*) as n, {plain_r(made)} as value
        from (select *, {ix} as ix, {iy} as iy from nrm) t where ix >= {x0} and ix < {x1} and iy >= {y0} and iy < {y1} group by all"""


@check("raster_pyramid", with_ctes(" union all ".join(map(_view_sql, _VIEWS)), "nrm"))
def _(spark, sf):
    path = scratch_path(spark, "pyramid")
    write_pyramid(catalogue(spark, sf), path, _GRID, ["flux", "metric_b"])
    grid = open_pyramid(spark, path)
    views = [
        read_view(spark, path, grid, view_of(grid, x, y, most), value, aggregator).select(
            F.lit(name).alias("view"), "band", "ix", "iy", "n", F.col("value").cast("double").alias("value")
        )
        for name, (x, y, most, value, aggregator) in _VIEWS.items()
    ]
    return rounded(reduce(lambda a, b: a.unionByName(b), views))


# a concave outline with a hole for each supplier, some of them across RA 0, written and read as GeoJSON
_OUTLINE = [(0, 0), (20, 0), (20, 12), (14, 4), (8, 12), (3, 5)]
_HOLE = [(8, 2), (9, 5), (6, 3)]


def _corner(p: tuple[int, int]) -> tuple[str, str]:
    # off the raster of the given positions, whose last bits differ between engines
    return f"(s_suppkey * 7919 % 3600) / 1e1 + {p[0] + 3.21e-5}", f"(s_suppkey * 104729 % 1400) / 1e1 - 8e1 + {p[1] + 3.21e-5}"


def _crossings_sql(x: str) -> str:
    edges = [(a, b) for ring in (_OUTLINE, _HOLE) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a[1] != b[1]]
    parts = []
    for a, b in edges:
        (x0, y0), (x1, y1) = _corner(a), _corner(b)
        parts.append(f"((({y0}) <= dec) <> (({y1}) <= dec) and {x} < ({x0}) + (dec - ({y0})) * (({x1}) - ({x0})) / (({y1}) - ({y0})))::int")
    return " + ".join(parts)


@check(
    "points_in_polygons",
    with_ctes(
        f"""select polygon, band, count(*) as n, {plain_r('sum(flux)', 2)} as flux from (
          select cast(s_suppkey as int) as polygon, band, flux from nrm, supplier where ({_crossings_sql('ra')}) % 2 = 1
          union all select cast(s_suppkey as int), band, flux from nrm, supplier where ({_crossings_sql('(ra + 3.6e2)')}) % 2 = 1) t
        group by polygon, band""",
        "nrm",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "outlines")

    def ring(points):
        pairs = [_corner(p) for p in [*points, points[0]]]
        return F.array(*[F.array(F.expr(f"({x}) % 360"), F.expr(y)) for x, y in pairs])

    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.expr("cast(s_suppkey as int)").alias("polygon")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring(_OUTLINE), ring(_HOLE)).alias("coordinates")).alias("geometry"),
    )
    collections = table(spark, sf, "supplier").groupBy(F.expr("s_suppkey div 50")).agg(F.collect_list(feature).alias("features"))
    collections.select(F.lit("FeatureCollection").alias("type"), "features").write.json(path)
    outlines = read_geojson(spark, path, {"polygon": "int"}, one_document=False, holes=True).drop("feature", "part")
    found = points_in_polygons(catalogue(spark, sf), outlines, by=["band"], sums=["flux"])
    return rounded(found.groupBy("polygon", "band").agg(F.sum("n").alias("n"), F.sum("flux").alias("flux")), 2)
