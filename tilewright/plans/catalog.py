"""Registered queries of the engine and the SQL that gives the same rows.

Fixture tiles are 8 x 8 with subtiles of 4 x 4; operators take both as parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.lineage import fresh_path
from tilewright.operators import evaluate as ev
from tilewright.operators import packed as pk
from tilewright.operators import raster as ra
from tilewright.operators import rings as ri
from tilewright.operators import sampling as sa
from tilewright.operators import score as sc
from tilewright.operators import stats as st
from tilewright.operators import vector as ve
from tilewright.plans.fixtures import oracle, view
from tilewright.sources import io
from tilewright.sources.tiff import read_raster

N, D, SUBS = 8, 4, 4
YEARS = (2017, 2018, 2019, 2020)
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _add(name: str, views: str, run: Callable[..., DataFrame], sql: str) -> None:
    """Register a query over fixture views, which ``run`` takes in their order, and its SQL."""
    _QUERIES[name] = lambda spark, d: run(*[view(spark, d, v) for v in views.split()])
    _SQL[name] = oracle(views, sql)


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- shares, areas, fractions --------------------------------------------------------------
def _share_sql(k2: int) -> str:
    return f"""
with s as (select p.yr, p.img, sum(case when cls = 1 and forest = 1 then 1 else 0 end) as a,
                  sum(case when cls = 2 and forest = 1 then {k2} else 0 end) as b, sum(forest) as f
           from pred_px p join lu_px l on p.img = l.img and p.y = l.y and p.x = l.x group by all)
select yr, img, case when f * 100.0 / 64 >= 10 then a * 100.0::double / f end as conifer,
       case when f * 100.0 / 64 >= 10 then b * 100.0::double / f end as broadleaf,
       case when f * 100.0 / 64 >= 10 then (a + b) * 100.0::double / f end as total from s"""


_add("forest_share", "pred_px lu_px", lambda p, f: st.forest_share(p, f, N * N), _share_sql(1))
_add("forest_share_compat", "pred_px lu_px", lambda p, f: st.forest_share(p, f, N * N, compat=True), _share_sql(2))
_add("class_counts", "pred_px", st.class_counts, """
select yr, img, count(*) filter (cls = 0) as cl_0, count(*) filter (cls = 1) as cl_1, count(*) filter (cls = 2) as cl_2, count(cls) as total
from pred_px group by yr, img""")  # fmt: skip
_AREA = "round_even(count(*) filter (yr = {y} and cls in (1, 2)) * 0.200022269188281::double * 0.200022454940277::double, 1)"
_add("area_by_year", "pred_px", lambda p: st.area_by_year(st.require_years(p, YEARS), YEARS), f"""
select img, nullif(count(*) filter (yr = 2017), 0) as total,
       {", ".join(f"case when count(*) filter (yr = {y}) > 0 then {_AREA.format(y=y)} end as deadarea_m2_{y}" for y in YEARS)}
from pred_px group by img""")  # fmt: skip
_add("pred_fraction", "pred_px", lambda p: st.pred_fraction(p, "sum"), "select yr, img, sum(cls)::double / count(*) as fraction from pred_px group by all")
_add("binary_fraction", "pred_px", st.pred_fraction, "select yr, img, avg(case when cls <> 0 then 1.0::double else 0 end) as fraction from pred_px group by all")
_QUERIES["usage"] = lambda spark, d: st.usage(spark.read.parquet(f"{d}/events.parquet"), "event_type", "user_id")
_SQL["usage"] = "select event_type, user_id, count(*) as uses from events group by all"

# --- band statistics --------------------------------------------------------------------------
_STATS = """
with ok as (select img from px group by img having max(y) = max(x) and not bool_and(v in (0, 255))),
s as (select img, band, (y // 4) * 2 + x // 4 as sub, avg(v / 255.0::double) as m, avg((v / 255.0::double) * (v / 255.0::double)) as q, min(v) < max(v) as varies
      from px where img in (select img from ok) group by all),
g as (select s.* from s join s b on s.img = b.img and s.sub = b.sub and b.band = 1 and b.varies),
z as (select band, sum(m) as s1, sum(q) as s2, count(*) as cnt, count(*) + {one} as w from g group by band),
r as (select band, s1 / w as mean, sqrt((s2 - 2 * (s1 / w) * s1 + cnt * (s1 / w) * (s1 / w)) / w) as std, cnt from z)
"""
_add("band_stats", "px", lambda p: st.band_stats(p, N, D), _STATS.format(one=0) + "select * from r")
_add("band_stats_compat", "px", lambda p: st.band_stats(p, N, D, compat=True), _STATS.format(one=1) + "select * from r")
_add("stats_report", "px", lambda p: st.stats_report(st.band_stats(p, N, D)).select(
    F.get_json_object("report", "$.subtiles").cast("long").alias("subtiles"), F.get_json_object("report", "$.results.1.mean").cast("double").alias("mean_1"),
    F.get_json_object("report", "$.results.4.std").cast("double").alias("std_4")),
    _STATS.format(one=0) + "select max(cnt) as subtiles, max(case when band = 1 then round(mean, 6) end) as mean_1, max(case when band = 4 then round(std, 6) end) as std_4 from r")

# --- filters and reshaping ----------------------------------------------------------------------
_SUB = "(y // 4) * 2 + x // 4"
_add("nodata_tiles", "px", lambda p: ra.nodata(p).join(ra.nodata(p, "all").withColumnRenamed("is_nodata", "all_nodata"), "img"), """
select img, bool_and(v in (0, 255)) filter (band = 1) as is_nodata, bool_and(v in (0, 255)) as all_nodata from px group by img""")
_add("drop_nodata", "px", ra.drop_nodata, "select * from px where img not in (select img from px where band = 1 group by img having bool_and(v in (0, 255)))")
_add("variation_subtiles", "px", lambda p: ra.variation(p, N, D), f"select img, {_SUB} as sub from px group by all having min(v) <> max(v)")
_add("variation_band1", "px", lambda p: ra.variation(p, N, D, [1]), f"select img, {_SUB} as sub from px where band = 1 group by all having min(v) <> max(v)")
_add("complete_tiles", "px", ra.complete_only, "select img from px group by img having max(y) = max(x)")
_GRID = "select cast(i // 8 as int) as y, cast(i % 8 as int) as x from range(64) r(i)"
_add("pad_tiles", "px", lambda p: ra.pad(p, N), f"""
with k as (select distinct img, band from px), g as ({_GRID})
select k.img, k.band, g.y, g.x, coalesce(p.v, 0) as v from k cross join g left join px p on p.img = k.img and p.band = k.band and p.y = g.y and p.x = g.x""")
_add("blocks", "px", lambda p: ra.blocks(p, N, D), f"select img, band, y % 4 as y, x % 4 as x, v, {_SUB} as sub from px")
_add("assemble", "px", lambda p: ra.assemble(ra.blocks(p, N, D), N, D), "select * from px")
_add("grid_of", "px", lambda p: ra.grid_of(p, (N, N), (D, D)), """
select img, max(y) + 1 as h, max(x) + 1 as w, cast(ceil((max(y) + 1) / 4) as int) as ny, cast(ceil((max(x) + 1) / 4) as int) as nx from px group by img""")
_add("needed", "px", lambda p: ra.needed(p, N, D), """
select g.img, cast(s.i as int) as sub from (select img, ceil((max(y) + 1) / 4) as ny, ceil((max(x) + 1) / 4) as nx from px group by img) g
join range(4) s(i) on s.i // 2 < g.ny and s.i % 2 < g.nx""")
_add("crop", "px", lambda p: ra.crop(ra.pad(p, N), ra.sizes(p)), "select * from px")


def _world(p: DataFrame) -> DataFrame:
    gy, gx = (F.floor(F.col("img") / 4) * N + F.col("y")).alias("gy"), ((F.col("img") % 4) * N + F.col("x")).alias("gx")
    return p.select(gy, gx, "band", "v")


_WORLD = "with w as (select (img // 4) * 8 + y as gy, (img % 4) * 8 + x as gx, band, v from px) "
_add("retile", "px", lambda p: ra.retile(_world(p), 5), _WORLD + """
select cast(gy // 5 as int) as row, cast(gx // 5 as int) as col, band, cast(gy % 5 as int) as y, cast(gx % 5 as int) as x, v from w""")
_add("mosaic", "px", lambda p: ra.mosaic(p.withColumns({"row": F.floor(F.col("img") / 4), "col": F.col("img") % 4}), 6, "img"), """
select (img // 4) * 6 + y as gy, (img % 4) * 6 + x as gx, band, arg_max(v, img) as v from px group by 1, 2, 3""")
_add("stack_bands", "px", lambda p: ra.stack_bands(p, p.where("band = 1 and img % 3 <> 0")), """
select img, band, y, x, v from px where band <= 3 and img % 3 <> 0 union all select img, 4, y, x, v from px where band = 1 and img % 3 <> 0""")
_add("clip_extent", "px", lambda p: ra.clip_extent(_world(p), 3, 5, 21, 30), _WORLD + "select * from w where gx between 3 and 20 and gy between 5 and 29")
_add("resample_avg", "px", lambda p: ra.resample_avg(_world(p), 2), _WORLD + """
select gy // 2 as gy, gx // 2 as gx, band, cast(round_even(avg(v), 0) as int) as v from w group by 1, 2, 3""")
_NORM = "(v / 255.0::double - case band when 1 then 0.485 when 2 then 0.456 when 3 then 0.406 else 0.485 end::double) / case band when 1 then 0.229 when 2 then 0.224 when 3 then 0.225 else 0.229 end::double"
_add("normalize", "px", ra.normalize, f"select img, band, y, x, {_NORM} as v from px")
_add("denormalize", "px", lambda p: ra.denormalize(ra.normalize(p)), "select * from px where band <= 3")
_add("collapse", "mask_px", lambda m: ra.collapse(m, 2), "select img, y, x, least(cls, 1) as cls from mask_px")
_add("select_bands", "px", lambda p: ra.select_bands(p, 3), "select * from px where band <= 3")
_add("flip_rot", "px", lambda p: ra.flip_rot(ra.pad(p, N).withColumns({"__f": F.when(F.col("img") % 2 == 0, "h").otherwise("v"), "__t": (F.col("img") % 4).cast("int")}), N), f"""
with k as (select distinct img, band from px), g as ({_GRID}),
a as (select k.img, k.band, g.y, g.x, coalesce(p.v, 0) as v from k cross join g left join px p on p.img = k.img and p.band = k.band and p.y = g.y and p.x = g.x),
f as (select img, band, case when img % 2 = 1 then 7 - y else y end as y, case when img % 2 = 0 then 7 - x else x end as x, v from a)
select img, band, case img % 4 when 1 then 7 - x when 2 then 7 - y when 3 then x else y end as y, case img % 4 when 1 then y when 2 then 7 - x when 3 then 7 - y else x end as x, v from f""")
_add("intensity", "px", lambda p: ra.intensity(p, F.when(F.col("img") % 2 == 0, 1.125).otherwise(0.875), F.when(F.col("img") % 3 == 0, 0.25).otherwise(-0.125)), """
with m as (select img, avg(v) as m from px group by img)
select p.img, p.band, p.y, p.x, cast(floor(greatest(0, least(255, v * case when p.img % 2 = 0 then 1.125::double else 0.875::double end + case when p.img % 3 = 0 then 0.25::double else -0.125::double end * m)) + 1e-9) as int) as v
from px p join m on p.img = m.img""")
_add("one_hot", "mask_px", lambda m: ra.one_hot(m, 3), "select m.img, m.y, m.x, cast(k.i as int) as k, cast(m.cls = k.i as int) as hot from mask_px m, range(3) k(i)")
_add("argmax", "eval_px", lambda e: e.groupBy(ra.argmax(F.array("p0", "p1", "p2")).alias("cls")).agg(F.count("*").alias("n")), """
select cast(case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as int) as cls, count(*) as n from eval_px group by 1""")
_DIST = """
with h as (select m.img, m.y, m.x, cast(k.i as int) as k, m.cls = k.i as hot from mask_px m, range(3) k(i)),
d as (select a.img, a.k, a.y, a.x, a.hot, bool_or(b.hot) as present, min(case when b.hot <> a.hot then (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) end) as s
      from h a join h b on a.img = b.img and a.k = b.k group by all),
z as (select img, k, y, x, case when not present then 0 when hot then 1 - sqrt(s) else sqrt(s) end as dist from d)
"""


def _distances(m: DataFrame) -> DataFrame:
    return pk.distance_rows(sc.pack_tiles(m, N, "cls"), 3)


_add("distance_map", "mask_px", _distances, _DIST + "select * from z")
_add("boundary", "mask_px", lambda m: ev.boundary(ra.one_hot(m, 3).select("img", "k", "y", "x", (F.lit(0.2) + 0.5 * F.col("hot")).alias("prob")), _distances(m)), _DIST + """
select avg((0.2 + 0.5 * cast(m.cls = z.k as int))::double * z.dist) as boundary from z join mask_px m on m.img = z.img and m.y = z.y and m.x = z.x where z.k > 0""")
_add("preview", "mask_px", ra.preview, "select img, y, x, (cls * 255) % 256 as v from mask_px")
_FRAC = f"with f as (select img, {_SUB} as sub, count(*) filter (cls <> 0) as n_pos, round(count(*) filter (cls <> 0) * 100.0::double / 16, 2) as frac from mask_px group by 1, 2) "
_add("subtile_frac", "mask_px", lambda m: st.subtile_frac(m, N, D), _FRAC + "select * from f")
_add("positive_subtiles", "mask_px", lambda m: st.positive(st.subtile_frac(m, N, D)), _FRAC + "select * from f where n_pos > 0")
_add("positive_subtiles_compat", "mask_px", lambda m: st.positive(st.subtile_frac(m, N, D), True), _FRAC + "select * from f where frac > 0")

# --- grid and polygons ----------------------------------------------------------------------------
_TOUCH = "p.x0 < {x} + {s} and p.x1 > {x} and p.y0 < {y} + {s} and p.y1 > {y} and (p.tri = 0 or (greatest({x}, p.x0) - p.x0) / (p.x1 - p.x0) + (greatest({y}, p.y0) - p.y0) / (p.y1 - p.y0) < 1)"
_PAIRS = f"select distinct g.filename, p.pid from grid g join polys p on {_TOUCH.format(x='g.x1', y='g.y1', s=100)}"
_add("tile_ring", "grid", ve.tile_ring, """
select filename, cast(i.i as int) as i, case when i.i in (2, 3) then x2 else x1 end as px, case when i.i in (1, 2) then y2 else y1 end as py from grid, range(5) i(i)""")
_add("prepare_polygons", "polys", lambda p: ve.prepare_polygons(p.select("pid", F.when(F.col("pid") % 7 == 0, "x").otherwise(F.col("ty").cast("string")).alias("Type"))), """
select pid, case when pid % 7 = 0 then null else ty end as ty from polys""")
_add("overlay_pairs", "grid polys", ve.overlay_pairs, _PAIRS)
_add("tiles_with_truth", "grid polys", ve.tiles_with_truth, f"select distinct filename from ({_PAIRS})")
_add("valid_tiles", "grid px", lambda g, p: ve.valid_tiles(g, ra.nodata(p).select(
    F.format_string("area_2019_%03d_%06d", F.floor(F.col("img") / 10), F.col("img") % 10).alias("filename"), "is_nodata")), """
select * from grid where filename not in (select 'area_2019_' || lpad(cast(img // 10 as varchar), 3, '0') || '_' || lpad(cast(img % 10 as varchar), 6, '0')
from px where band = 1 group by img having bool_and(v in (0, 255)))""")  # fmt: skip
_CELLS = f"select c.filename, c.y, c.x, coalesce(min({{v}}), 0) as cls from cells c left join polys p on {{w}} and {_TOUCH.format(x='c.cx', y='c.cy', s=5)} group by c.filename, c.y, c.x"
_add("rasterize", "cells polys", ve.rasterize, _CELLS.format(v="p.ty", w="p.ty in (1, 2)"))
_add("rasterize_simple", "cells polys", lambda c, p: ve.rasterize(c, p, simple=True), _CELLS.format(v="case when p.pid is not null then 1 end", w="true"))

# Moves keep every tile's classes, whatever they are.
_add("augment", "mask_px", lambda m: ra.augment(m, N, 7).groupBy("img", "cls").agg(F.count("*").alias("n")), "select img, cls, count(*) as n from mask_px group by img, cls")

# --- packed forms ---------------------------------------------------------------------------------------
def _same(name: str, other: str, views: str, run: Callable[..., DataFrame]) -> None:
    """Register another form of a query, which must give the same rows."""
    _QUERIES[name] = lambda spark, d: run(*[view(spark, d, v) for v in views.split()])
    _SQL[name] = _SQL[other]


_YEARLY = ("yr", "img")
_same("nodata_packed", "nodata_tiles", "px", lambda p: pk.nodata_packed(sc.pack_tiles(p, N)).join(pk.nodata_packed(sc.pack_tiles(p, N), "all").withColumnRenamed("is_nodata", "all_nodata"), "img"))
_same("class_counts_packed", "class_counts", "pred_px", lambda p: pk.class_counts_packed(sc.pack_tiles(p, N, "cls", _YEARLY)))
_same("forest_share_packed", "forest_share", "pred_px lu_px", lambda p, f: pk.forest_share_packed(sc.pack_tiles(p, N, "cls", _YEARLY), sc.pack_tiles(f, N, "forest"), 64))
_same("band_stats_packed", "band_stats", "px", lambda p: pk.band_stats_packed(sc.pack_tiles(p, N), D))
_add("distance_mosaic", "mask_px", lambda m: pk.distance_mosaic(sc.pack_tiles(m, N, "cls").withColumns({"row": F.floor(F.col("img") / 10).cast("int"), "col": (F.col("img") % 10).cast("int")}), N, 3, 3), """
with g as (select img, y, x, cls, (img // 10) * 8 + y as gy, (img % 10) * 8 + x as gx from mask_px), o as (select a.i::int as dy, b.i::int as dx from range(-3, 4) a(i), range(-3, 4) b(i)),
n as (select a.img, c.k, a.y, a.x, min(case when (a.cls = c.k) <> (b.cls = c.k) then o.dy * o.dy + o.dx * o.dx end) as s
      from g a cross join o cross join range(3) c(k) left join g b on b.gy = a.gy + o.dy and b.gx = a.gx + o.dx group by all)
select g.img, n.k::int as k, g.y, g.x, case when g.cls = n.k then 1 - coalesce(least(sqrt(s), 3), 3) else coalesce(least(sqrt(s), 3), 3) end as dist
from g join n on g.img = n.img and g.y = n.y and g.x = n.x""")  # fmt: skip


def _filled(world: str, dim: int) -> str:
    """SQL of a raster (gy, gx, band, v) cut into tiles that end where their pixels do, gaps filled with 0."""
    return f"""
with g as ({world}), t as (select gy // {dim} as r, gx // {dim} as c, max(gy % {dim}) as h, max(gx % {dim}) as w, max(band) as bands from g group by all)
select t.r::int as row, t.c::int as col, b.band::int as band, y.y::int as y, x.x::int as x, coalesce(g.v, 0)::int as v
from t, range(1, 5) b(band), range({dim}) y(y), range({dim}) x(x) left join g on g.gy = t.r * {dim} + y.y and g.gx = t.c * {dim} + x.x and g.band = b.band
where b.band <= t.bands and y.y <= t.h and x.x <= t.w"""


def _unpacked(tiles: DataFrame) -> DataFrame:
    numbered = tiles.withColumn("img", F.col("row").cast("long") * (1 << 20) + F.col("col"))
    return sc.unpack_bands(numbered).select(F.floor(F.col("img") / (1 << 20)).cast("int").alias("row"), (F.col("img") % (1 << 20)).cast("int").alias("col"), "band", "y", "x", "v")


def _placed(p: DataFrame, step: int) -> DataFrame:
    at = lambda c: (c * step).cast("int")
    return sc.pack_tiles(p, N).withColumns({"gy": at(F.floor(F.col("img") / 10)), "gx": at(F.col("img") % 10)})


_add("retile_packed", "px", lambda p: _unpacked(pk.recut(_placed(p, 8), 5)), _filled("select (img // 10) * 8 + y as gy, (img % 10) * 8 + x as gx, band, v from px", 5))
_add("mosaic_packed", "px", lambda p: _unpacked(pk.recut(_placed(p, 6), 7, "img")), _filled("select (img // 10) * 6 + y as gy, (img % 10) * 6 + x as gx, band, max_by(v, img) as v from px group by 1, 2, 3", 7))

# --- polygons with rings ------------------------------------------------------------------------------
# The oracle integrates each edge over a box in closed form; edges keep their direction, which counts as the ring's.
_EDGES = """
with e as (
  select pid, ty, part, ring, px as x0, py as y0, lead(px) over w as x1, lead(py) over w as y1 from corners window w as (partition by pid, part, ring order by i)
), f as (
  select *, sign(sum(x0 * y1 - x1 * y0) over (partition by pid, part, ring)) * case when ring = 0 then 1 else -1 end as s from e where x1 is not null
), b as (
  select pid, min(px) as bx0, max(px) as bx1, min(py) as by0, max(py) as by1 from corners group by pid
)"""


def _shared(boxes: str, key: str, size: int) -> str:
    """SQL of (key, pid, ty, area): areas that square boxes (gx, gy) of a size share with polygons."""
    right = lambda x: f"case when xa = xb then greatest(xa - {x}, 0) else (power(greatest(xb - {x}, 0), 2) - power(greatest(xa - {x}, 0), 2)) / 2 / (xb - xa) end"
    return f"""
select {key}, pid, ty, sum(s * (yb - ya) * ({right('gx')} - {right(f'(gx + {size})')})) as area from (
  select *, x0 + (x1 - x0) * (ya - y0) / (y1 - y0) as xa, x0 + (x1 - x0) * (yb - y0) / (y1 - y0) as xb from (
    select g.*, f.*, least(greatest(y0, gy), gy + {size}) as ya, least(greatest(y1, gy), gy + {size}) as yb
    from ({boxes}) g join b on gx < bx1 and gx + {size} > bx0 and gy < by1 and gy + {size} > by0 join f on f.pid = b.pid where y0 <> y1
  ) where ya <> yb
) group by {key}, pid, ty having area > 1e-9 * {size * size}"""


def _read(g: DataFrame) -> DataFrame:
    return g.withColumn("geometry", ri.from_geojson(F.col("geojson")))


def _measures(g: DataFrame) -> DataFrame:
    back = _read(g).withColumn("geometry", ri.from_wkb(ri.to_wkb(F.col("geometry"))))
    n = lambda c: F.when(F.col("geometry").isNotNull(), F.size(c)).alias
    geo = F.col("geometry")
    return back.select("pid", n(geo)("n_parts"), n(F.flatten(geo))("n_rings"), n(F.flatten(F.flatten(geo)))("n_points"), ri.area(geo).alias("area"), ri.bounds(geo).alias("b")).select(
        "pid", "n_parts", "n_rings", "n_points", "area", "b.*"
    )


_add("polygon_measures", "geo corners", lambda g, _: _measures(g), f"""
{_EDGES}, a as (
  select pid, count(distinct part)::int as n_parts, count(distinct (part, ring))::int as n_rings, (count(*) + count(distinct (part, ring)))::int as n_points, sum(s * (x0 * y1 - x1 * y0)) / 2 as area from f group by pid
)
select geo.pid, n_parts, n_rings, n_points, area, bx0 as x0, by0 as y0, bx1 as x1, by1 as y1 from geo left join a on a.pid = geo.pid left join b on b.pid = geo.pid""")  # fmt: skip
_add("polygon_parts", "geo corners", lambda g, _: ri.explode_parts(_read(g)).withColumn("again", ri.from_geojson(ri.to_geojson(F.col("geometry")))).select(
    "pid", ri.area(F.col("again")).alias("area")), f"""
{_EDGES} select geo.pid, area from geo left join (select pid, part, sum(s * (x0 * y1 - x1 * y0)) / 2 as area from f group by pid, part) a on a.pid = geo.pid""")  # fmt: skip
_add("overlay_area", "grid geo corners", lambda g, p, _: ri.overlay_area(g, _read(p)).withColumn("area", F.round(F.col("area") + 3e-7, 3)),
     f"{_EDGES} select filename, pid, round(area + 3e-7, 3) as area from ({_shared('select filename, x1 as gx, y1 as gy from grid', 'filename', 100)})")
_BURNT = f"{_EDGES}, h as ({_shared('select filename, y as cell_y, x as cell_x, cx as gx, cy as gy from cells', 'filename, cell_y, cell_x', 5)}) " + """
select c.filename, c.y, c.x, coalesce(min({v}), 0) as cls from cells c left join h on c.filename = h.filename and c.y = h.cell_y and c.x = h.cell_x and {w} group by c.filename, c.y, c.x"""
_add("rasterize_rings", "cells geo corners", lambda c, p, _: ri.rasterize_rings(c, _read(p)), _BURNT.format(v="h.ty", w="h.ty in (1, 2)"))
_add("rasterize_rings_simple", "cells geo corners", lambda c, p, _: ri.rasterize_rings(c, _read(p), simple=True), _BURNT.format(v="case when h.pid is not null then 1 end", w="true"))
_add("burn_tiles", "grid cells geo corners", lambda g, c, p, _: sc.unpack_named(ri.burn_tiles(g, _read(p), 20, 5.0)).where("cls > 0"),
     f"select filename, y, x, cls from ({_BURNT.format(v='h.ty', w='h.ty in (1, 2)')}) where cls > 0")

# --- raster files -------------------------------------------------------------------------------------
_add("raster_codec", "px", lambda p: sc.unpack_bands(sc.recode(sc.pack_tiles(p, N), 16)), """
select i.img, b.band, y.y, x.x, coalesce(p.v, 0)::int as v
from (select img, max(band) as bands, max(y) as h, max(x) as w from px group by img) i, range(1, 5) b(band), range(8) y(y), range(8) x(x)
left join px p on p.img = i.img and p.band = b.band and p.y = y.y and p.x = x.x where b.band <= i.bands and y.y <= i.h and x.x <= i.w""")



def _raster_files(spark, d: str) -> DataFrame:
    """Every tile as a raster file of its own, written to the shared folder and read back by the data source."""
    files = sc.encoded(sc.pack_tiles(view(spark, d, "px"), N), 16)
    path = fresh_path(spark, "rasters")
    io.write_files(files.select(F.format_string("%012d.tif", "img").alias("name"), F.lit(1).cast("long").alias("samples"), "content"), path)
    tiles = read_raster(spark, path)
    return sc.unpack_bands(tiles.select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("img"), "h", "w", "bands", "data"))


_QUERIES["raster_files"], _SQL["raster_files"] = _raster_files, _SQL["raster_codec"]


def _shard_samples(spark, d: str) -> DataFrame:
    """Subtiles as samples of shards, written in two phases and read back by the index of their members."""
    subs = pk.pack_blocks(sc.pack_tiles(view(spark, d, "px"), N), N, D)
    path = fresh_path(spark, "shards")
    io.write_shards(subs.select(F.format_string("%012d_%03d", "img", "sub").alias("key"), F.create_map(F.lit("bin"), F.col("data")).alias("parts")), path, "part-%06d.tar")
    return io.read_members(io.shard_index(spark, path)).select("shard", "pos", "key", F.octet_length(F.col("parts")["bin"]).alias("n"))


_QUERIES["shard_samples"], _SQL["shard_samples"] = _shard_samples, oracle("px", """
with k as (select lpad(cast(img as varchar), 12, '0') || '_' || lpad(cast(s.i as varchar), 3, '0') as key, (max(band) * 16)::int as n from px, range(4) s(i) group by img, s.i),
i as (select *, row_number() over (order by key) - 1 as i from k)
select 'part-' || lpad(cast(i // 32 as varchar), 6, '0') || '.tar' as shard, i % 32 as pos, key, n from i""")

# --- joins --------------------------------------------------------------------------------------------
_add("triplet_join", "px mask_px lu_px", lambda p, m, u: p.where("band = 1").join(m, ["img", "y", "x"]).join(u, ["img", "y", "x"]), """
select img, y, x, band, v, cls, forest from (select img, y, x, band, v, cls from px join mask_px using (img, y, x) where band = 1) join lu_px using (img, y, x)""")
_add("negatives_join", "px mask_px lu_px", lambda p, m, u: p.where("band = 1").join(m, ["img", "y", "x"], "left").join(u, ["img", "y", "x"], "left").fillna(0, ["cls"]).fillna(1, ["forest"]), """
select img, y, x, band, v, coalesce(cls, 0) as cls, coalesce(forest, 1) as forest
from (select img, y, x, band, v, cls from px left join mask_px using (img, y, x) where band = 1) left join lu_px using (img, y, x)""")

# --- keys, sampling, splitting --------------------------------------------------------------------------
_KEYS = "with k as (select t.tile || '_' || lpad(cast(s.i as varchar), 3, '0') as key from subtile_stats t, range(4) s(i)) "
_add("all_keys", "subtile_stats", lambda s: sa.all_keys(s, SUBS), _KEYS + "select key from k")
_POS = "select tile || '_000' as key from subtile_stats where status = 1 and frac > 5"


def _positives(s: DataFrame) -> DataFrame:
    return s.where("status = 1 and frac > 5").select(F.concat("tile", F.lit("_000")).alias("key"))


_add("negative_pool", "subtile_stats", lambda s: sa.all_keys(s, SUBS).join(_positives(s), "key", "left_anti"), _KEYS + f"select key from k except {_POS}")
_add("sample_exact", "subtile_stats", lambda s: sa.sample_exact(s, "tile", 7, frac=0.1), """
select * from subtile_stats order by md5(tile || '#7'), tile limit (select cast(round_even(count(*) * 0.1, 0) as bigint) from subtile_stats)""")
_add("sample_negatives", "subtile_stats", lambda s: sa.sample_negatives(s.where("frac > 9").select(F.concat("tile", F.lit("_000")).alias("key")), sa.all_keys(s, SUBS), 2, 3), _KEYS + """
, q as (select tile || '_000' as key from subtile_stats where frac > 9), n as (select key from k except select key from q)
select key from n order by md5(key || '#3'), key limit (select 2 * count(*) from q)""")
_add("tiles_of", "subtile_stats", lambda s: sa.tiles_of(sa.sample_exact(sa.all_keys(s, SUBS), "key", 5, 200)), _KEYS + """
select distinct substr(key, 1, length(key) - 4) as tile from (select key from k order by md5(key || '#5'), key limit 200)""")
_add("keep_keys", "subtile_stats", lambda s: sa.all_keys(s, SUBS).join(_positives(s), "key", "left_semi"), _KEYS + f"select key from k where key in ({_POS})")
_add("global_index", "subtile_stats", lambda s: sa.global_index(s, "tile"), "select *, row_number() over (order by tile) - 1 as idx from subtile_stats")
_SPLIT = """with s as (select tile, frac, status, row_number() over (order by frac desc, tile) - 1 as i, ceil(count(*) over () / {size}) as g from subtile_stats where frac > 0),
b as (select tile, frac, status, cast(i % cast(g as bigint) as bigint) as shard from s) """
_pos = lambda s: s.where("frac > 0")
_add("balanced_split", "subtile_stats", lambda s: sa.balanced_split(_pos(s), 32), _SPLIT.format(size=32) + "select * from b")
_add("shard_totals", "subtile_stats", lambda s: sa.shard_totals(sa.balanced_split(_pos(s), 32)), _SPLIT.format(size=32) + "select shard, sum(frac) as total, count(*) as n from b group by shard")


def _filled(compat: bool) -> Callable[[DataFrame], DataFrame]:
    def run(s: DataFrame) -> DataFrame:
        full = sa.fill_shards(sa.balanced_split(_pos(s), 32), 32, compat=compat)
        return full.groupBy("shard").agg(F.count("*").alias("n"), F.sum("copy").alias("copies"), F.count_distinct("pos").alias("places"))

    return run


_FILL = _SPLIT.format(size=32) + """, c as (select shard, count(*) as n, max(shard) over () as last from b group by shard)
select shard, 32::bigint as n, 32 - n as copies, 32::bigint as places from c where n = 32 or (n * 2 > 32 {only})"""
_add("fill_shards", "subtile_stats", _filled(False), _FILL.format(only=""))
_add("fill_shards_compat", "subtile_stats", _filled(True), _FILL.format(only="and shard = last"))
_SHARDS = "with h as (select distinct cast(substr(tile, 6) as bigint) // 20 as shard from subtile_stats), i as (select shard, row_number() over (order by shard) - 1 as i, count(*) over () as n from h) "
_PART = "case when i < round_even({n} * 0.7, 0) then 'train' when i < round_even({n} * 0.7, 0) + round_even({n} * 0.2, 0) then 'val' else 'test' end"


def _shards(s: DataFrame) -> DataFrame:
    return s.select(F.floor(F.expr("cast(substring(tile, 6) as bigint)") / 20).alias("shard")).distinct()


_add("split_shards", "subtile_stats", lambda s: sa.split_shards(_shards(s)), _SHARDS + f"select shard, {_PART.format(n='n')} as part from i")
_add("split_like", "subtile_stats", lambda s: sa.split_like(_shards(s).where("shard % 3 = 0"), sa.split_shards(_shards(s))), _SHARDS + f"""
, r as (select count(*) filter ({_PART.format(n='n')} = 'train')::double / count(*) as f from i),
e as (select shard, row_number() over (order by shard) - 1 as i, count(*) over () as n from h where shard % 3 = 0)
select shard, case when i < round_even(n * f, 0) then 'train' else 'val' end as part from e, r""")
_add("shard_target", "subtile_stats", lambda s: sa.shard_target(_shards(s).select(F.concat(F.lit("/data/v2/"), F.col("shard") % 4 + 2017, F.lit("/1000")).alias("dir"), F.concat(F.lit("train-0"), F.col("shard"), F.lit(".tar")).alias("name"))), _SHARDS + """
select '/data/v2/' || (shard % 4 + 2017) || '/1000' as dir, 'train-0' || shard || '.tar' as name, cast(shard % 4 + 2017 as varchar) as year,
       'train-' || (shard % 4 + 2017) || '-0' || shard || '.tar' as target from h""")
_add("merge_years", "subtile_stats", lambda s: sa.merge_years(_shards(s).withColumn("year", F.col("shard") % 4 + 2017)), _SHARDS + f"""
, y as (select shard, shard % 4 + 2017 as year, row_number() over (partition by shard % 4 order by shard) - 1 as i, count(*) over (partition by shard % 4) as n from h)
select shard, year, {_PART.format(n='n')} as part from y""")


def _sides(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = sa.global_index(s, "tile").select("tile", F.floor(F.col("idx") / 10).alias("shard"), (F.col("idx") % 10).alias("pos"))
    return cut.where("shard % 2 = 0").withColumn("shard", F.floor(F.col("shard") / 2)), cut.where("shard % 2 = 1 and pos < 7").withColumn("shard", F.floor(F.col("shard") / 2))


_add("interleave", "subtile_stats", lambda s: sa.interleave(*_sides(s)), """
with c as (select tile, i // 10 as sh, i % 10 as pos from (select tile, row_number() over (order by tile) - 1 as i from subtile_stats)),
a as (select tile, sh // 2 as shard, pos from c where sh % 2 = 0), b as (select tile, sh // 2 as shard, pos from c where sh % 2 = 1 and pos < 7)
select a.shard, a.pos * 2 as pos, a.tile from a join b on a.shard = b.shard and a.pos = b.pos
union all select b.shard, b.pos * 2 + 1, b.tile from a join b on a.shard = b.shard and a.pos = b.pos""")
_BATCH = "with q as (select tile, frac, status, row_number() over (order by tile) - 1 as i, count(*) over () as n from subtile_stats), b as (select tile, frac, status, i // 12 as batch_id, i % 12 as pos from q where i // 12 < n // 12) "
_add("batch_manifest", "subtile_stats", lambda s: sa.batch_manifest(s, "tile", 16, (3, 1)), _BATCH + "select * from b")
_add("cycle_batches", "subtile_stats", lambda s: sa.cycle_batches(sa.batch_manifest(s, "tile", 16, (4,)).select("batch_id").distinct(), _shards(s).where("shard < 7").withColumnRenamed("shard", "batch_id").withColumn("extra", F.col("batch_id") * 10)), _BATCH + """
, e as (select distinct cast(substr(tile, 6) as bigint) // 20 as sh from subtile_stats), f as (select sh, max(sh) over () + 1 as n from e where sh < 7)
select d.batch_id, f.sh as extra_batch, f.sh * 10 as extra from (select distinct batch_id from b) d join f on d.batch_id % f.n = f.sh""")
_add("shuffle_within", "subtile_stats", lambda s: sa.shuffle_within(sa.balanced_split(_pos(s), 32).select("tile", "shard"), "tile", 11), _SPLIT.format(size=32) + """
select tile, shard, row_number() over (partition by shard order by md5(tile || '#11'), tile) - 1 as pos from b""")

# --- evaluation ------------------------------------------------------------------------------------------
_CELL = """with g as (select t.i as t, p.i as p from range(3) t(i), range(3) p(i)),
c as (select cast(g.t as int) as t, cast(g.p as int) as p, count(e.t) as n, count(e.t) filter (e.lu = 1) as n_forest from g left join eval_px e on e.t = g.t and e.p = g.p group by 1, 2),
r as (select *, case when sum(n) over (partition by t) > 0 then n::double / sum(n) over (partition by t) else 0 end as share,
             case when sum(n_forest) over (partition by t) > 0 then n_forest::double / sum(n_forest) over (partition by t) else 0 end as share_forest from c) """
_add("confusion", "eval_px", lambda e: ev.confusion(e, 3), _CELL + "select t, p, n from r")
_add("confusion_norm", "eval_px", lambda e: ev.confusion(e, 3, True), _CELL + "select t, p, share from r")
_add("confusion_report", "eval_px", lambda e: ev.confusion_report(e, 3), _CELL + "select * from r")
_PLANES = "with c as (" + " union all ".join(f"select sample, {i} as k, cast(t = {i} as double) as hot, p{i}::double as prob, cast(p = {i} as int) as said, cast(t = {i} as int) as truth from eval_px" for i in range(3)) + ") "
_FS = "select (2 * sum(hot * (prob > 0.5)::double) + 1e-7) / (sum(hot) + sum((prob > 0.5)::double) + 1e-7) as fscore from c"
_add("fscore", "eval_px", lambda e: ev.fscore(e, 3, [0]), _PLANES + _FS + " where k > 0")
_add("fscore_bg", "eval_px", lambda e: ev.fscore(e, 3), _PLANES + _FS)
_add("dice_sample", "eval_px", lambda e: ev.dice(e, 3), _PLANES + "select sample, k, (2 * sum(hot * prob) + 1e-10) / (sum(hot + prob) + 1e-10) as dice from c group by 1, 2")
_add("dice_batch", "eval_px", lambda e: ev.dice(e, 3, "batch"), _PLANES + "select k, (2 * sum(hot * prob) + 1e-10) / (sum(hot + prob) + 1e-10) as dice from c group by 1")
_add("inter_union", "eval_px", lambda e: ev.inter_union(e, 3), _PLANES + "select sample, k, sum(truth * said)::bigint as inter, sum(greatest(truth, said))::bigint as uni from c group by 1, 2")
_add("soft_size", "eval_px", lambda e: ev.soft_size(e, 3), _PLANES + "select sample, k, sum(prob) as size from c group by 1, 2")
_add("class_set", "eval_px", lambda e: ev.class_set(e, 3), "select count(distinct t) as classes, bool_and(t between 0 and 2) as valid from eval_px")
_CE = "-sum(hot * ln(prob + 1e-10)) / (sum(hot) + 1e-10)"
_DL = "(select avg(1 - d) from (select sample, k, (2 * sum(hot * prob) + 1e-10) / (sum(hot + prob) + 1e-10) as d from c where k > 0 group by 1, 2))"
_FO = "(select -sum(pow(1 - prob, 2) * hot * ln(prob + 1e-10)) / (sum(hot) + 1e-10) from c)"
_GD = "(select 1 - 2 * (sum(i / (t * t + 1e-9)) + 1e-9) / (sum((t + p) / (t * t + 1e-9)) + 1e-9) from (select k, sum(hot) as t, sum(prob) as p, sum(hot * prob) as i from c group by k))"
_add("cross_entropy", "eval_px", lambda e: ev.cross_entropy(e, 3), _PLANES + f"select {_CE} as cross_entropy from c")
_add("dice_loss", "eval_px", lambda e: ev.dice_loss(e, 3, [1, 2]), _PLANES + f"select {_DL} as dice_loss")
_add("gdice_sample", "eval_px", lambda e: ev.gdice_sample(e, 3), _PLANES + """
, s as (select sample, k, sum(hot) as t, sum(prob) as p, sum(hot * prob) as i from c group by 1, 2),
w as (select *, 1 / (t * t + 1e-10) as w from s), z as (select sample, sum(w * i) as i, sum(w * (t + p)) as u from w group by 1)
select avg(1 - 2 * (i + 1e-10) / (u + 1e-10)) as gdice_sample from z""")
_add("gdice", "eval_px", lambda e: ev.gdice(e, 3), _PLANES + f"select {_GD} as gdice")
_add("focal", "eval_px", lambda e: ev.focal(e, 3), _PLANES + f"select {_FO} as focal")
_GW = """with d as (select sample, t, case t when 0 then p1 + p2 when 1 then p0 + 0.5 * p2 else p0 + 0.5 * p1 end::double as d from eval_px) """
_add("gwdice", "eval_px", lambda e: ev.gwdice(e, 3), _GW + """, s as (select sample, sum(case when t > 0 then 1 - d else 0 end) as tp, sum(d) as e from d group by 1)
select avg(1 - (2 * tp + 1e-10) / (2 * tp + e + 1e-10)) as gwdice from s""")
_add("gwdice_samples", "eval_px", lambda e: ev.gwdice(e, 3, reduction="none"), _GW + """, s as (select sample, sum(case when t > 0 then 1 - d else 0 end) as tp, sum(d) as e from d group by 1)
select sample, 1 - (2 * tp + 1e-10) / (2 * tp + e + 1e-10) as loss from s""")
_add("gwdice_scores", "eval_px", lambda e: ev.gwdice(e, 3, scores=True), """
with e as (select sample, t, exp(p0) as a, exp(p1) as b, exp(p2) as c from eval_px),
d as (select sample, t, (case t when 0 then b + c when 1 then a + 0.5 * c else a + 0.5 * b end::double) / (a + b + c) as d from e),
s as (select sample, sum(case when t > 0 then 1 - d else 0 end) as tp, sum(d) as e from d group by 1)
select avg(1 - (2 * tp + 1e-10) / (2 * tp + e + 1e-10)) as gwdice from s""")
_add("gwdice_gdl", "eval_px", lambda e: ev.gwdice(e, 3, mode="gdl"), _GW + """, q as (select sample, t, count(*) as n, sum(d) as d from d group by 1, 2),
s as (select sample, sum((n - d) / (n + 1e-10)) as tp, sum(d / (n + 1e-10)) as e from q group by 1) select avg(1 - (2 * tp + 1e-10) / (2 * tp + e + 1e-10)) as gwdice from s""")


def _total(e: DataFrame, m: DataFrame) -> DataFrame:
    probs = ra.one_hot(m, 3).select("img", "k", "y", "x", (F.lit(0.2) + 0.5 * F.col("hot")).alias("prob"))
    return ev.total_score(ev.gdice(e, 3), ev.focal(e, 3), ev.boundary(probs, _distances(m)), 9)


_add("total_score", "eval_px mask_px", _total, _PLANES + ", " + _DIST.strip()[5:] + f"""
select {_GD} + {_FO} + 0.1 * (select avg((0.2 + 0.5 * cast(m.cls = z.k as int))::double * z.dist) from z join mask_px m on m.img = z.img and m.y = z.y and m.x = z.x where z.k > 0) as total_score""")
_add("n_batches", "subtile_stats", lambda s: sa.batches_of_split(sa.balanced_split(s.where("frac > 0"), 32), 32, 16), "select cast(floor(ceil(count(*) / 32) * 32 / 16) as bigint) as batches from subtile_stats where frac > 0")

# --- scoring ---------------------------------------------------------------------------------------------
_add("vote", "vote_px", lambda v: ev.vote(v, ["img", "y", "x"], 3), """
with c as (select img, y, x, cls, count(*) as n from vote_px group by all)
select img, y, x, cls from c qualify row_number() over (partition by img, y, x order by n desc, cls) = 1""")
_LINEAR = """with k as (select distinct img from px where img not in (select img from px where band = 1 group by img having bool_and(v in (0, 255)))),
v as (select img, y, x, max(v) filter (band = 1) / 255.0::double as a, max(v) filter (band = 2) / 255.0::double as b, max(v) filter (band = 3) / 255.0::double as c, max(v) filter (band = 4) / 255.0::double as d
      from px where img in (select img from k) group by 1, 2, 3),
s as (select *, {w} as s0, {x} as s1, {y} as s2 from v),
r as (select img, y, x, case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 1 else 2 end as cls from s) """


def _scores(weights) -> dict[str, str]:
    return {n: " + ".join(f"{c}::double * {v}" for c, v in zip(row, "abcd", strict=True)) for n, row in zip("wxy", weights, strict=True)}


_add("score_linear", "px", lambda p: sc.unpack_classes(sc.score_tiles(sc.pack_tiles(p, N), sc.linear_model(sc.WEIGHTS[0]), N, D)), _LINEAR.format(**_scores(sc.WEIGHTS[0])) + "select img, y, x, cls from r")
_add("score_normalized", "px", lambda p: sc.unpack_classes(sc.score_tiles(sc.pack_tiles(p, N), sc.linear_model(sc.WEIGHTS[0]), N, D, ((0.5, 0.25, 0.5, 0.75), (0.25, 0.5, 0.125, 0.25)))),
     _LINEAR.format(**_scores(sc.WEIGHTS[0])).replace("/ 255.0::double as a", "/ 255.0::double as a0").replace("/ 255.0::double as b", "/ 255.0::double as b0").replace("/ 255.0::double as c,", "/ 255.0::double as c0,").replace("/ 255.0::double as d", "/ 255.0::double as d0")
     .replace("from v)", "from (select *, (a0 - 0.5) / 0.25 as a, (b0 - 0.25) / 0.5 as b, (c0 - 0.5) / 0.125 as c, (d0 - 0.75) / 0.25 as d from v) v)") + "select img, y, x, cls from r")
_add("score_fraction", "px", lambda p: sc.image_fractions(sc.score_tiles(sc.pack_tiles(p, N), sc.linear_model(sc.WEIGHTS[0]), N, D)), _LINEAR.format(**_scores(sc.WEIGHTS[0])) + """
select img, avg(case when cls > 0 then 1.0::double else 0 end) as fraction, 'linear' as model_name from r group by img""")
_ENS = "with " + ", ".join(
    _LINEAR.format(**_scores(w)).strip()[5:].replace("k as", f"k{i} as").replace("from k)", f"from k{i})").replace("\nv as", f"\nv{i} as").replace("from v)", f"from v{i})").replace("\ns as", f"\ns{i} as").replace("from s)", f"from s{i})").replace("\nr as", f"\nr{i} as")
    for i, w in enumerate(sc.WEIGHTS)
) + """, u as (select * from r0 union all select * from r1 union all select * from r2), c as (select img, y, x, cls, count(*) as n from u group by all)
select img, y, x, cls from c qualify row_number() over (partition by img, y, x order by n desc, cls) = 1"""  # fmt: skip
_add("score_ensemble", "px", lambda p: sc.unpack_classes(sc.score_ensemble(sc.pack_tiles(p, N), [sc.linear_model(w) for w in sc.WEIGHTS], N, D)), _ENS)
