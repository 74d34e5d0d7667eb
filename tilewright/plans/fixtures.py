"""Raster, polygon and evaluation tables derived from the given tables, for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("embeddings", "lineitem", "customer", "nation", "part", "events")
EMB = {
    "spark": "select vec_id, cast(pos as bigint) as idx, cast(e as double) as e from embeddings lateral view posexplode(embedding) z as pos, e",
    "duckdb": "select vec_id, i - 1 as idx, cast(embedding[i] as double) as e from embeddings, unnest(range(1, 65)) as u(i)",
}
#: A row for each of the 20 x 20 cells of a tile.
EACH = {"spark": "explode(sequence(0, 399)) as v", "duckdb": "unnest(range(400)) as v"}
#: Corners of the fixture's polygons: part, ring, place, and x and y as (times of the large radius, of the small one, metres).
#: A star of four points, in some a hole, in some a second part that runs clockwise.
_STAR = [(1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 1, 0), (0, 0, 0, 1, 0, 0), (0, -1, 0, 0, 1, 0), (-1, 0, 0, 0, 0, 0), (0, -1, 0, 0, -1, 0), (0, 0, 0, -1, 0, 0), (0, 1, 0, 0, -1, 0)]
_HOLE = [(0, 0, 1, 0, 0, 0), (0, 0, 0, 0, 0, 1), (0, 0, -1, 0, 0, 0), (0, 0, 0, 0, 0, -1)]
_SIDE = [(1, 0, 8, 0, 0, -2), (1, 0, 8, 0, 0, 2), (1, 0, 12, 0, 0, 2), (1, 0, 12, 0, 0, -2)]
CORNERS = [(p, r, i, *c) for p, r, ring in ((0, 0, _STAR), (0, 1, _HOLE), (1, 0, _SIDE)) for i, c in enumerate([*ring, ring[0]])]


def _geojson() -> str:
    """SQL text of a polygon's GeoJSON."""

    def ring(part: int, number: int, last: bool = True) -> str:
        points = [c[3:] for c in CORNERS if c[:2] == (part, number)]
        at = lambda c, name: f"cast(c{name} + {c[0]} * big + {c[1]} * small + {c[2]} as varchar(20))"
        return "'[' || " + " || ',' || ".join(f"'[' || {at(c[:3], 'x')} || ',' || {at(c[3:], 'y')} || ']'" for c in points[: None if last else -1]) + " || ']'"

    star = f"'[' || case when pid % 31 = 2 then {ring(0, 0, False)} else {ring(0, 0)} end || case when hole then ',' || {ring(0, 1)} else '' end || ']'"
    one = f"'{{\"type\":\"Polygon\",\"coordinates\":' || {star} || '}}'"
    two = f"'{{\"type\":\"MultiPolygon\",\"coordinates\":[' || {star} || ',[' || {ring(1, 0)} || ']]}}'"
    return f"case when side then {two} else {one} end"


#: View name: the views it needs, and its text, which both engines take. Polygons and tiles lie in a band that
#: widens by 1000 with every 1500 customers: 100 tiles for each 1500 polygons.
VIEWS = {
    "px": (["emb_px"], """
select cast(floor(vec_id / 4) as bigint) as img, cast(vec_id % 4 + 1 as int) as band,
       cast(floor(idx / 8) as int) as y, cast(idx % 8 as int) as x,
       cast(case when floor(vec_id / 4) % 16 = 5 then 255 * (idx % 2)
                 when floor(vec_id / 4) % 16 = 9 and idx < 32 and idx % 8 < 4 then 7
                 else greatest(0, least(255, floor((e + 0.5) * 255))) end as int) as v
from emb_px where not (floor(vec_id / 4) % 16 = 3 and idx >= 48)"""),
    "mask_px": (["px"], """
select img, y, x, cast(case when img % 5 = 1 then 0 when v > 175 then 1 when v < 70 then 2 else 0 end as int) as cls
from px where band = 4 and img % 5 <> 0"""),
    "lu_px": (["px"], """
select img, y, x, cast(case when img % 11 = 2 then (case when y = 0 and x = 0 then 1 else 0 end) when v > 110 then 1 else 0 end as int) as forest
from px where band = 3 and img % 7 <> 0"""),
    "pred_px": (["px"], """
select b.yr, p.img, p.y, p.x, cast(case when p.v > 180 - b.k * 5 then 1 when p.v < 80 + b.k * 5 then 2 else 0 end as int) as cls
from px p join (select 2017 as yr, 0 as k, 1 as band union all select 2018, 1, 2 union all select 2019, 2, 3 union all select 2020, 3, 4) b
  on p.band = b.band where (p.img + b.k) % 9 <> 0"""),
    "vote_px": (["px"], """
select img, y, x, band as model, cast(case when v > 150 then 1 when v < 100 then 2 else 0 end as int) as cls from px where band <= 3"""),
    "eval_px": ([], """
select l_orderkey % 256 as sample,
       cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as int) as t,
       cast(case when l_linestatus = 'O' then cast(l_quantity as int) % 3
            else case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end end as int) as p,
       cast(case when l_tax > 0.02 then 1 else 0 end as int) as lu,
       (l_quantity / 50 + 0.1) / (l_quantity / 50 + l_discount * 10 + l_tax * 12 + 0.3) as p0,
       (l_discount * 10 + 0.1) / (l_quantity / 50 + l_discount * 10 + l_tax * 12 + 0.3) as p1,
       (l_tax * 12 + 0.1) / (l_quantity / 50 + l_discount * 10 + l_tax * 12 + 0.3) as p2
from lineitem"""),
    "polys": ([], """
select c_custkey as pid, cast((c_custkey * 37) % 1000 + 1000 * floor((c_custkey - 1) / 1500) + 0.5 as double) as x0, cast((c_custkey * 91) % 1000 + 0.5 as double) as y0,
       cast((c_custkey * 37) % 1000 + 1000 * floor((c_custkey - 1) / 1500) + 5.5 + c_custkey % 17 as double) as x1, cast((c_custkey * 91) % 1000 + 5.5 + c_custkey % 11 as double) as y1,
       cast(case when c_custkey % 13 = 0 then 3 else 1 + c_custkey % 2 end as int) as ty, cast(case when c_custkey % 3 = 0 then 1 else 0 end as int) as tri
from customer where not (c_custkey * 37) % 1000 between 270 and 399"""),
    "grid": ([], """
select 'area_2019_' || lpad(cast(r as varchar(3)), 3, '0') || '_' || lpad(cast(c as varchar(6)), 6, '0') as filename,
       cast(c * 100 as double) as x1, cast(c * 100 + 100 as double) as x2, cast(r * 100 as double) as y1, cast(r * 100 + 100 as double) as y2
from (select cast(floor((c_custkey - 1) % 1500 / 150) as int) as r, cast(floor((c_custkey - 1) % 150 / 15) + 10 * floor((c_custkey - 1) / 1500) as int) as c
      from customer where (c_custkey - 1) % 15 = 0) g"""),
    "cells": (["grid"], """
select filename, cast(floor(v / 20) as int) as y, cast(v % 20 as int) as x, x1 + (v % 20) * 5.0 as cx, y1 + floor(v / 20) * 5.0 as cy from (select *, {each} from grid) c"""),
    "stars": ([], """
select c_custkey as pid, cast((c_custkey * 37) % 1000 + 1000 * floor((c_custkey - 1) / 1500) + 0.5 as double) as cx, cast((c_custkey * 91) % 1000 + 0.5 as double) as cy,
       cast(case when c_custkey % 500 = 7 then 300 else 6 + c_custkey % 17 end as int) as big, cast(2 + c_custkey % 2 as int) as small,
       cast(case when c_custkey % 13 = 0 then 3 else 1 + c_custkey % 2 end as int) as ty, c_custkey % 3 = 0 as hole, c_custkey % 5 = 0 as side
from customer"""),
    "geo": (["stars"], f"""
select pid, ty, case when pid % 29 = 1 then substr(g, 1, 90) else g end as geojson from (select *, {_geojson()} as g from stars) s"""),
    "corners": (["stars"], f"""
select s.pid, s.ty, c.part, c.ring, c.i, s.cx + c.xb * s.big + c.xs * s.small + c.xm as px, s.cy + c.yb * s.big + c.ys * s.small + c.ym as py
from stars s join (values {', '.join(str(c) for c in CORNERS)}) c(part, ring, i, xb, xs, xm, yb, ys, ym) on (c.ring = 0 or s.hole) and (c.part = 0 or s.side)
where s.pid % 29 <> 1 and s.pid % 31 <> 2"""),
    "subtile_stats": ([], """
select 'tile_' || lpad(cast(p_partkey as varchar(9)), 9, '0') as tile, round(cast(p_partkey * 7919 % 1000 as double) / 100, 2) as frac,
       cast(case when p_partkey * 7919 % 1000 > 0 then 1 else 0 end as int) as status
from part"""),
}

#: Rows of a table for each task that makes views of it: of one customer they make many cells, and one task may read all customers.
SPREAD = {"customer": 10_000}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n not in out:
            if n in VIEWS:
                for d in VIEWS[n][0]:
                    visit(d)
            out.append(n)

    for n in names:
        visit(n)
    return out


def _ctes(names: list[str], engine: str) -> str:
    # The oracle would work a view out anew for each time that a query names it.
    kept = " materialized" if engine == "duckdb" else ""
    return ", ".join(f"{n} as{kept} ({EMB[engine] if n == 'emb_px' else VIEWS[n][1].replace('{each}', EACH[engine])})" for n in _closure(names))


def _spread(spark: SparkSession, path: str, rows: int | None) -> str:
    """Hint that deals the rows of a table to tasks of so many rows, for tables of more than one task; the count comes from the files' footers."""
    n = -(-spark.read.parquet(path).count() // rows) if rows else 1
    return f"/*+ repartition({n}) */ " if n > 1 else ""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the tables of a directory."""
    body = _ctes([name], "spark")
    path = lambda b: f"{sf_dir}/{b}.parquet"
    tables = ", ".join(f"{b} as (select {_spread(spark, path(b), SPREAD.get(b))}* from parquet.`{path(b)}`)" for b in BASE if b in body)
    return spark.sql(f"with {tables}, {body} select * from {name}")


def oracle(names: str, body: str) -> str:
    """SQL for the oracle: the named views, then the query or its further common table expressions."""
    rest = body.strip()
    rest = ", " + rest[5:] if rest[:5].lower() == "with " else " " + rest
    return f"with {_ctes(names.split(), 'duckdb')}{rest}"
