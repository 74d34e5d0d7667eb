"""Polygons with rings, holes and parts: codec, exact overlay areas, burning into cells.

A geometry is an array of parts, each an array of rings, each an array of points (x, y); the
first ring of a part is its outline and the others are holes. GeoJSON is read and written by
Spark's own functions, WKB in Arrow batches.

Areas and burning need no geometry in one piece. Edges are cut at the lines of a square lattice,
so every piece lies in one cell. Inside a row of cells, a piece covers what is left of it, up or
down by its direction: the sum over the pieces to the right, and the part of the cell itself left
of its own pieces, is the area that cell and polygon share. Cells between two pieces of a row
are wholly inside or outside, so they stay one run. A polygon of any size thus gives rows in
proportion to its outline, and none of them needs the others but those of its own row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.binding import let

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
#: Share of a cell's area below which a cell and a polygon share none.
TOUCH = 1e-9
#: Halvings that runs of whole cells are joined by; longer runs are taken as several.
LEVELS = 16


# --- codec ---------------------------------------------------------------------------------------
def _valid(geometry: Column) -> Column:
    """The geometry, or null: every part needs an outline, every ring four points or more, the last as the first, all finite."""
    finite = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))
    ring = lambda r: F.coalesce((F.size(r) >= 4) & (F.get(r, 0) == F.element_at(r, -1)) & F.forall(r, lambda p: F.coalesce(finite(p), F.lit(False))), F.lit(False))
    part = lambda p: F.coalesce((F.size(p) > 0) & F.forall(p, ring), F.lit(False))
    return F.when(F.forall(geometry, part), geometry)


def from_geojson(text: Column) -> Column:
    """Geometry of a GeoJSON Polygon or MultiPolygon; null for other types, malformed texts and broken rings. Further coordinates than two are left out."""
    kind = F.get_json_object(text, "$.type")
    body = F.get_json_object(text, "$.coordinates")
    polygon = F.array(F.from_json(body, "array<array<array<double>>>"))
    parts = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", F.from_json(body, "array<array<array<array<double>>>>"))
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    return let(F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, point))).cast(GEOMETRY), _valid)


def to_geojson(geometry: Column) -> Column:
    """A Polygon for one part, else a MultiPolygon."""
    pairs = F.transform(geometry, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(pairs, 0).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates")))
    return F.when(geometry.isNotNull(), F.when(F.size(geometry) == 1, one).otherwise(many))


class _Reader:
    """Well-known binary, either byte order, with or without further dimensions and a reference system."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        values = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return values

    def head(self) -> tuple[str, int, int]:
        order = {0: ">", 1: "<"}[self.take("B")[0]]
        (code,) = self.take(f"{order}I")
        if code & 0x20000000:
            self.take(f"{order}I")
        flat = code & 0x0FFFFFFF
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) if flat < 1000 else (2, 3, 3, 4)[flat // 1000]
        return order, flat % 1000, dims

    def polygon(self, order: str, dims: int) -> list:
        rings = []
        for _ in range(self.take(f"{order}I")[0]):
            (n,) = self.take(f"{order}I")
            if n * dims * 8 > len(self.data) - self.at:
                raise ValueError("more points than bytes")
            points = np.frombuffer(self.data, f"{order}f8", n * dims, self.at).reshape(n, dims)[:, :2].astype(float)
            self.at += n * dims * 8
            rings.append(points)
        return rings

    def geometry(self) -> list:
        order, kind, dims = self.head()
        if kind == 3:
            parts = [self.polygon(order, dims)]
        elif kind == 6:
            parts = []
            for _ in range(self.take(f"{order}I")[0]):
                inner, kind, dims = self.head()
                if kind != 3:
                    raise ValueError("a part is no polygon")
                parts.append(self.polygon(inner, dims))
        else:
            raise ValueError("no polygon")
        if self.at != len(self.data):
            raise ValueError("more bytes than geometry")
        return parts


def _parse(data: bytes | None) -> list | None:
    try:
        return None if data is None else _Reader(bytes(data)).geometry()
    except (struct.error, ValueError, KeyError, IndexError):
        return None


def _nested(parsed: list[list | None]) -> pa.Array:
    """Geometries as nested lists: offsets of parts, rings and points over two columns of numbers."""
    parts = [part for g in parsed if g is not None for part in g]
    rings = [ring for part in parts for ring in part]
    points = np.concatenate([np.zeros((0, 2)), *rings])
    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))
    at = pa.StructArray.from_arrays([pa.array(points[:, 0].copy()), pa.array(points[:, 1].copy())], ["x", "y"])
    inner = pa.ListArray.from_arrays(offsets([len(p) for p in parts]), pa.ListArray.from_arrays(offsets([len(r) for r in rings]), at))
    return pa.ListArray.from_arrays(offsets([0 if g is None else len(g) for g in parsed]), inner, mask=pa.array([g is None for g in parsed], pa.bool_()))


def from_wkb(data: Column) -> Column:
    """Geometry of a WKB Polygon or MultiPolygon; null for other types, malformed bytes and broken rings."""

    @F.arrow_udf(GEOMETRY)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield _nested([_parse(d) for d in b.to_pylist()])

    return let(of(data), _valid)


def _written(geometries: pa.ListArray) -> list[bytes | None]:
    parts = geometries.values
    rings = parts.values
    points = np.stack([rings.values.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1).astype("<f8")
    by_geometry, by_part, by_ring = (a.offsets.to_numpy() for a in (geometries, parts, rings))

    def polygon(p: int) -> bytes:
        mine = range(by_part[p], by_part[p + 1])
        each = [struct.pack("<I", by_ring[r + 1] - by_ring[r]) + points[by_ring[r] : by_ring[r + 1]].tobytes() for r in mine]
        return struct.pack("<BII", 1, 3, len(mine)) + b"".join(each)

    out = []
    for i, there in enumerate(geometries.is_valid().to_pylist()):
        mine = [polygon(p) for p in range(by_geometry[i], by_geometry[i + 1])] if there else []
        out.append((mine[0] if len(mine) == 1 else struct.pack("<BII", 1, 6, len(mine)) + b"".join(mine)) if there else None)
    return out


def to_wkb(geometry: Column) -> Column:
    """Little-endian WKB: a Polygon for one part, else a MultiPolygon."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(_written(b), pa.binary())

    return of(geometry)


def explode_parts(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row a part, each again a geometry; rows without a geometry or parts stay, with null."""
    return df.withColumn(geometry, F.explode_outer(F.transform(F.col(geometry), lambda p: F.array(p))))


# --- measures ------------------------------------------------------------------------------------
def _twice(ring: Column) -> Column:
    """Twice the signed area of a ring: positive if it runs counter-clockwise."""
    ends = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(ends, F.lit(0.0), lambda s, v: s + v)


def oriented(geometry: Column) -> Column:
    """Outlines counter-clockwise and holes clockwise, whatever they were."""
    turn = lambda r, i: F.when((_twice(r) > 0) == (i == 0), r).otherwise(F.reverse(r))
    return F.transform(geometry, lambda part: F.transform(part, turn))


def area(geometry: Column) -> Column:
    """Outlines less holes."""
    sums = F.transform(F.flatten(F.transform(geometry, lambda part: F.transform(part, lambda r, i: F.abs(_twice(r)) * F.when(i == 0, 0.5).otherwise(-0.5)))), lambda v: v)
    return F.aggregate(sums, F.lit(0.0), lambda s, v: s + v)


def bounds(geometry: Column) -> Column:
    """Struct of x0, y0, x1, y1."""
    flat = F.flatten(F.flatten(geometry))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def edges(df: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """(keys, x0, y0, x1, y1): the edges of every ring, the inside on their left. Level edges are left out: they cover nothing."""
    rings = df.select(*keys, F.explode(F.flatten(oriented(F.col(geometry)))).alias("r"))
    ends = F.arrays_zip(F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))
    each = rings.select(*keys, F.explode(ends).alias("e"))
    return each.select(*keys, *[F.col(f"e.{p}.{c}").alias(f"{c}{i}") for i, p in enumerate("ab") for c in "xy"]).where("y0 <> y1")


# --- covering ------------------------------------------------------------------------------------
def _cuts(a: Column, b: Column, size: float) -> Column:
    """Numbers of the lattice intervals between two places."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.sequence(F.floor(lo / size), F.greatest(F.floor(lo / size), F.ceil(hi / size) - 1))


def pieces(edge: DataFrame, keys: list[str], size: float) -> DataFrame:
    """(keys, row, col, cover, part): for every cell that edges cross, their height, and the area of the cell left of them."""
    y = lambda t: F.col("y0") + (F.col("y1") - F.col("y0")) * t
    x = lambda t: F.col("x0") + (F.col("x1") - F.col("x0")) * t
    place = lambda at, c: (at - F.col(f"{c}0")) / F.nullif(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(0.0))
    within = lambda t, lo, hi: F.greatest(lo, F.least(hi, t))
    # First the rows of cells, then in each row the columns; t runs along the edge from 0 to 1.
    rows = edge.withColumn("row", F.explode(_cuts(F.col("y0"), F.col("y1"), size)))
    low, high = place(F.col("row") * size, "y"), place((F.col("row") + 1) * size, "y")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = rows.withColumns({"ta": within(F.least(low, high), zero, one), "tb": within(F.greatest(low, high), zero, one)})
    # Rows of cells are dealt before they become cells: one task may have read all polygons, and what follows goes by row too.
    rows = rows.repartition(*keys, "row")
    cells = rows.withColumn("col", F.explode(_cuts(x(F.col("ta")), x(F.col("tb")), size)))
    left, right = place(F.col("col") * size, "x"), place((F.col("col") + 1) * size, "x")
    upright = F.col("x0") == F.col("x1")
    sa = F.when(upright, F.col("ta")).otherwise(within(F.least(left, right), F.col("ta"), F.col("tb")))
    sb = F.when(upright, F.col("tb")).otherwise(within(F.greatest(left, right), F.col("ta"), F.col("tb")))
    cells = cells.withColumns({"sa": sa, "sb": sb})
    cells = cells.withColumns({"dy": y(F.col("sb")) - y(F.col("sa")), "mid": (x(F.col("sa")) + x(F.col("sb"))) / 2 - F.col("col") * size})
    return cells.groupBy(*keys, "row", "col").agg(F.sum("dy").alias("cover"), F.sum(F.col("mid") * F.col("dy")).alias("part"))


def covering(df: DataFrame, keys: list[str], size: float, geometry: str = "geometry") -> DataFrame:
    """(keys, row, lo, hi, area): runs of cells of a row, and the area that each cell of the run shares with the polygon.

    Cells that edges cross are runs of their own; cells between them that lie wholly inside are one
    run, however long. Parts of a geometry mustn't overlap, nor rings cross themselves.
    """
    along = Window.partitionBy(*keys, "row").orderBy(F.desc("col"))
    beyond = F.coalesce(F.sum("cover").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) * size
    known = pieces(edges(df, keys, geometry), keys, size).withColumns({"beyond": beyond, "next": F.lag("col").over(along)})
    own = F.struct(F.col("col").alias("lo"), F.col("col").alias("hi"), (F.col("part") + F.col("beyond")).alias("area"))
    gap = F.struct((F.col("col") + 1).alias("lo"), (F.col("next") - 1).alias("hi"), F.col("beyond").alias("area"))
    runs = known.select(*keys, "row", F.inline(F.array(own, gap)))
    return runs.where((F.col("lo") <= F.col("hi")) & (F.col("area") > TOUCH * size * size))


def _halves(lo: Column, hi: Column) -> Column:
    """A run of numbers as (level, number) of aligned blocks of 2^level: at most two a level, and more only at the last."""
    named = "array<struct<level:int,n:bigint>>"
    block = lambda level, n: F.array(F.struct(level.cast("int").alias("level"), n.alias("n"))).cast(named)
    empty = F.array().cast(named)

    def step(s: Column, level: Column) -> Column:
        open_ = s["lo"] <= s["hi"]
        odd, even = open_ & (F.pmod(s["lo"], F.lit(2)) == 1), open_ & (F.pmod(s["hi"], F.lit(2)) == 0)
        out = F.concat(s["out"], F.when(odd, block(level, s["lo"])).otherwise(empty), F.when(even, block(level, s["hi"])).otherwise(empty))
        half = lambda n: F.when(open_, F.floor(n / 2))
        lo, hi = half(s["lo"] + odd.cast("long")), half(s["hi"] - even.cast("long"))
        return F.struct(F.coalesce(lo, s["lo"]).alias("lo"), F.coalesce(hi, s["hi"]).alias("hi"), out.alias("out"))

    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), empty.alias("out"))

    def finish(s: Column) -> Column:
        rest = F.transform(F.sequence(s["lo"], s["hi"]), lambda n: F.struct(F.lit(LEVELS).alias("level"), n.alias("n"))).cast(named)
        return F.concat(s["out"], F.when(s["lo"] <= s["hi"], rest).otherwise(empty))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, finish)


def overlay_area(grid: DataFrame, polys: DataFrame, size: float = 100.0, pid: str = "pid", geometry: str = "geometry") -> DataFrame:
    """(filename, pid, area): tiles and polygons that share area, and how much.

    Tiles lie on a lattice of ``size``. Runs of whole tiles are joined by aligned blocks, level by
    level, so a country-sized polygon needs some rows for each row of tiles and no test inside.
    """
    named = F.floor(F.col("x1") / size).alias("col"), F.floor(F.col("y1") / size).alias("row")
    tiles = grid.select("filename", *named)
    runs = covering(polys, [pid], size, geometry)
    single = runs.where("lo = hi").select(pid, "row", F.col("lo").alias("col"), "area")
    near = tiles.join(single, ["row", "col"]).select("filename", pid, "area")
    wide = runs.where("lo < hi").select(pid, "row", "area", F.inline(_halves(F.col("lo"), F.col("hi"))))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    blocks = tiles.select("filename", "row", "col", level).withColumn("n", F.floor(F.col("col") / F.pow(F.lit(2.0), F.col("level"))))
    far = blocks.join(wide, ["row", "level", "n"]).select("filename", pid, "area")
    return near.unionByName(far)


# --- burning -------------------------------------------------------------------------------------
def burn_runs(polys: DataFrame, cell: float, simple: bool = False, pid: str = "pid", geometry: str = "geometry") -> DataFrame:
    """(row, lo, hi, cls): runs of lattice cells that polygons touch, with their class.

    Classes other than 1 and 2 are ignored, unless ``simple``, where any polygon gives 1.
    """
    wanted = polys.withColumn("cls", F.lit(1)) if simple else polys.where(F.col("ty").isin(1, 2)).withColumn("cls", F.col("ty"))
    return covering(wanted, [pid, "cls"], cell, geometry).select("row", "lo", "hi", "cls")


def rasterize_rings(cells: DataFrame, polys: DataFrame, cell: float = 5.0, simple: bool = False) -> DataFrame:
    """(filename, y, x, cls): class of every cell that polygons touch, the lowest where they overlap, 0 where none does."""
    runs = burn_runs(polys, cell, simple)
    hit = runs.select("row", F.explode(F.sequence("lo", "hi")).alias("col"), "cls").groupBy("row", "col").agg(F.min("cls").alias("cls"))
    keyed = cells.select("filename", "y", "x", F.floor(F.col("cx") / cell).alias("col"), F.floor(F.col("cy") / cell).alias("row"))
    # Burnt cells are as many as the cells, but Spark takes them for as few as the polygons and would broadcast them.
    return keyed.join(hit.hint("merge"), ["row", "col"], "left").select("filename", "y", "x", F.coalesce("cls", F.lit(0)).alias("cls"))


def burn_tiles(grid: DataFrame, polys: DataFrame, n: int, cell: float, simple: bool = False) -> DataFrame:
    """(filename, h, w, bands, data): a packed mask of n x n cells for every tile of the grid that polygons touch.

    Runs, not cells, are shuffled to their tiles; one group holds the runs of one tile.
    """
    runs = burn_runs(polys, cell, simple)
    over = F.explode(F.sequence(F.floor(F.col("lo") / n), F.floor(F.col("hi") / n)))
    split = runs.withColumn("tc", over).select(
        F.floor(F.col("row") / n).alias("tr"), "tc", (F.col("row") - F.floor(F.col("row") / n) * n).cast("int").alias("y"),
        F.greatest(F.col("lo") - F.col("tc") * n, F.lit(0)).cast("int").alias("x0"), F.least(F.col("hi") - F.col("tc") * n, F.lit(n - 1)).cast("int").alias("x1"), "cls",
    )
    split = split.distinct()  # runs that many polygons share come once
    tiles = grid.select("filename", F.floor(F.col("x1") / (n * cell)).alias("tc"), F.floor(F.col("y1") / (n * cell)).alias("tr"))

    def burn(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((n, n), np.uint8)
        for y, x0, x1, cls in pdf.sort_values("cls", ascending=False)[["y", "x0", "x1", "cls"]].itertuples(index=False):
            mask[y, x0 : x1 + 1] = cls  # the lowest class comes last
        return pd.DataFrame({"filename": [pdf["filename"].iat[0]], "h": [n], "w": [n], "bands": [1], "data": [mask.tobytes()]})

    return tiles.join(split.hint("merge"), ["tr", "tc"]).groupBy("filename").applyInPandas(burn, "filename string, h int, w int, bands int, data binary")
