"""Tile grid and ground-truth polygons: rings, spatial overlay by grid buckets, rasterizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_ring(grid: DataFrame) -> DataFrame:
    """(filename, i, px, py): the closed ring of each tile's box, five points."""
    corners = [("x1", "y1"), ("x1", "y2"), ("x2", "y2"), ("x2", "y1"), ("x1", "y1")]
    points = F.array(*[F.struct(F.col(a).alias("px"), F.col(b).alias("py")) for a, b in corners])
    return grid.select("filename", F.posexplode(points).alias("i", "p")).select("filename", "i", "p.px", "p.py")


def prepare_polygons(df: DataFrame, parts: str | None = None) -> DataFrame:
    """One row a part; ``Type`` or ``type`` becomes an int ``ty``, null where it isn't a number."""
    name = next(c for c in df.columns if c.lower() == "type")
    out = df.withColumnRenamed(name, "ty").withColumn("ty", F.expr("try_cast(ty as int)"))
    return out.withColumn(parts, F.explode(parts)) if parts else out


def _touches(cx: Column, cy: Column, cell: float) -> Column:
    """Whether a square cell and a rectangle, or the lower-left right triangle of it, share area."""
    box = (cx < F.col("x1")) & (cx + cell > F.col("x0")) & (cy < F.col("y1")) & (cy + cell > F.col("y0"))
    u = (F.greatest(cx, F.col("x0")) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    v = (F.greatest(cy, F.col("y0")) - F.col("y0")) / (F.col("y1") - F.col("y0"))
    return box & ((F.col("tri") == 0) | (u + v < 1))


def _buckets(polys: DataFrame, size: float) -> DataFrame:
    """A row for each square bucket that a polygon's box meets."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return polys.withColumn("bx", span("x0", "x1")).withColumn("by", span("y0", "y1"))


def overlay_pairs(grid: DataFrame, polys: DataFrame, size: float = 100.0) -> DataFrame:
    """(filename, pid): tiles and polygons that share area. An equi-join on buckets of the tile
    size, then the exact test; never all tiles against all polygons.
    """
    tiles = grid.withColumns({"tx1": F.col("x1"), "ty1": F.col("y1"), "bx": F.floor(F.col("x1") / size), "by": F.floor(F.col("y1") / size)})
    pairs = tiles.select("filename", "tx1", "ty1", "bx", "by").join(_buckets(polys, size), ["bx", "by"])
    return pairs.where(_touches(F.col("tx1"), F.col("ty1"), size)).select("filename", "pid").distinct()


def tiles_with_truth(grid: DataFrame, polys: DataFrame) -> DataFrame:
    return grid.join(overlay_pairs(grid, polys), "filename", "left_semi").select("filename")


def valid_tiles(grid: DataFrame, flags: DataFrame) -> DataFrame:
    """Tiles of the grid whose flag (filename, is_nodata) isn't set; tiles without a flag are kept."""
    marked = grid.join(flags, "filename", "left")
    return marked.where(~F.coalesce("is_nodata", F.lit(False))).drop("is_nodata")


def rasterize(cells: DataFrame, polys: DataFrame, cell: float = 5.0, simple: bool = False) -> DataFrame:
    """(filename, y, x, cls): class of every cell that polygons touch, the lowest id where they overlap.

    Classes other than 1 and 2 are ignored, unless ``simple``, where any polygon gives 1. Cells
    that none touches have class 0.
    """
    wanted = polys.withColumn("cls", F.lit(1)) if simple else polys.where(F.col("ty").isin(1, 2)).withColumn("cls", F.col("ty"))
    keyed = cells.select("filename", "y", "x", "cx", "cy", F.floor(F.col("cx") / cell).alias("bx"), F.floor(F.col("cy") / cell).alias("by")).alias("c")
    # A polygon has many buckets, but Spark takes them for as few as the polygons and would broadcast them.
    buckets = _buckets(wanted, cell).select("bx", "by", "x0", "y0", "x1", "y1", "tri", "cls").hint("merge").alias("p")
    touched = (F.col("c.bx") == F.col("p.bx")) & (F.col("c.by") == F.col("p.by")) & _touches(F.col("cx"), F.col("cy"), cell)
    # Grouping by bucket too leaves the cells where the join has put them.
    burned = keyed.join(buckets, touched, "left").groupBy("c.bx", "c.by", "filename", "y", "x").agg(F.coalesce(F.min("cls"), F.lit(0)).alias("cls"))
    return burned.select("filename", "y", "x", "cls")
