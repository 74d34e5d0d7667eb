"""Raster operators on pixel tables (img, band, y, x, v): one row a pixel and band.

Everything here is relational, so that Catalyst sees it; ``packed`` holds the same reshaping
on tiles as bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means and deviations of the bands that pixels are normalized with (red, green, blue; near infrared as red).
IMAGENET = {1: (0.485, 0.229), 2: (0.456, 0.224), 3: (0.406, 0.225), 4: (0.485, 0.229)}


def select_bands(px: DataFrame, k: int) -> DataFrame:
    return px.where(F.col("band") <= k)


def nodata(px: DataFrame, bands: str = "first") -> DataFrame:
    """(img, is_nodata): whether a tile's first band, or all of them, hold only 0 and 255."""
    rows = px if bands == "all" else px.where("band = 1")
    return rows.groupBy("img").agg(F.bool_and(F.col("v").isin(0, 255)).alias("is_nodata"))


def drop_nodata(px: DataFrame, bands: str = "first") -> DataFrame:
    return px.join(nodata(px, bands).where("is_nodata"), "img", "left_anti")


def sub_of(n: int, d: int) -> Column:
    """Row-major number of the d x d block of a pixel in a tile of n x n."""
    return (F.floor(F.col("y") / d) * (n // d) + F.floor(F.col("x") / d)).cast("int")


def blocks(px: DataFrame, n: int, d: int) -> DataFrame:
    """Cut tiles into blocks: ``sub`` and the place inside it; all bands stay together."""
    return px.withColumn("sub", sub_of(n, d)).withColumns({"y": (F.col("y") % d).cast("int"), "x": (F.col("x") % d).cast("int")})


def assemble(subs: DataFrame, n: int, d: int) -> DataFrame:
    """The inverse of ``blocks``."""
    k = n // d
    y = (F.floor(F.col("sub") / k) * d + F.col("y")).cast("int")
    return subs.withColumns({"y": y, "x": ((F.col("sub") % k) * d + F.col("x")).cast("int")}).drop("sub")


def variation(px: DataFrame, n: int, d: int, bands: Sequence[int] | None = None) -> DataFrame:
    """(img, sub) of the blocks that are not constant over the given bands, or over all together."""
    rows = px.where(F.col("band").isin(list(bands))) if bands else px
    return blocks(rows, n, d).groupBy("img", "sub").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("img", "sub")


def sizes(px: DataFrame) -> DataFrame:
    """(img, h, w): extent of each tile."""
    return px.groupBy("img").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def complete_only(px: DataFrame) -> DataFrame:
    """(img) of the square tiles."""
    return sizes(px).where("h = w").select("img")


def grid_of(px: DataFrame, tile_shape: tuple[int, int], sub_shape: tuple[int, int]) -> DataFrame:
    """(img, h, w, ny, nx): extent and number of subtiles that cover it along each axis."""
    d = sub_shape[0]
    if d != sub_shape[1] or tile_shape[0] % d or tile_shape[1] % d:
        raise ValueError(f"subtiles {sub_shape} must be square and divide the tile {tile_shape}")
    up = lambda c: F.ceil(F.col(c) / d).cast("int")
    return sizes(px).withColumns({"ny": up("h"), "nx": up("w")})


def pad(px: DataFrame, dim: int) -> DataFrame:
    """Zero-pad every band of every tile to dim x dim, the data at the top left."""
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(dim - 1)))
    full = px.select("img", "band").distinct().withColumn("y", axis()).withColumn("x", axis())
    return full.join(px, ["img", "band", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def needed(px: DataFrame, n: int, d: int) -> DataFrame:
    """(img, sub) of the subtiles inside the tile's rounded-up extent."""
    k = n // d
    subs = grid_of(px, (n, n), (d, d)).withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))))
    return subs.where((F.floor(F.col("sub") / k) < F.col("ny")) & (F.col("sub") % k < F.col("nx"))).select("img", "sub")


def crop(padded: DataFrame, size: DataFrame) -> DataFrame:
    """Cut padded tiles back to their extents (img, h, w)."""
    return padded.join(size, "img").where("y < h and x < w").drop("h", "w")


def retile(world: DataFrame, dim: int) -> DataFrame:
    """(gy, gx, band, v) into tiles of dim: (row, col, band, y, x, v)."""
    part = lambda c: F.floor(F.col(c) / dim).cast("int")
    rest = lambda c: (F.col(c) % dim).cast("int")
    return world.select(part("gy").alias("row"), part("gx").alias("col"), "band", rest("gy").alias("y"), rest("gx").alias("x"), "v")


def mosaic(tiles: DataFrame, step: int, order: str) -> DataFrame:
    """Tiles at (row, col) back to one raster; where tiles overlap the last in ``order`` wins."""
    gy, gx = (F.col("row") * step + F.col("y")).alias("gy"), (F.col("col") * step + F.col("x")).alias("gx")
    return tiles.groupBy(gy, gx, "band").agg(F.max_by("v", order).alias("v"))


def stack_bands(rgb: DataFrame, nir: DataFrame) -> DataFrame:
    """Bands 1 to 3 of one source and band 1 of another as band 4, where both have the tile."""
    both = rgb.select("img").distinct().join(nir.select("img").distinct(), "img", "left_semi")
    rows = rgb.where("band <= 3").unionByName(nir.where("band = 1").withColumn("band", F.lit(4)))
    return rows.join(both, "img", "left_semi")


def clip_extent(world: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return world.where(F.col("gx").between(x0, x1 - 1) & F.col("gy").between(y0, y1 - 1))


def resample_avg(world: DataFrame, f: int) -> DataFrame:
    """Average over f x f pixels, rounded half to even."""
    part = lambda c: F.floor(F.col(c) / f).alias(c)
    return world.groupBy(part("gy"), part("gx"), "band").agg(F.bround(F.avg("v")).cast("int").alias("v"))


def _by_band(stats: dict, k: int) -> Column:
    out = F.lit(None).cast("double")
    for band, s in stats.items():
        out = F.when(F.col("band") == band, F.lit(float(s[k]))).otherwise(out)
    return out


def normalize(px: DataFrame, stats: dict = IMAGENET) -> DataFrame:
    return px.withColumn("v", (F.col("v") / 255.0 - _by_band(stats, 0)) / _by_band(stats, 1))


def denormalize(px: DataFrame, stats: dict = IMAGENET) -> DataFrame:
    """Back to bytes by truncation, first three bands."""
    value = (F.col("v") * _by_band(stats, 1) + _by_band(stats, 0)) * 255.0
    return px.where("band <= 3").withColumn("v", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value + 1e-9))).cast("int"))


def collapse(mask: DataFrame, classes: int) -> DataFrame:
    return mask.withColumn("cls", F.least(F.col("cls"), F.lit(classes - 1)))


def augment(px: DataFrame, n: int, seed: int, epoch: int = 0) -> DataFrame:
    """Flip, turn and shift brightness and contrast, by hashes of the tile.

    One of the two flips with chance one half, none to three quarter turns with chance one half,
    and an intensity change of band values with chance one half. Tables without ``v`` (masks, land use) get the
    same moves and no intensity change, so they stay aligned.
    """
    unit = lambda k: F.pmod(F.xxhash64("img", F.lit(seed), F.lit(epoch), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    flip, turn = F.when(unit(0) < 0.5, F.when(unit(1) < 0.5, "h").otherwise("v")).otherwise("n"), F.when(unit(2) < 0.5, F.floor(unit(6) * 4).cast("int")).otherwise(0)
    out = flip_rot(px.withColumns({"__f": flip, "__t": turn}), n)
    if "v" in px.columns:
        changed = unit(3) < 0.5
        out = intensity(out, F.when(changed, 1 + (unit(4) - 0.5) * 0.3).otherwise(1.0), F.when(changed, (unit(5) - 0.5) * 0.4).otherwise(0.0))
    return out


def intensity(px: DataFrame, gain: Column, shift: Column) -> DataFrame:
    """Values times ``gain`` plus ``shift`` of the tile's mean value, cut to bytes: contrast and brightness."""
    mean = px.groupBy("img").agg(F.avg("v").alias("__m"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("v") * gain + shift * F.col("__m")))
    return px.join(mean, "img").withColumn("v", F.floor(value + 1e-9).cast("int")).drop("__m")


def flip_rot(px: DataFrame, n: int, flip: str = "__f", turn: str = "__t") -> DataFrame:
    """Mirror (h or v, else not) and then turn by ``turn`` (0 to 3) times 90 degrees counter-clockwise."""
    y = F.when(F.col(flip) == "v", n - 1 - F.col("y")).otherwise(F.col("y"))
    x = F.when(F.col(flip) == "h", n - 1 - F.col("x")).otherwise(F.col("x"))
    out = px.withColumns({"__y": y, "__x": x})
    to, back_y, back_x = F.col(turn), n - 1 - F.col("__y"), n - 1 - F.col("__x")
    moved = {
        "y": F.when(to == 1, back_x).when(to == 2, back_y).when(to == 3, F.col("__x")).otherwise(F.col("__y")),
        "x": F.when(to == 1, F.col("__y")).when(to == 2, back_x).when(to == 3, back_y).otherwise(F.col("__x")),
    }
    return out.withColumns(moved).drop("__y", "__x", flip, turn)


def one_hot(mask: DataFrame, k: int) -> DataFrame:
    """One row a class with ``hot`` 0 or 1; a class outside 0..k-1 is an error."""
    ok = F.when(F.col("cls").between(0, k - 1), F.col("cls")).otherwise(F.raise_error(F.lit("class out of range")).cast("int"))
    planes = mask.withColumn("cls", ok).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return planes.withColumn("hot", (F.col("cls") == F.col("k")).cast("int")).drop("cls")


def argmax(scores: Column) -> Column:
    """Number of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def distance_map(mask: DataFrame, k: int) -> DataFrame:
    """Signed distance of every pixel to each class: outside to the nearest pixel of the class,
    inside minus the distance to the nearest other pixel, plus one. Absent class: 0; a class
    that fills its tile has no outside: null. Meant for small tiles; see ``packed`` for large ones.
    """
    hot = one_hot(mask, k)
    other = hot.select("img", "k", F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("hot").alias("oh"))
    pairs = hot.join(other, ["img", "k"])
    square = (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) + (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox"))
    near = pairs.groupBy("img", "k", "y", "x", "hot").agg(F.min(F.when(F.col("oh") != F.col("hot"), square)).alias("s"), F.max("oh").alias("any"))
    dist = F.sqrt(F.col("s").cast("double"))
    return near.select("img", "k", "y", "x", F.when(F.col("any") == 0, 0.0).when(F.col("hot") == 1, 1 - dist).otherwise(dist).alias("dist"))


def preview(mask: DataFrame) -> DataFrame:
    return mask.withColumn("v", (F.col("cls") * 255 % 256).cast("int")).drop("cls")
