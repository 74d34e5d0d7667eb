"""Band statistics, class counts, areas and shares of forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.packed import deviation
from tilewright.operators.raster import blocks, sub_of

#: Metres of a pixel along each axis.
PIXEL_X, PIXEL_Y = 0.200022269188281, 0.200022454940277


def band_stats(px: DataFrame, n: int, d: int, compat: bool = False, bands: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """(band, mean, std, cnt) over the subtiles that vary in band 1, of complete tiles with data.

    One scan: a row for each subtile with the means and mean squares of all bands, a row for each
    tile with its extent and sums, then the sums of all tiles. ``compat`` divides by one more than the count.
    """
    v, of = F.col("v") / 255.0, lambda b, c: F.when(F.col("band") == b, c)
    place = px.select("img", "band", "v", sub_of(n, d).alias("sub"), "y", "x")
    each = [f(of(b, v)).alias(f"{c}{b}") for b in bands for c, f in (("m", F.avg), ("q", lambda c: F.avg(c * c)))]
    per = place.groupBy("img", "sub").agg(
        *each, (F.min(of(1, F.col("v"))) < F.max(of(1, F.col("v")))).alias("varies"), F.max("y").alias("y"), F.max("x").alias("x"), F.bool_and(F.col("v").isin(0, 255)).alias("blank")
    )
    counted = lambda c: F.when(F.col("varies"), F.col(c))
    sums = [f(counted(f"{c}{b}")).alias(f"{name}{b}") for b in bands for name, c, f in (("s", "m", F.sum), ("t", "q", F.sum), ("c", "m", F.count))]
    tile = per.groupBy("img").agg(*sums, (F.max("y") == F.max("x")).alias("complete"), F.bool_and("blank").alias("blank")).where("complete and not blank")
    total = tile.agg(*[F.sum(f"{c}{b}").alias(f"{c}{b}") for b in bands for c in "stc"])
    rows = [F.struct(F.lit(b).alias("band"), *[F.col(f"{c}{b}").alias(name) for c, name in zip("stc", ("s1", "s2", "cnt"), strict=True)]) for b in bands]
    return deviation(total.select(F.inline(F.array(*rows))).where("cnt > 0"), compat)


def stats_report(stats: DataFrame, sources: Sequence[str] = (), frac: float = 1.0) -> DataFrame:
    """(report): JSON of the sources, the date, the share of tiles, the number of subtiles and the results by band."""
    entry = F.struct(F.col("band").cast("string").alias("k"), F.struct(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")).alias("v"))
    results = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return stats.agg(F.to_json(F.struct(F.array(*map(F.lit, sources)).cast("array<string>").alias("sources"), F.current_timestamp().cast("string").alias("date"), F.lit(frac).alias("frac"), F.max("cnt").alias("subtiles"), results.alias("results"))).alias("report"))


def subtile_frac(mask: DataFrame, n: int, d: int) -> DataFrame:
    """(img, sub, n_pos, frac): positive pixels of each subtile, and their percentage to 2 decimals."""
    got = blocks(mask, n, d).groupBy("img", "sub").agg(F.count_if(F.col("cls") != 0).alias("n_pos"))
    return got.withColumn("frac", F.round(F.col("n_pos") * 100.0 / (d * d), 2))


def positive(fracs: DataFrame, compat: bool = False) -> DataFrame:
    """Subtiles with positive pixels; ``compat`` asks the rounded percentage instead of the count."""
    return fracs.where("frac > 0" if compat else "n_pos > 0")


def class_counts(pred: DataFrame, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(yr, img, cl_<k>..., total): pixels of each class by tile and year, and all with a class."""
    counts = [F.count_if(F.col("cls") == k).alias(f"cl_{k}") for k in classes]
    return pred.groupBy("yr", "img").agg(*counts, F.count("cls").alias("total"))


def area_by_year(pred: DataFrame, years: Sequence[int]) -> DataFrame:
    """(img, total, deadarea_m2_<year>...): area of classes 1 and 2 by year; nulls for years without the tile."""
    counts = class_counts(pred)
    area = F.bround((F.col("cl_1") + F.col("cl_2")) * PIXEL_X * PIXEL_Y, 1)
    wide = [F.max(F.when(F.col("yr") == y, area)).alias(f"deadarea_m2_{y}") for y in years]
    return counts.groupBy("img").agg(F.max(F.when(F.col("yr") == years[0], F.col("total"))).alias("total"), *wide)


def require_years(df: DataFrame, years: Sequence[int]) -> DataFrame:
    """The rows of these years; a year without rows is an error."""
    found = {r[0] for r in df.where(F.col("yr").isin(list(years))).select("yr").distinct().collect()}
    if missing := sorted(set(years) - found):
        raise ValueError(f"no rows for {missing}")
    return df.where(F.col("yr").isin(list(years)))


def forest_share(pred: DataFrame, forest: DataFrame, pixels: int, limit: float = 10.0, compat: bool = False) -> DataFrame:
    """(yr, img, conifer, broadleaf, total): percent of the forest in class 1, in class 2 and in both.

    Null below ``limit`` percent of forest. ``compat`` sums class values, so class 2 counts double.
    """
    both = pred.join(forest, ["img", "y", "x"])
    inside = F.col("forest") == 1
    part = lambda k: F.sum(F.when((F.col("cls") == k) & inside, k if compat else 1).otherwise(0))
    sums = both.groupBy("yr", "img").agg(part(1).alias("a"), part(2).alias("b"), F.sum("forest").alias("f"))
    share = lambda c: F.when(F.col("f") * 100.0 / pixels >= limit, c * 100.0 / F.col("f"))
    return sums.select("yr", "img", share(F.col("a")).alias("conifer"), share(F.col("b")).alias("broadleaf"), share(F.col("a") + F.col("b")).alias("total"))


def require_predictions(pred: DataFrame, forest: DataFrame) -> DataFrame:
    """The predictions; a tile with land use but without a prediction is an error."""
    lost = forest.select("img").distinct().join(pred.select("img").distinct(), "img", "left_anti").orderBy("img").limit(5).collect()
    if lost:
        raise ValueError(f"no prediction for tiles {[r['img'] for r in lost]}")
    return pred


def pred_fraction(pred: DataFrame, mode: str = "nonzero") -> DataFrame:
    """(yr, img, fraction): share of pixels with a class, or the sum of classes over the pixels (``sum``)."""
    value: Column = F.sum("cls") / F.count("*") if mode == "sum" else F.avg((F.col("cls") != 0).cast("int"))
    return pred.groupBy("yr", "img").agg(value.alias("fraction"))


def usage(events: DataFrame, stage: str, file: str) -> DataFrame:
    """How often each sample was used in each stage."""
    return events.groupBy(stage, file).agg(F.count("*").alias("uses"))
