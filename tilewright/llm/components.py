"""Connected components by alternating star steps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.lineage import cut, keep, scratch

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    pair = F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
    return down.join(least, "u").select(pair).where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars: every node points to one node, which points nowhere."""
    rows, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
    return rows == nodes and e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v); the root is the least node it reaches.

    Every round is written to the shared folder, and the files of the rounds before go; only its
    counts reach the driver. The number of rows never grows beyond that of the edges.
    """
    spark = edges.sparkSession
    with scratch(spark):
        now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        with scratch(spark):
            now = keep(_small_star(cut(_large_star(now), "large-star")), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
