"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies each of its documents should have. The whole
part is taken outright; the fractional part is rounded by transfers between pairs: words move
from one document of a pair to the other, in a random direction that keeps every document's
expected copies, until one of the two is whole. The words of the pair stay the same, so a
source stays on its target. Pairs are formed in small groups; what is left
of each group is combined in the next level of a reduction tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.lineage import cut
from tilewright.functions.tables import small_table

#: Documents that are rounded together in one group of the tree, on average.
FAN_IN = 64
#: Documents of each group that go up unpaired besides the carried one, for choice at the root.
ASIDE = 2
#: At the root of the tree one row in so many closes the sum instead of being paired.
SPARE = 4
#: The table of sources has a row each and goes to the driver for the shares.
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: dict, weights: Sequence[float], most: float = 3.0) -> dict:
    """Target words by source: shares of all words by weight, none above ``most`` of its size.

    Sources go by code point, null last, and take the weights in turn. What a source can't
    take is shared again by weight among the others, until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total = float(sum(sizes.values()))
    capped: dict = {}
    while True:
        free = [s for s in names if s not in capped]
        rest, parts = total - sum(capped.values()), sum(weight[s] for s in free)
        target = capped | {s: rest * weight[s] / parts for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= {s: most * sizes[s] for s in over}


def _merge(acc: Column, e: Column) -> Column:
    """One transfer between the carried document and the next one; the whole one is put out."""
    c = acc["carry"]
    gain = F.least((1 - c["x"]) * c["size"], e["x"] * e["size"])
    loss = F.least(c["x"] * c["size"], (1 - e["x"]) * e["size"])
    up = e["u"] * (gain + loss) < loss
    c_full = (1 - c["x"]) * c["size"] <= e["x"] * e["size"]
    c_empty = c["x"] * c["size"] <= (1 - e["x"]) * e["size"]

    def at(d: Column, x: Column) -> Column:
        return F.struct(d["key"].alias("key"), d["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).alias("x"), d["u"].alias("u"))

    c_done = (up & c_full) | (~up & c_empty)
    c_at = F.when(up, F.when(c_full, F.lit(1.0)).otherwise(c["x"] + gain / c["size"])).otherwise(F.when(c_empty, F.lit(0.0)).otherwise(c["x"] - loss / c["size"]))
    e_at = F.when(up, F.when(c_full, e["x"] - gain / e["size"]).otherwise(F.lit(0.0))).otherwise(F.when(c_empty, e["x"] + loss / e["size"]).otherwise(F.lit(1.0)))
    done = F.when(c_done, at(c, c_at)).otherwise(at(e, e_at))
    carry = F.when(c_done, at(e, e_at)).otherwise(at(c, c_at))
    return F.struct(carry.alias("carry"), F.concat(acc["done"], F.array(done)).alias("done"))


def _fold(es: Column) -> Column:
    """Carry one document through the others: its last state, and the whole ones."""
    return F.aggregate(F.slice(es, F.lit(2), F.size(es)), F.struct(F.element_at(es, 1).alias("carry"), F.slice(es, 1, 0).alias("done")), _merge)


def _close(acc: Column, p: Column) -> Column:
    """Round to the side that brings the words missed so far nearer to none."""
    e = p["e"]
    more, less = acc["miss"] + (1 - e["x"]) * e["size"], acc["miss"] - e["x"] * e["size"]
    up = F.abs(more) < F.abs(less)
    done = F.struct(e["key"].alias("key"), e["size"].alias("size"), up.cast("double").alias("x"), e["u"].alias("u"))
    return F.struct(F.when(up, more).otherwise(less).alias("miss"), F.concat(acc["done"], F.array(done)).alias("done"))


def pivotal_round(parts: DataFrame, seed: int = 42, fan_in: int = FAN_IN) -> DataFrame:
    """Round ``x`` of every row of (stratum, key, size, x in (0, 1)) to 0 or 1: (key, x int).

    ``key`` must be unique and holds what names the row. Sizes are positive. Transfers keep each
    stratum's sum of size * x. At the root of its tree, one row in SPARE is spared from them,
    and these few and the last carried row are rounded, large ones first, to the side that
    leaves the sum nearest. Groups come from a hash of the key, so reruns agree.
    """
    counts = parts.groupBy("stratum").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-counts // fan_in))
    seeded = parts.select(
        "stratum",
        F.struct("key", F.col("size").cast("double").alias("size"), F.col("x").cast("double").alias("x"),
                 (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("u")).alias("e"),
        F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(groups)).alias("group"),
    )
    level, out = seeded, None
    while groups > 1:
        # The order in a group is that of the random numbers, which differ by key.
        gathered = level.groupBy("stratum", "group").agg(F.collect_list(F.struct(F.col("e.u").alias("u"), "e")).alias("es"))
        es = F.transform(F.array_sort("es"), lambda p: p["e"])
        split = gathered.select("stratum", "group", F.slice(es, 1, ASIDE).alias("aside"), F.slice(es, ASIDE + 1, F.size(es)).alias("paired"))
        split = split.withColumn("f", F.when(F.size("paired") > 0, _fold(F.col("paired"))))
        rest = F.when(F.size("paired") > 0, F.concat("aside", F.array("f.carry"))).otherwise(F.col("aside"))
        step = cut(split.select("stratum", "group", rest.alias("rest"), F.col("f.done").alias("done")), "mix-level")
        done = step.select("stratum", F.explode("done").alias("e"))
        out = done if out is None else out.unionByName(done)
        groups = -(-groups * (ASIDE + 1) // fan_in)
        level = step.select("stratum", F.explode("rest").alias("e"), F.floor(F.col("group") * (ASIDE + 1) / fan_in).alias("group"))
    gathered = level.groupBy("stratum").agg(F.collect_list(F.struct(F.col("e.size").alias("size"), F.col("e.u").alias("u"), "e")).alias("es"))
    es = F.transform(F.reverse(F.array_sort("es")), lambda p: p["e"])
    top = gathered.select("stratum", F.filter(es, lambda _, i: i % SPARE == 0).alias("spare"), F.filter(es, lambda _, i: i % SPARE != 0).alias("paired"))
    top = top.withColumn("f", F.when(F.size("paired") > 0, _fold(F.col("paired"))))
    rest = F.when(F.size("paired") > 0, F.concat("spare", F.array("f.carry"))).otherwise(F.col("spare"))
    rest = F.reverse(F.array_sort(F.transform(rest, lambda e: F.struct(e["size"].alias("size"), e.alias("e")))))
    closed = F.aggregate(rest, F.struct(F.lit(0.0).alias("miss"), F.transform(F.slice(rest, 1, 0), lambda p: p["e"]).alias("done")), _close)["done"]
    ends = F.when(F.size("paired") > 0, F.concat("f.done", closed)).otherwise(closed)
    ends = top.select("stratum", F.explode(ends).alias("e"))
    out = ends if out is None else out.unionByName(ends)
    return out.select("stratum", F.col("e.key").alias("key"), F.col("e.x").cast("int").alias("x"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of every distinct row: ``doc_id, source, h, m, size, source_size, target, copies``.

    ``h`` is a hash of the text and ``m`` the number of identical rows that are copied so often;
    where one more copy falls on a part of them there are two rows. Null texts have size 0 and
    null sources are a source of their own, the last. Rows of size 0 are copied once. An empty
    table gives an empty plan. More than MAX_SOURCES sources are an error.
    """
    together = _together(docs, F.xxhash64(F.col(text_col)), weights, most, seed, id_col, text_col, source_col)
    each, more = F.floor(F.col("copies") / F.col("m")), F.col("copies") % F.col("m")
    parts = F.array(F.struct(more.alias("m"), (each + 1).cast("int").alias("copies")), F.struct((F.col("m") - more).alias("m"), each.cast("int").alias("copies")))
    return together.select("doc_id", "source", "h", "size", "source_size", "target", F.inline(parts)).where("m > 0")


def _together(docs: DataFrame, h: Column, weights: Sequence[float], most: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row for each set of ``m`` rows with equal id, source and ``h``, with the ``copies`` that all of them have together."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), h.alias("h"), word_count(F.col(text_col)).alias("size")
    )
    rows = cut(rows.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("m")), "mix-rows")
    stats = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: int(r["size"]) for r in stats}
    target = shares(sizes, weights, float(most)) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    listed = [{"s": s, "source_size": sizes[s], "target": target[s], "rate": target[s] / sizes[s] if sizes[s] else 0.0} for s in sizes]
    table = small_table(docs.sparkSession, listed, "s:string,source_size:bigint,target:double,rate:double")
    kind = rows.schema["source"].dataType
    rows = rows.join(F.broadcast(table.withColumn("s", F.col("s").cast(kind))), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # All identical rows together: the whole copies, and one more with the chance of the rest.
    copies = F.when(F.col("size") > 0, F.col("rate") * F.col("m")).otherwise(F.col("m").cast("double"))
    rows = rows.withColumn("whole", F.floor(copies + 1e-12)).withColumn("x", copies - F.col("whole"))
    open_ = (F.col("size") > 0) & (F.col("x") > 1e-12)
    names = ["doc_id", "source", "h", "m", "size", "source_size", "target", "whole"]
    parts = rows.where(open_).select(F.col("source").alias("stratum"), F.struct(*names).alias("key"), "size", "x")
    rounded = pivotal_round(parts, seed).select("key.*", F.col("x").alias("extra"))
    settled = rows.where(~open_).select(*names, F.lit(0).alias("extra"))
    return settled.unionByName(rounded).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int")).drop("whole", "extra")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 42) -> DataFrame:
    """The mixed rows with all their columns: each row as many times as the plan has copies of it.

    Rows count as identical if all their columns are equal. Null texts have size 0 and are taken once;
    null sources are a source of their own. An empty table gives none. Columns may have any names:
    those of the plan have a prefix that no column of the rows begins with.
    """
    pre = "__"
    while any(c.startswith(pre) for c in docs.columns):
        pre += "_"
    name = lambda c: F.col(f"{pre}{c}")
    same_row = F.xxhash64(*[F.col(c) for c in docs.columns])
    keyed = docs.withColumn(f"{pre}row", same_row)
    plan = _together(docs, same_row, weights, most, seed, "doc_id", "text", "source").where("copies > 0")
    plan = plan.select(*[F.col(c).alias(f"{pre}{c}") for c in ("doc_id", "source", "h", "m")], F.sequence(F.lit(1), F.col("copies")).alias(f"{pre}copies"))
    same = keyed["doc_id"].eqNullSafe(name("doc_id")) & keyed["source"].eqNullSafe(name("source")) & (name("row") == name("h"))
    taken = keyed.join(plan.where(name("m") == 1), same)
    repeated = plan.where(name("m") > 1)
    if not repeated.isEmpty():
        taken = taken.unionByName(keyed.join(repeated, same).dropDuplicates([f"{pre}{c}" for c in ("row", "doc_id", "source")]))
    return taken.withColumn(f"{pre}copy", F.explode(name("copies"))).select(*[F.col(c) for c in docs.columns])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    plan = plan_mix(docs)
    each = plan.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
