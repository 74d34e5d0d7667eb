"""Sharding by balanced label propagation.

Documents are linked where their texts are equal. Every document starts in a shard drawn by
its hash; Spark joins then carry the shards of a document's neighbours to it, and it moves to
the one where most of their bytes are, as far as the target's quota admits; what is still apart
at the end joins its largest part, so no link is cut within a unit. Last passes make the sizes
even: what exceeds the mean in a shard, documents without links and small ones first and units
always whole, fills the gaps of the others in one running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.lineage import cut
from tilewright.functions.ordering import bucket_count, range_bucket, with_running_sum

#: Linked documents of more than this share of a shard are split into units of about this size.
UNIT_SHARE = 1 / 8
#: How far a shard may exceed the mean while labels move.
SLACK = 0.2
MAX_SHARDS = 10_000


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) from the hash of the columns: the same in every rerun."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _pick(cumulative: list[float], at: Column) -> Column:
    """Index of the first cumulative value above ``at`` (the list has one entry a shard), by binary search."""
    return F.least(range_bucket([at.cast("double")], [F.struct(F.lit(float(x)).alias("k0")) for x in cumulative]), F.lit(len(cumulative) - 1))


def _load(blocks: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["b"] for r in blocks.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    return [int(got.get(s, 0)) for s in range(shards)]


def propagate(blocks: DataFrame, shards: int, rounds: int = 6) -> DataFrame:
    """Move ``blocks`` (unit, origin, shard, bytes, rows) towards the shards of their units.

    One row a shard goes to the driver each round for the quotas. Ends when no block is apart
    from its unit's largest part; after ``rounds`` those that are go there whatever the quota is.
    """
    total = sum(_load(blocks, shards))
    cap = total / shards * (1 + SLACK)
    for number in range(rounds):
        votes = blocks.groupBy("unit", "shard").agg(F.sum("bytes").alias("w"))
        wish = votes.groupBy("unit").agg(F.max_by("shard", F.struct("w", -F.col("shard"))).alias("wish"))
        asked = cut(blocks.join(wish, "unit"), "shard-wishes")
        apart = asked.where("wish <> shard")
        into, out = _load(apart.select(F.col("wish").alias("shard"), "bytes"), shards), _load(apart, shards)
        if not any(into):
            return blocks
        load = _load(asked, shards)
        admit = [min(1.0, max(0.0, cap - load[s]) / max(into[s] - out[s], 1)) if into[s] > out[s] else 1.0 for s in range(shards)]
        table = F.array(*[F.lit(a) for a in admit])
        go = _uniform(F.col("unit"), F.lit(number)) < F.element_at(table, F.col("wish") + 1)
        blocks = asked.withColumn("shard", F.when(go | F.lit(number == rounds - 1), F.col("wish")).otherwise(F.col("shard"))).drop("wish")
    return cut(blocks, "shard-blocks")


def even_out(blocks: DataFrame, shards: int) -> DataFrame:
    """Move what exceeds the mean size of a shard into the gaps of the others.

    Blocks of one document and small ones move first, so that few links are cut and the sizes
    end within about a small document of the mean.
    """
    load = _load(blocks, shards)
    mean = sum(load) / shards
    order = [F.col("shard"), (F.col("rows") == 1).cast("int"), -F.col("bytes"), F.col("unit"), F.col("origin")]
    run = with_running_sum(blocks, order, F.col("bytes"), "before")
    starts = [sum(load[:s]) for s in range(shards)]
    within = F.col("before") - F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard") + 1)
    run = cut(run.withColumn("moves", within + F.col("bytes") / 2 > F.lit(mean)), "shard-running")
    movers = run.where("moves").drop("before")
    kept = {r["shard"]: r["b"] for r in run.where("not moves").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    gaps = [max(0.0, mean - kept.get(s, 0)) for s in range(shards)]
    cumulative = [sum(gaps[: s + 1]) for s in range(shards)]
    placed = with_running_sum(movers, [-F.col("bytes"), F.col("unit"), F.col("origin")], F.col("bytes"), "before")
    middle = F.col("before") + F.col("bytes") / 2
    placed = placed.withColumn("shard", _pick(cumulative, middle)).drop("before")
    return run.where("not moves").drop("before", "moves").unionByName(placed.drop("moves"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``law`` is ``bytes``: the shards' sizes are near equal. Size is the UTF-8 length of the text
    plus 8; a null text counts as empty and is linked to empty texts. Null ids are ordinary
    ids. Identical rows are placed together unless they exceed a unit, every one with its own
    slot. Slots run from 0 in each shard. An empty table gives an empty result; other columns
    of the input are not read. Of a text only its length and hashes are used, whatever its length.
    """
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"shards must be in 1..{MAX_SHARDS}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(1)).alias("g"),
    )
    rows = cut(rows.groupBy("doc_id", "size", "text_crc32", "g").agg(F.count("*").alias("m")), "shard-rows")
    total = rows.agg(F.sum(F.col("size") * F.col("m"))).first()[0] or 0
    unit = max(1.0, total / shards * UNIT_SHARE)
    # At most shards / UNIT_SHARE groups can be above the unit, whatever the number of rows.
    weight = rows.groupBy("g").agg(F.sum(F.col("size") * F.col("m")).alias("b"))
    large = weight.where(F.col("b") > unit).select("g", F.ceil(F.col("b") / unit).cast("int").alias("k"))
    pieces = F.ceil(F.col("size") * F.col("m") / F.lit(unit)).cast("int")
    pieces = F.least(F.greatest(pieces, F.lit(1)), F.col("m").cast("int"))
    rows = (
        rows.withColumn("pieces", pieces)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("m", F.floor(F.col("m") * (F.col("piece") + 1) / F.col("pieces")) - F.floor(F.col("m") * F.col("piece") / F.col("pieces")))
        .drop("pieces")
        .join(F.broadcast(large), "g", "left")
        .withColumn("own", F.xxhash64("doc_id", "g", "piece"))
        .withColumn("unit", F.when(F.col("k").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.pmod("own", "k"))))
        .withColumn("origin", F.pmod(F.xxhash64("own", F.lit(2)), F.lit(shards)).cast("int"))
        .drop("k")
    )
    rows = cut(rows, "shard-units")
    blocks = rows.groupBy("unit", "origin").agg(F.sum(F.col("size") * F.col("m")).alias("bytes"), F.count("*").alias("rows"))
    blocks = cut(blocks.withColumn("shard", F.col("origin")), "shard-blocks")
    # A block of one document whose unit has others is linked, so it must not move first.
    blocks = propagate(blocks, shards)
    alone = blocks.groupBy("unit", "shard").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.collect_set("origin").alias("origins"))
    placed = even_out(alone.withColumn("origin", F.col("shard")), shards)
    # Large units may have left the gaps uneven; what moves now are the documents without links.
    placed = even_out(cut(placed, "shard-even"), shards)
    placed = placed.select("unit", F.explode("origins").alias("origin"), "shard")
    out = cut(rows.join(placed, ["unit", "origin"]).drop("unit", "origin"), "shard-placed")
    return _slots(out, shards)


def cut_links(placed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(links, cut): links of a star on each group of equal texts, and those of them that lead to another shard than the group's main one.

    ``placed`` is the result of ``shard_documents`` for ``docs`` with distinct ids.
    """
    text = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("g"))
    parts = placed.join(text, placed["doc_id"] == text["__id"]).groupBy("g", "shard").agg(F.count("*").alias("n"))
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    """Number the rows of each shard from 0, in ranges of hashes that are numbered in parallel."""
    buckets = bucket_count(rows)
    bucket = F.pmod(F.xxhash64("own", F.lit(3)), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy("shard", "bucket").agg(F.sum("m").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "bucket").orderBy("own", "doc_id", "size", "text_crc32", "piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("m").over(within), F.lit(0))).join(counts, ["shard", "bucket"])
    slot = F.explode(F.sequence(F.col("first") + F.col("ahead"), F.col("first") + F.col("ahead") + F.col("m") - 1))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 24)
