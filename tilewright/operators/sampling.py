"""Sampling, balancing, splitting and batching of subtiles, without a single-partition window."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.ordering import with_index


#: Hexadecimal digits by which a sample's order is counted at once, and rows that are put in order without counting finer.
DIGITS, SMALL = 3, 100_000


def seeded(key: Column, seed: int) -> Column:
    """An order by key and seed that doesn't depend on partitions."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def global_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    return with_index(df, [F.col(key)], name)


def balanced_split(stats: DataFrame, size: int, col: str = "frac", key: str = "tile") -> DataFrame:
    """Add ``shard``: rows by ``col`` descending dealt in turn into ceil(n / size) groups, ties by ``key``."""
    n, least = stats.agg(F.count("*"), F.min(col)).first()
    if n == 0 or not 1 <= size <= n:
        raise ValueError(f"size must be in 1..{n}")
    if least is None or least <= 0:
        raise ValueError(f"every {col} must be above 0")
    groups = math.ceil(n / size)
    return with_index(stats, [-F.col(col), F.col(key)]).withColumn("shard", F.col("idx") % groups).drop("idx")


def shard_totals(split: DataFrame, col: str = "frac") -> DataFrame:
    return split.groupBy("shard").agg(F.sum(col).alias("total"), F.count("*").alias("n"))


def fill_shards(split: DataFrame, size: int, key: str = "tile", seed: int = 1, compat: bool = False) -> DataFrame:
    """Shards of exactly ``size`` rows, with ``pos`` and ``copy`` (0 for the rows themselves).

    A shard that is over half full is filled with copies of its rows, drawn by a hash of place
    and seed; the others are dropped. ``compat`` fills only the last shard and drops all others
    that are not full.
    """
    number = F.row_number().over(Window.partitionBy("shard").orderBy(seeded(F.col(key), seed), F.col(key))) - 1
    counts = split.groupBy("shard").agg(F.count("*").alias("__n"))
    last = counts.agg(F.max("shard")).first()[0]
    rows = split.withColumn("pos", number).join(counts, "shard")
    may = (F.col("__n") * 2 > size) & ((F.col("shard") == last) if compat else F.lit(True))
    kept = rows.where((F.col("__n") == size) | may)
    gaps = counts.where((F.col("__n") < size) & (F.col("__n") * 2 > size) & ((F.col("shard") == last) if compat else F.lit(True)))
    gaps = gaps.withColumn("__at", F.explode(F.sequence(F.col("__n"), F.lit(size - 1)))).withColumn("__src", F.pmod(F.xxhash64("shard", "__at", F.lit(seed)), F.col("__n")))
    copies = gaps.select("shard", "__at", F.col("__src").alias("pos")).join(rows.drop("__n"), ["shard", "pos"]).drop("pos").withColumnRenamed("__at", "pos")
    return kept.drop("__n").withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))


def sample_exact(df: DataFrame, key: str, seed: int, n: int | None = None, frac: float | None = None) -> DataFrame:
    """Exactly n rows, or round(frac * rows) half to even, without replacement: the first ones in the order of key and seed.

    Counts of the first digits of that order say in which part the last row lies; only that part is
    counted finer, and in the end only it is put in order. All other rows are taken or left as they are read.
    """
    code = F.coalesce(seeded(F.col(key), seed), F.lit(""))
    left, width, parts = n, 0, None
    part = lambda k: F.substring(code, 1, k)
    at = ""
    while True:
        width += DIGITS
        inside = df if parts is None else df.where(part(width - DIGITS) == at)
        counts = sorted(inside.groupBy(part(width).alias("p")).count().collect())
        if parts is None:
            total = sum(r["count"] for r in counts)
            left = round(frac * total) if n is None else n
            if left >= total:
                return df
            if left <= 0:
                return df.limit(0)
        parts = counts
        for r in counts:
            at = r["p"]
            if r["count"] >= left:
                break
            left -= r["count"]
        if r["count"] <= SMALL or width >= 32:
            break
    order = [code, F.col(key), F.xxhash64(*df.columns)]
    border = df.where(part(width) == at)
    if r["count"] <= SMALL:
        border = border.orderBy(*order).limit(left)
    else:  # a key that repeats so often has the same digits to the end
        border = with_index(border, order, "__i").where(F.col("__i") < left).drop("__i")
    return df.where(part(width) < at).unionByName(border)


def all_keys(tiles: DataFrame, n: int, tile: str = "tile") -> DataFrame:
    """(key): ``tile_NNN`` of the n subtiles of every tile."""
    sub = tiles.select(tile, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sub"))
    return sub.select(F.concat_ws("_", tile, F.lpad(F.col("sub").cast("string"), 3, "0")).alias("key"))


def sample_negatives(positives: DataFrame, keys: DataFrame, factor: int = 2, seed: int = 1) -> DataFrame:
    """``factor`` times as many keys as there are positives, out of the others; too few are an error."""
    want, pool = factor * positives.count(), keys.join(positives, "key", "left_anti")
    if pool.count() < want:
        raise ValueError(f"fewer than {want} negative keys")
    return sample_exact(pool, "key", seed, want)


def tiles_of(keys: DataFrame) -> DataFrame:
    return keys.select(F.expr("substring(key, 1, length(key) - 4)").alias("tile")).distinct()


def shuffle_within(df: DataFrame, key: str, seed: int) -> DataFrame:
    """New ``pos`` in each shard, by key and seed."""
    place = F.row_number().over(Window.partitionBy("shard").orderBy(seeded(F.col(key), seed), F.col(key))) - 1
    return df.withColumn("pos", place.cast("long"))


def thresholds(n: int, fractions: Sequence[float], compat: bool = False) -> list[int]:
    """Ends of the parts of n shards: rounded half to even; the last part takes the rest.

    Empty parts are mended: with three parts the last two shards become parts of their own, with
    two parts the last one. ``compat`` raises where the rounded parts don't cover all.
    """
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    parts = [round(n * f) for f in fractions]
    if compat and sum(parts) != n:
        raise ValueError(f"parts {parts} don't cover {n} shards")
    ends = [min(n, sum(parts[: i + 1])) for i in range(len(parts))]
    ends[-1] = n
    if any(b <= a for a, b in zip([0, *ends], ends, strict=False)):
        if n < len(parts):
            raise ValueError(f"{n} shards are too few for {len(parts)} parts")
        ends = [n - len(parts) + 1 + i for i in range(len(parts))]
    return ends


def split_shards(shards: DataFrame, fractions: Sequence[float] = (0.7, 0.2, 0.1), key: str = "shard") -> DataFrame:
    """Add ``part``: train, val and, with three fractions, test, in the order of ``key``."""
    ends = thresholds(shards.select(key).distinct().count(), fractions)
    index = with_index(shards.select(key).distinct(), [F.col(key)], "__i")
    names = ["train", "val", "test"]
    part = F.lit(names[len(ends) - 1])
    for i in reversed(range(len(ends) - 1)):
        part = F.when(F.col("__i") < ends[i], names[i]).otherwise(part)
    return shards.join(index, key).withColumn("part", part).drop("__i")


def shard_target(paths: DataFrame) -> DataFrame:
    """Year (first four digits of the folder) and the name with it: ``a-0b`` becomes ``a-<year>-0b``."""
    year = F.regexp_extract("dir", r"(\d{4})", 1)
    parts = F.split("name", "-0", 2)
    return paths.withColumn("year", year).withColumn("target", F.concat(parts[0], F.lit("-"), F.col("year"), F.lit("-0"), parts[1]))


def merge_years(shards: DataFrame, fractions: Sequence[float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """Split each year's shards (year, shard) on its own and put the parts together; needs two years."""
    counts = {r["year"]: r["n"] for r in shards.groupBy("year").agg(F.countDistinct("shard").alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError("fewer than two years")
    index = F.dense_rank().over(Window.partitionBy("year").orderBy("shard")) - 1
    part = F.lit(None).cast("string")
    for year, n in counts.items():
        a, b = thresholds(n, fractions)[:2]
        mine = F.when(F.col("__i") < a, "train").when(F.col("__i") < b, "val").otherwise("test")
        part = F.when(F.col("year") == year, mine).otherwise(part)
    return shards.withColumn("__i", index).withColumn("part", part).drop("__i")


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of shards A and B (shard, pos) in turn, as far as the shorter one goes; ``pos`` is the new place."""
    both = a.select("shard", "pos").join(b.select("shard", "pos"), ["shard", "pos"], "left_semi")
    left = a.join(both, ["shard", "pos"]).withColumn("pos", F.col("pos") * 2)
    right = b.join(both, ["shard", "pos"]).withColumn("pos", F.col("pos") * 2 + 1)
    return left.unionByName(right)


def batch_manifest(samples: DataFrame, key: str, size: int, extra: Sequence[int] = (), drop_last: bool = True) -> DataFrame:
    """Add ``batch_id`` and ``pos`` of consecutive samples; the batch leaves room for the extra sets."""
    main = size - sum(extra)
    if main < 1:
        raise ValueError("extra sets fill the batch")
    indexed = with_index(samples, [F.col(key)])
    out = indexed.withColumns({"batch_id": F.floor(F.col("idx") / main), "pos": F.col("idx") % main}).drop("idx")
    return out.where(F.col("batch_id") < samples.count() // main) if drop_last else out


def extra_sets(names: Sequence[str], sizes: Sequence[int], folders: int = 1) -> dict[str, int]:
    """Size in each batch by extra set; needs as many sizes as sets, and a single folder that is split here."""
    if names and folders > 1:
        raise ValueError("extra sets can't be combined with folders that are split already")
    if len(names) != len(sizes):
        raise ValueError(f"{len(names)} extra sets and {len(sizes)} sizes")
    return dict(zip(names, sizes, strict=True))


def split_like(extra: DataFrame, main: DataFrame, key: str = "shard") -> DataFrame:
    """Split the extra set by the share of train shards in the main set, which has ``part``."""
    total, train = main.select(key, "part").distinct().agg(F.count("*"), F.count_if(F.col("part") == "train")).first()
    return split_shards(extra, (train / total, 1 - train / total), key)


def buffered_shuffle(samples: DataFrame, size: int, seed: int, epoch: int = 0, streams: int = 8, shard: str = "shard", pos: str = "pos") -> DataFrame:
    """The samples with ``stream`` and ``seq``: the order in which ``streams`` readers with a buffer of ``size`` give them.

    Each reader takes its shards in turns, one sample of each, into a buffer, and every sample that
    comes into a full buffer puts out one at random. Shards are dealt anew in every epoch. A task holds
    the buffer and one batch, and reruns agree.
    """
    if size < 1:
        raise ValueError("a buffer needs room")
    mixed = lambda k: F.xxhash64(F.col(shard), F.lit(seed), F.lit(epoch), F.lit(k))
    dealt = samples.withColumn("stream", F.pmod(mixed(0), F.lit(streams)).cast("int")).withColumn("__turn", mixed(1))
    ordered = dealt.repartition("stream").sortWithinPartitions("stream", pos, "__turn", shard).drop("__turn")
    schema = T.StructType([*ordered.schema, T.StructField("seq", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rng, n = None, None, None, 0

        def out(table: pa.Table, rows: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal n
            took = table.take(pa.array(rows, pa.int64())).append_column("seq", pa.array(range(n, n + len(rows)), pa.int64()))
            n += len(rows)
            yield from took.combine_chunks().to_batches()

        def drained() -> Iterator[pa.RecordBatch]:
            if held is not None and held.num_rows:
                yield from out(held, rng.permutation(held.num_rows).tolist())

        for batch in batches:
            stream = batch.column("stream").to_numpy()
            ends = [*(np.flatnonzero(stream[1:] != stream[:-1]) + 1).tolist(), len(stream)]
            for lo, hi in zip([0, *ends], ends, strict=False):
                if lo == hi:
                    continue
                if now != int(stream[lo]):
                    yield from drained()
                    now, held, n = int(stream[lo]), None, 0
                    rng = np.random.default_rng([seed & 0xFFFFFFFF, epoch, now])
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                first = 0 if held is None else held.num_rows
                table = part if held is None else pa.concat_tables([held, part])
                slots, put = list(range(min(size, table.num_rows))), []
                for k in range(max(first, size), table.num_rows):
                    j = int(rng.integers(size))
                    put.append(slots[j])
                    slots[j] = k
                if put:
                    yield from out(table, put)
                held = table.take(pa.array(slots, pa.int64())).combine_chunks()
        yield from drained()

    return ordered.mapInArrow(run, schema)


def cycle_batches(main: DataFrame, extra: DataFrame) -> DataFrame:
    """Each main batch with one of the extra batches, which begin anew when they are used up."""
    n = extra.agg(F.max("batch_id")).first()[0] + 1
    return main.withColumn("extra_batch", F.col("batch_id") % n).join(extra.withColumnRenamed("batch_id", "extra_batch"), "extra_batch")


def n_batches(shards: int, shard_size: int, batch: int) -> int:
    return shards * shard_size // batch


def batches_of_split(split: DataFrame, shard_size: int, batch: int, shard: str = "shard") -> DataFrame:
    """(batches): full batches that the shards of a split give, each counted as ``shard_size`` samples."""
    return split.agg(F.floor(F.count_distinct(shard) * shard_size / batch).alias("batches"))
