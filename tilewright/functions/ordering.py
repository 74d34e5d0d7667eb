"""Total orders without a single-partition window: range buckets, row numbers, running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys drawn for each bucket when bounds are chosen. Bounds only decide how even buckets are.
SAMPLES_PER_BUCKET = 24
MAX_BUCKETS = 10_000


def bucket_count(df: DataFrame) -> int:
    """Buckets for this session: its shuffle partitions, within 1 to MAX_BUCKETS."""
    return max(1, min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def order_key(keys: Sequence[Column]) -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)


def range_bounds(df: DataFrame, keys: Sequence[Column], n: int) -> list[Column]:
    """At most ``n - 1`` ascending bounds that cut the rows into about equal ranges of the keys.

    A sample of bounded size (SAMPLES_PER_BUCKET * n keys) goes to the driver; results never
    depend on which keys it holds, only the evenness of the buckets does.
    """
    if n <= 1:
        return []
    rows = df.count()
    if rows == 0:
        return []
    want = SAMPLES_PER_BUCKET * n
    keyed = df.select(order_key(keys).alias("k"))
    drawn = keyed if rows <= want else keyed.sample(fraction=min(1.0, want / rows), seed=17)
    kind = keyed.schema["k"].dataType
    got = [r["k"] for r in drawn.orderBy("k").limit(2 * want).collect()]
    step = max(1, len(got) // n)
    picked: list = []
    for row in got[step::step]:
        if not picked or picked[-1] != row:
            picked.append(row)
    return [_literal(row, kind) for row in picked[: n - 1]]


def range_bucket(keys: Sequence[Column], bounds: Sequence[Column]) -> Column:
    """Number of bounds that are not above the keys, by binary search in a constant array."""
    m = len(bounds)
    if m == 0:
        return F.lit(0)
    table, key = F.array(*bounds), order_key(keys)
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(m.bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda lo, s: F.when((lo + s <= m) & (F.element_at(table, F.least(lo + s, F.lit(m))) <= key), lo + s).otherwise(lo),
    )


def _offsets(df: DataFrame, bucket: str, value: Column, n: int) -> Column:
    """Constant array: the sum of ``value`` in all buckets before each one (n values, bounded)."""
    sums = {r[0]: r[1] or 0 for r in df.groupBy(bucket).agg(F.sum(value)).collect()}
    out, run = [], 0
    for b in range(n):
        out.append(F.lit(run).cast("long"))
        run += int(sums.get(b, 0))
    return F.array(*out)


def with_index(df: DataFrame, keys: Sequence[Column], name: str = "idx", buckets: int | None = None) -> DataFrame:
    """Row number from 0 in the ascending order of ``keys`` over all rows.

    Range buckets are numbered in parallel and shifted by the counts of the buckets before
    them. ``keys`` should be a total order; among rows that tie on every key the numbers are
    exchangeable. Nulls come first. Empty input gives an empty result.
    """
    n = buckets or bucket_count(df)
    bounds = range_bounds(df, keys, n)
    b = df.withColumn("__bucket", range_bucket(keys, bounds))
    shift = _offsets(b, "__bucket", F.lit(1), len(bounds) + 1)
    number = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys)) - 1
    return b.withColumn(name, F.element_at(shift, F.col("__bucket") + 1) + number).drop("__bucket")


def with_running_sum(df: DataFrame, keys: Sequence[Column], value: Column, name: str = "before", buckets: int | None = None) -> DataFrame:
    """Sum of ``value`` (long) over all rows before each one in the ascending order of ``keys``."""
    n = buckets or bucket_count(df)
    bounds = range_bounds(df, keys, n)
    b = df.withColumn("__bucket", range_bucket(keys, bounds))
    shift = _offsets(b, "__bucket", value, len(bounds) + 1)
    over = Window.partitionBy("__bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(value).over(over), F.lit(0))
    return b.withColumn(name, F.element_at(shift, F.col("__bucket") + 1) + run).drop("__bucket")
