"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs. Each paragraph gives a wide vector: the sum, lane by lane
and modulo a power of two, of vectors hashed from the paragraph itself, from each of its
sentences, and from the pieces of long sentences. A document's fingerprint is the sum of its paragraphs' vectors, so it doesn't
depend on their order, and a paragraph is inserted or deleted by adding or subtracting its
vector. The lanes have mean zero once their known offset is taken off, so the cosine of two
fingerprints estimates the share of units that two documents have in common.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.lineage import cut
from tilewright.functions.ordering import bucket_count, order_key, range_bounds, range_bucket

#: 64-bit hashes of a unit; each gives sixteen lane values of 4 bits.
HASHES = 8
LANES = HASHES * 16
#: Lanes are kept modulo this power of two. The last element, the count of units, is kept whole.
MODULUS = 1 << 16

#: Words of a piece of a long sentence; a longer word than LETTERS counts as several.
PIECE, LETTERS = 8, 64
_WORD = rf"(?:[^ \t\x0B\f\r]{{1,{LETTERS}}}+[ \t\x0B\f\r]*+)"
_PIECES = rf"{_WORD}{{1,{PIECE}}}+"


def _lane_pairs(hashes: Sequence[Column]) -> list[Column]:
    """Two lane values in each long, 32 bits apart, so that sums of 2**28 units don't touch."""
    out = []
    for h in hashes:
        for k in range(8):
            w = F.shiftrightunsigned(h, 8 * k)
            out.append(w.bitwiseAND(F.lit(0xF)).bitwiseOR(F.shiftleft(w.bitwiseAND(F.lit(0xF0)), 28)))
    return out


def _pack(lanes: Sequence[Column]) -> list[Column]:
    """Four lanes of 16 bits in each long."""
    words = []
    for i in range(0, LANES, 4):
        w = lanes[i]
        for k in range(1, 4):
            w = w.bitwiseOR(F.shiftleft(lanes[i + k], 16 * k))
        words.append(w)
    return words


def _lanes(sums: Sequence[Column], count: Column) -> Column:
    """Fingerprint: LANES lane sums modulo MODULUS, four in a long, and the count of units."""
    low = F.lit(MODULUS - 1)
    lanes = [x for s in sums for x in (s.bitwiseAND(low), F.shiftrightunsigned(s, 32).bitwiseAND(low))]
    return F.array(*_pack(lanes), count)


def unpack(fp: Column) -> Column:
    """Lane sums of a fingerprint, from 0 to MODULUS - 1."""
    low = F.lit(MODULUS - 1)
    return F.flatten(F.transform(F.slice(fp, 1, LANES // 4), lambda w: F.array(*[F.shiftrightunsigned(w, 16 * k).bitwiseAND(low) for k in range(4)])))


def _combine(a: Column, b: Column, sign: int) -> Column:
    lanes = F.zip_with(unpack(a), unpack(b), lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS)))
    return F.array(*_pack([F.element_at(lanes, i + 1) for i in range(LANES)]), F.element_at(a, -1) + sign * F.element_at(b, -1))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of two multisets together: inserts the paragraphs of ``b``."""
    return _combine(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of a multiset without the part ``b``: deletes its paragraphs."""
    return _combine(a, b, -1)


def _units(text: Column) -> Column:
    """Paragraphs (lines with more than white space), their sentences, and the pieces of longer sentences, all marked by kind.

    Pieces are runs of PIECE words from the start of their sentence on, so that an edit reaches the
    pieces behind it in one sentence only, and a text without sentence ends has units to compare.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    sentences = F.filter(F.split(text, r"\n|(?<=[.!?])[ \t]+"), lambda s: F.length(F.trim(s)) > 0)
    mark = lambda kind: lambda s: F.concat(F.lit(kind), F.trim(s))
    longer = F.filter(F.transform(sentences, lambda s: F.trim(s)), lambda s: s.rlike(rf"^{_WORD}{{{PIECE + 1}}}"))
    pieces = F.flatten(F.transform(longer, lambda s: F.regexp_extract_all(s, F.lit(_PIECES), F.lit(0))))
    return F.concat(F.transform(paragraphs, mark("p")), F.transform(sentences, mark("s")), F.transform(pieces, mark("c")))


def _numbered(which: int):
    return lambda u: F.struct(F.lit(which).alias("which"), u.alias("unit"))


def fingerprints(rows: DataFrame, keys: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """(keys, which, fp): the fingerprint of each text column of every row, numbered from 0.

    ``keys`` must be unique. Units are summed in the tasks that hold their rows, so what is
    shuffled is one row a text. Empty and null texts have lanes and count zero.
    """
    units = []
    for i, t in enumerate(texts):
        numbered = F.transform(_units(F.coalesce(F.col(t), F.lit(""))), _numbered(i))
        units += [numbered, F.array(F.struct(F.lit(i).alias("which"), F.lit(None).cast("string").alias("unit")))]
    out = rows.select(*keys, F.explode(F.concat(*units)).alias("u")).select(*keys, "u.which", "u.unit")
    there = F.col("unit").isNotNull()
    hashed = out.select(*keys, "which", there.cast("long").alias("there"), *[F.when(there, F.xxhash64("unit", F.lit(k))).otherwise(0).alias(f"h{k}") for k in range(HASHES)])
    pairs = _lane_pairs([F.col(f"h{k}") for k in range(HASHES)])
    sums = hashed.groupBy(*keys, "which").agg(F.sum("there").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(pairs)])
    return sums.select(*keys, "which", _lanes([F.col(f"s{i}") for i in range(len(pairs))], F.col("n")).alias("fp"))


def as_text(fp: Column) -> Column:
    """Sixteen hexadecimal digits for every four lanes, and for the count."""
    return F.lower(F.array_join(F.transform(fp, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def _centred(fp: Column) -> Column:
    """Lane sums less their mean, as doubles; right after any number of wraps."""
    n = F.element_at(fp, -1)
    return F.transform(unpack(fp), lambda s: (F.pmod(2 * s - 15 * n + MODULUS, F.lit(2 * MODULUS)) - MODULUS).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 for equal fingerprints, about the cosine of the multisets of units otherwise."""
    x, y = _centred(a), _centred(b)
    cosine = _dot(x, y) / F.greatest(F.sqrt(_dot(x, x) * _dot(y, y)), F.lit(1e-9))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def with_next(docs: DataFrame, keys: Sequence[Column], column: str) -> DataFrame:
    """Add ``idx``, the place in the ascending order of ``keys``, and ``next_<column>`` of the row that follows.

    The last row is followed by the first. Ranges of the order, numbered by ``__b``, are worked on in
    parallel, and the rows of one stay in its task; their counts and the first row of each close the gaps between them, and these few rows are all
    that a single task orders.
    """
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    cols = [F.col(f"__k{i}") for i in range(len(keys))]
    small = cut(docs.select(*named), "order-keys")
    bounds = range_bounds(small, cols, bucket_count(docs))
    shift, run = [], 0
    counts = {r[0]: r[1] for r in small.select(range_bucket(cols, bounds).alias("b")).groupBy("b").count().collect()}
    for b in range(len(bounds) + 1):
        shift.append(F.lit(run).cast("long"))
        run += counts.get(b, 0)
    ranged = docs.select("*", *named).withColumn("__b", range_bucket(cols, bounds))
    within = Window.partitionBy("__b").orderBy(*cols)
    idx = F.element_at(F.array(*shift), F.col("__b") + 1) + F.row_number().over(within) - 1
    led = ranged.withColumns({"idx": idx, "__n": F.lead(column).over(within)})
    heads = cut(ranged.groupBy("__b").agg(F.min_by(column, order_key(cols)).alias("__head")), "range-heads")
    row = Window.orderBy("__b")
    first = F.first("__head").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("__b", F.coalesce(F.lead("__head").over(row), first).alias("__head"))
    out = led.join(heads, "__b").withColumn(f"next_{column}", F.coalesce("__n", "__head"))
    return out.drop("__n", "__head", *[f"__k{i}" for i in range(len(keys))])


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many
    (or all) of the next document in descending order of the ids, null ids last, equal ids by a
    hash of the text; the last document is followed by the first. Ids are numbers. Null texts are
    empty, and the likeness of two empty texts is 1. Repeated rows are documents of their own. An empty table gives an empty result; other columns of the
    input are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, [F.col("doc_id").isNull(), -F.col("doc_id"), F.xxhash64("text")], "text")
    n = F.length("text")
    last = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - last), F.substring(F.col("next_text"), F.lit(1), last))
    # All that follows is by range, so the rows stay where they are until their fingerprints are written.
    keys = ["__b", "idx", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select("__b", "idx", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    of = lambda which: F.first(F.when(F.col("which") == which, F.col("fp")), ignorenulls=True)
    both = fingerprints(rows, keys, ["text", "edited"]).groupBy(*keys).agg(of(0).alias("fp"), of(1).alias("edited_fp"))
    within = Window.partitionBy("__b").orderBy("idx")
    prints = cut(both.withColumns({"after": F.lead("fp").over(within), "place": F.row_number().over(within)}), "multiset-prints")
    # A range's last row is followed by the first one of the next range: one row a range.
    total = prints.count()
    heads = prints.where("place = 1").select(F.pmod(F.col("idx") - 1, F.lit(max(1, total))).alias("idx"), F.col("fp").alias("head"))
    joined = prints.join(F.broadcast(heads), "idx", "left").withColumn("next_fp", F.coalesce("after", "head"))
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op7_multiset_hash(spark, sf_dir: str) -> DataFrame:
    return edit_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
