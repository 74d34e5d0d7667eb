"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other parameters has
the same template. Windows of WINDOW template words of every document are hash-joined with
those of the benchmark. A matched pair of document and item counts if each value in the item's
slots has one value in the document, the same in all windows of a place of the document, and
enough of the item's windows match there or enough of them in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.binding import let
from tilewright.functions.lineage import cut

WINDOW = 8
#: Words of a window that must not be placeholders.
LITERAL = 4
#: Share of an item's windows that a contaminated document holds.
COVER = 0.5
#: So many windows in a row contaminate a document whatever their share of the item is.
RUN = 16
#: The benchmark's windows are broadcast if they take at most so many bytes, slot values included; more are shuffled.
BROADCAST_BYTES = 32 << 20
#: Keys of documents (16 bytes each) that are broadcast, at most.
BROADCAST_KEYS = 500_000

#: Placeholders are characters for private use, so that no text word equals one.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
#: A number may have signs, separators and decimals; a name is a capitalised word inside a sentence.
_NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
_NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;] \p{Lu})\p{Ll}+"
#: Units, which count as such right after a number.
UNITS = (
    "mm cm m km in ft yd mi miles meters metres kilometers kilometres inches feet g kg mg lb oz t grams kilograms pounds tons ml l liters litres "
    "gallons s ms sec min h hr hrs seconds minutes hours days weeks months years mph kmh kph hz khz mhz ghz w kw mw kwh v kv a ma j kj pa kpa bar "
    "c f k usd eur gbp dollars euros cents percent pct"
).split()
_UNIT = r"(?i:[%$€£°]|(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{N}]))"
_SLOT = f"{_NAME}|{_NUMBER}(?: ?{_UNIT})?"


def template(text: Column) -> Column:
    """Words of the template: lower-case words and placeholders, without punctuation."""
    t = F.regexp_replace(text, _NAME, f" {NAME} ")
    t = F.regexp_replace(t, f"{_NUMBER} ?{_UNIT}", f" {NUMBER} {UNIT} ")
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER} ")
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}" + NUMBER + UNIT + NAME + "]+"), lambda w: w != "")


def slots(text: Column) -> Column:
    """Values of the placeholders in their order, lower-cased; a quantity gives its number and its unit."""
    found = F.regexp_extract_all(text, F.lit(_SLOT), F.lit(0))
    return F.flatten(F.transform(found, lambda v: F.split(F.lower(v), r"(?<=\p{N}) ?(?=[^\p{N}.,:/ ])")))


def _joined(xs: Column, by: int) -> Column:
    """Hashes of each item and the one that stands ``by`` places later."""

    def pairs(n: Column) -> Column:
        return F.zip_with(F.slice(xs, F.lit(1), n), F.slice(xs, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))

    return let(F.greatest(F.size(xs) - by, F.lit(0)), pairs)


def window_hashes(words: Column) -> Column:
    """Hash of the WINDOW words from each place on; empty for texts with fewer words.

    Hashes of 1, 2, 4 and 8 words are built from one another, two at a time.
    """
    level, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < WINDOW:
        level = let(level, _by(width))
        width *= 2
    return level


def _by(width: int):
    return lambda xs: _joined(xs, width)


def _is_slot(w: Column) -> Column:
    return w.isin(NUMBER, UNIT, NAME)


def _values_at(pos: Column, width: Column) -> Column:
    """Values of the slots in the window of ``width`` words at ``pos`` of (words, values)."""
    before = F.size(F.filter(F.slice("words", F.lit(1), pos), _is_slot))
    return F.slice("values", before + 1, F.size(F.filter(F.slice("words", pos + 1, width), _is_slot)))


def _whole_hash(words: Column) -> Column:
    """Hash of an item's complete template, apart from those of windows."""
    return F.xxhash64(F.lit("whole"), words)


def _all_hashes(words: Column, widths: list[int]) -> Column:
    """(width, pos, hash) of a text's windows, and of its runs of the given widths for whole items."""

    def rows(width: int, hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("pos"), h.alias("hash")))

    def runs(width: int, xs: Column) -> Column:
        starts = F.when(F.size(xs) >= width, F.sequence(F.lit(1), F.size(xs) - width + 1)).otherwise(F.array().cast("array<int>"))
        return rows(width, F.transform(starts, lambda i: _whole_hash(F.slice(xs, i, F.lit(width)))))

    return let(words, lambda xs: F.concat(rows(WINDOW, window_hashes(xs)), *[runs(w, xs) for w in widths])) if widths else rows(WINDOW, window_hashes(words))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, windows, words, width, ipos, hash, ivalues, exact, whole) of the windows with enough literal words.

    An item without such a window, because it is short or full of slots, has one of its complete
    template instead; with fewer than LITERAL literal words its values are compared exactly.
    Only items without words have none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(F.col(id_col).alias("item_id"), template(text).alias("words"), slots(text).alias("values"))
    hashes = window_hashes(F.col("words"))
    fixed = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0))), lambda i: F.size(F.filter(F.slice("words", i + 1, F.lit(WINDOW)), _is_slot)) <= WINDOW - LITERAL)
    items = items.withColumn("windowed", (F.size("words") >= WINDOW) & F.exists(fixed, lambda ok: ok))
    at = F.posexplode(hashes).alias("ipos", "hash")
    rows = items.where("windowed").select("item_id", "words", "values", at).withColumn("ivalues", _values_at(F.col("ipos"), F.lit(WINDOW)))
    rows = rows.where(F.size("ivalues") <= WINDOW - LITERAL)
    rows = rows.select("item_id", F.lit(WINDOW).alias("width"), "ipos", "hash", "ivalues", F.lit(False).alias("exact"), F.lit(False).alias("whole"))
    literals = F.size(F.filter("words", lambda w: ~_is_slot(w)))
    whole = items.where(~F.col("windowed") & (F.size("words") > 0)).select(
        "item_id", F.size("words").alias("width"), F.lit(0).alias("ipos"), _whole_hash(F.col("words")).alias("hash"), F.col("values").alias("ivalues"), (literals < LITERAL).alias("exact"), F.lit(True).alias("whole")
    )
    rows = rows.unionByName(whole)
    n = rows.groupBy("item_id").agg(F.countDistinct("ipos").alias("windows"), F.max(F.col("ipos") + F.col("width")).alias("words"))
    return rows.join(n, "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, item_id, matched, windows): documents that hold an item, ``h`` a hash of the text.

    A document holds an item if at least ``cover`` of the item's windows, or RUN of them in a row,
    match with consistent slots. Slots are judged by place: for each alignment of document and item,
    for alignments less than half an item apart (words put in or left out move the rest), and for
    the whole document; the best of them counts. Null texts are empty and hold nothing. Repeated rows give one row; equal texts under
    different ids one each. Empty tables give an empty result. Other columns are not read. Texts of any
    length are read whole.
    """
    grams = cut(benchmark_windows(benchmark), "benchmark-windows")
    table = grams.select("hash").distinct()
    small = (grams.agg(F.sum(F.lit(100) + 2 * F.octet_length(F.array_join("ivalues", "    ")))).first()[0] or 0) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    widths = sorted(r["width"] for r in grams.where("whole").select("width").distinct().collect())
    if not widths:
        hashed = base.select("doc_id", "h", F.lit(WINDOW).alias("width"), F.posexplode(window_hashes(template(F.col("text")))).alias("pos", "hash"))
    else:
        hashed = base.select("doc_id", "h", F.inline(_all_hashes(template(F.col("text")), widths)))
    hits = cut(hashed.join(hint(table), "hash"), "window-hits")
    # Slot values only matter where a matched item window has slots; those documents are read again.
    slotted = grams.where(F.size("ivalues") > 0).select("hash").distinct()
    asked = hits.join(hint(slotted), "hash", "left_semi").select("doc_id", "h", "pos", "width").distinct()
    asked = cut(asked.groupBy("doc_id", "h").agg(F.collect_set(F.struct("pos", "width")).alias("places")), "slot-places")
    n_asked = asked.count()
    if not n_asked:
        valued = hits.withColumn("values", F.array().cast("array<string>"))
    else:
        # Only texts of the documents asked for move: their keys are few enough to be broadcast, or the join is by key.
        keys = asked.select(F.col("doc_id").alias("d"), F.col("h").alias("hh"))
        keys = F.broadcast(keys) if n_asked <= BROADCAST_KEYS else keys
        wanted = base.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left_semi").dropDuplicates(["doc_id", "h"])
        again = wanted.alias("b").join(asked.alias("a"), F.col("b.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("b.h") == F.col("a.h")))
        read = again.select("b.doc_id", "b.h", "places", template(F.col("text")).alias("words"), slots(F.col("text")).alias("values"))
        found = read.select("doc_id", "h", "words", "values", F.inline("places"))
        found = found.select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), F.col("pos").alias("p"), F.col("width").alias("w"), _values_at(F.col("pos"), F.col("width")).alias("values"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")) & (F.col("pos") == F.col("p")) & (F.col("width") == F.col("w"))
        valued = hits.distinct().join(found, same, "left").drop("d", "hh", "p", "w")
    pairs = valued.drop("width").join(hint(grams), "hash")
    clear = F.size("ivalues") == 0
    pairs = pairs.where(clear | (F.size("values") == F.size("ivalues"))).where(~F.col("exact") | clear | (F.col("values") == F.col("ivalues")))
    key = ["doc_id", "h", "item_id"]
    enough = F.least(cover * F.col("windows"), F.lit(float(RUN)))
    bound = Window.partitionBy(*key)
    pairs = pairs.withColumn("n", F.size(F.collect_set("ipos").over(bound))).where(F.col("n") >= enough)
    # Places: 0 the whole document, 1 alignments near one another, 2 a single alignment.
    pairs = pairs.withColumn("by", F.col("pos") - F.col("ipos"))
    along = bound.orderBy("by")
    apart = F.col("by") - F.lag("by").over(along) > F.col("words") / 2
    pairs = pairs.withColumn("apart", F.coalesce(apart.cast("long"), F.lit(0).cast("long")))
    pairs = pairs.withColumn("group", F.sum("apart").over(along))
    places = [F.struct(F.lit(k).alias("kind"), c.cast("long").alias("place")) for k, c in enumerate([F.lit(0), F.col("group"), F.col("by")])]
    placed = cut(pairs.select(*key, "windows", "ipos", "pos", "ivalues", "values", F.inline(F.array(*places))), "window-places")
    # Every item value has one document value: in each place the one with most votes.
    spot = [*key, "kind", "place"]
    plain = placed.where(clear).select(*spot, "windows", "ipos")
    each = placed.where(~clear).select(*spot, "windows", "ipos", "pos", F.explode(F.arrays_zip("ivalues", "values")).alias("v"))
    maps = each.groupBy(*spot, F.col("v.ivalues").alias("i"), F.col("v.values").alias("d")).agg(F.count_distinct("ipos").alias("votes"))
    best = maps.groupBy(*spot, "i").agg(F.max_by("d", F.struct("votes", "d")).alias("d"))
    best = best.select(*[F.col(k).alias(f"__{k}") for k in spot], F.col("i").alias("__i"), F.col("d").alias("__d"))
    fits = (F.col("v.ivalues") == F.col("__i")) & (F.col("v.values") == F.col("__d"))
    for k in spot:
        fits = fits & F.col(k).eqNullSafe(F.col(f"__{k}"))
    judged = each.join(best, fits, "left").groupBy(*spot, "windows", "ipos", "pos").agg(F.bool_and(F.col("__i").isNotNull()).alias("ok"))
    good = plain.unionByName(judged.where("ok").select(*spot, "windows", "ipos")).distinct()
    row = F.row_number().over(Window.partitionBy(*spot).orderBy("ipos"))
    runs = good.withColumn("run", F.col("ipos") - row).groupBy(*spot, "windows", "run").agg(F.count("*").alias("n"))
    total = runs.groupBy(*spot, "windows").agg(F.sum("n").alias("matched"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("longest"))
    held = total.groupBy(*key, "windows").agg(F.max("matched").alias("matched"), F.max("longest").alias("longest"))
    return held.where((F.col("matched") >= cover * F.col("windows")) | (F.col("longest") >= RUN)).select(*key, "matched", "windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The documents that hold no item of the benchmark, with their columns as they were, whatever their names.

    Null and empty texts hold nothing and stay, null ids are ordinary ids, and repeated rows stay or go
    together. Without documents there are none, and without items all stay.
    """
    leaks = cut(contaminated(docs, benchmark, cover).select("doc_id", "h").distinct(), "leaks")
    same = docs["doc_id"].eqNullSafe(leaks["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == leaks["h"])
    return docs.join(leaks, same, "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, bench).select("doc_id", "item_id", "matched", "windows")
