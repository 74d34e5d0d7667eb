"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Each distinct fingerprint enters a table under the value of
each segment, and those with an odd number of bits in the segment also under the Hamming ball of
radius 1 around it. Of two values that differ in one bit one is odd, so two fingerprints that
differ in at most 1 bit of some segment meet; with s segments that holds for all pairs within
2 s - 1 bits. What meets is compared over the complete fingerprints. A bucket gives a spanning
forest of its links and not all its pairs, so a group of copies gives rows in proportion to
its members; the components of all forests together are those of all links. A large bucket is
dealt again by the parts of the other segments before it is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.lineage import cut, keep, scratch
from tilewright.llm.components import components
from tilewright.llm.workers import trim

SEED = 42
#: Hashes whose bits are spread out at once.
PASS_HASHES = 200_000
#: A bucket of more fingerprints is dealt again by parts of PART_BITS bits.
LARGE, PART_BITS = 4096, 8


def _features(text: str, width: int, distinct: bool) -> list[bytes]:
    """Shingles of ``width`` words of the A-Z lower-cased text, or its distinct words for width 1."""
    words = text.encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return []
    if width > 1:
        words = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) or [b" ".join(words)]
    return list(set(words)) if distinct else words


def fingerprints_of(texts: list[str], width: int, bits: int, distinct: bool) -> np.ndarray:
    """One row of ``bits / 64`` unsigned words a text: the bits set in over half the features' hashes."""
    from xxhash import xxh64_intdigest as digest

    out = np.zeros((len(texts), bits // 64), np.uint64)
    first = 0
    while first < len(texts):
        hashes: list[list[int]] = [[] for _ in range(bits // 64)]
        sizes, last = [], first
        while last < len(texts) and len(hashes[0]) < PASS_HASHES:
            features = _features(texts[last], width, distinct)
            for k, column in enumerate(hashes):
                column += [digest(f, SEED + k) for f in features]
            sizes.append(len(features))
            last += 1
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        for k, column in enumerate(hashes if len(full) else []):
            out[first + full, k] = _majority(np.array(column, np.uint64), starts, np.asarray(sizes)[full])
        first = last
    return out


def _majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of hashes; long runs are summed piece by piece."""
    counts = np.zeros((len(starts), 64), np.int64)
    owner = np.repeat(np.arange(len(starts)), sizes)
    for at in range(0, len(hashes), PASS_HASHES):
        part, own = hashes[at : at + PASS_HASHES], owner[at : at + PASS_HASHES]
        spread = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[heads]] += np.add.reduceat(spread, heads, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: Column, width: int = 3, bits: int = 64, distinct: bool = False) -> Column:
    """Fingerprint as an array of ``bits / 64`` longs; zero for null texts and texts without words."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(fingerprints_of(texts.tolist(), width, bits, distinct).view(np.int64)))
            del texts
            trim()

    return of(F.coalesce(text, F.lit("")))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def index_keys(fp: Column, bits: int, segment: int = 32) -> Column:
    """Keys of a fingerprint: every segment, and if its number of bits is odd also with one bit turned over."""
    masks = F.array(*[F.lit(0).cast("long")] + [F.lit(1 << b).cast("long") for b in range(segment)])

    def around(s: int) -> Column:
        word = F.element_at(fp, s * segment // 64 + 1)
        value = F.shiftrightunsigned(word, s * segment % 64).bitwiseAND(F.lit((1 << segment) - 1))
        turned = F.slice(masks, F.lit(1), F.when(F.bit_count(value) % 2 == 1, segment + 1).otherwise(1))
        return F.transform(turned, lambda m: m.bitwiseXOR(value).bitwiseXOR(F.lit(s << segment)))

    return F.flatten(F.array(*[around(s) for s in range(bits // segment)]))


def _forest(words: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that span each group of rows within ``most`` bits of one another."""
    left, out = np.arange(1, len(words)), []
    stack = [0]
    while len(left) or stack:
        if not stack:
            stack, left = [int(left[0])], left[1:]
            continue
        at = stack.pop()
        near = np.bitwise_count(words[left] ^ words[at]).sum(axis=1) <= most
        found = left[near].tolist()
        out += [(at, x) for x in found]
        stack += found
        left = left[~near]
    return out


def _links_of(keys: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links of every run of equal keys, as row numbers."""
    heads = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))
    sizes = np.diff(np.append(heads, len(keys)))
    pairs = heads[sizes == 2]
    near = np.bitwise_count(words[pairs] ^ words[pairs + 1]).sum(axis=1) <= most
    a, b = [pairs[near]], [pairs[near] + 1]
    for head, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        got = _forest(words[head : head + size], most)
        if got:
            one, two = zip(*got, strict=True)
            a.append(head + np.array(one))
            b.append(head + np.array(two))
    return np.concatenate(a), np.concatenate(b)


def _text_of(words: np.ndarray) -> list[str]:
    return ["".join(f"{w:016x}" for w in r) for r in words.tolist()]


def _bucket_links(most: int, count: int, large: int | None):
    """Links (u, v) of every bucket; of one above ``large`` the rows come back (u alone, with their key)."""
    names = [f"w{i}" for i in range(count)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            words = pdf[names].to_numpy(np.int64).view(np.uint64)
            a, b = _links_of(pdf["key"].to_numpy(), words, most)
            return pd.DataFrame({"key": np.zeros(len(a), np.int64), "u": _text_of(words[a]), "v": _text_of(words[b])}, dtype=object)

        def back(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"key": pdf["key"], "u": _text_of(pdf[names].to_numpy(np.int64).view(np.uint64)), "v": None}, dtype=object)

        held: list[pd.DataFrame] = []
        flows = None  # the key of a large bucket whose rows go straight on
        for pdf in batches:
            if flows is not None:
                same = pdf["key"].to_numpy() == flows
                if same.any():
                    yield back(pdf[same])
                if same.all():
                    continue
                flows, pdf = None, pdf[~same]
            held.append(pdf)
            whole = pd.concat(held, ignore_index=True)
            if not len(whole):
                continue
            keys = whole["key"].to_numpy()
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(heads, len(keys)))
            above = np.repeat(sizes, sizes) > (large or len(keys))
            if above.any():
                yield back(whole[above])
                flows = keys[-1] if above[-1] else None
            last = len(keys) if above[-1] else heads[-1]
            yield done(whole.iloc[:last][~above[:last]])
            held = [whole.iloc[last:]]
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return run


def _parts(bits: int, segment: int = 32) -> Column:
    """Keys within a bucket: each part of the segments other than the bucket's own, with its value."""

    def part(at: int) -> Column:
        digits = F.substring(F.col("u"), at // 64 * 16 + (64 - at % 64 - PART_BITS) // 4 + 1, PART_BITS // 4)
        return F.when(F.shiftright(F.col("key"), segment) != at // segment, F.xxhash64("key", F.lit(at), digits))

    return F.filter(F.array(*[part(at) for at in range(0, bits, PART_BITS)]), lambda k: k.isNotNull())


def forest_links(prints: DataFrame, bits: int, most: int) -> DataFrame:
    """Links (u, v) as hexadecimal fingerprints that span the groups of every bucket.

    ``prints`` holds distinct fingerprints ``fp``. All pairs within ``most`` bits are joined by
    links of at most ``most`` bits, directly or over others. A bucket of more than LARGE
    fingerprints is dealt again: its members agree in a segment but for one bit, and of the
    parts of the other segments one at least is equal in any pair.
    """
    segments = bits // 32
    if most > 2 * segments - 1 or most >= (bits - 32) // PART_BITS:
        raise ValueError(f"{segments} segments find pairs within {2 * segments - 1} bits")
    count = bits // 64
    words = [F.element_at("fp", i + 1).alias(f"w{i}") for i in range(count)]
    mixed = F.xxhash64("key", *[f"w{i}" for i in range(count)])

    def linked(rows: DataFrame, large: int | None) -> DataFrame:
        # Rows of a bucket go by a hash, so that its forest hangs on another row than the next bucket's.
        ordered = rows.repartition("key").sortWithinPartitions("key", mixed)
        return ordered.mapInPandas(_bucket_links(most, count, large), "key long, u string, v string")

    found = cut(linked(prints.select(F.explode(index_keys(F.col("fp"), bits)).alias("key"), *words), LARGE).distinct(), "bucket-links")
    again = found.where("v is null")
    links = found.where("v is not null").select("u", "v").distinct()
    if again.isEmpty():
        return links
    halves = [F.conv(F.substring("u", 16 * i + 1, 16), 16, -10).cast("long").alias(f"w{i}") for i in range(count)]
    parts = again.select(F.explode(_parts(bits)).alias("key"), *halves)
    return links.unionByName(linked(parts, None).where("v is not null").select("u", "v")).distinct()


def near_groups(prints: DataFrame, bits: int = 64, most: int = 3) -> DataFrame:
    """(node, root) in hexadecimal of every fingerprint that is linked to another one."""
    return components(forest_links(prints, bits, most))


def simhash_components(docs: DataFrame, width: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest id that links of at most ``most`` differing bits reach, the
    row's own included; it is null where a component has null ids only. Null texts and texts
    without words have the fingerprint zero, which is linked like any other. Repeated rows are
    all returned. Other columns of the input are not read.
    """
    spark = docs.sparkSession
    with scratch(spark):
        rows = keep(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fp")), "simhash")
        nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
        groups = near_groups(nodes.select("fp"), most=most)
        nodes = nodes.select(fingerprint_hex(F.col("fp")).alias("fingerprint"), "least")
        rooted = nodes.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        member = keep(rooted.join(least, "root").select("fingerprint", "component_id"), "simhash-members")
    named = rows.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"))
    return named.join(member, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Words of a shingle and least similarity of near-duplicates, and the latter as a fraction.
SHINGLE, SIMILAR = 5, 0.8
PART, WHOLE = 4, 5
#: Bits of a set's parity map.
MAP_BITS = 1024
#: A hash in more sets than this fills a bucket and therefore comes last in the order of all hashes; at most so many do.
FEW, COMMON_HASHES = 32, 50_000
#: Pairs of a head that are compared beside one copy of its set.
MEMBERS = 64
#: Rows of a bucket that the second round compares with all later ones; every round takes so many times more.
ROUND = 64
#: Up to so many marks of rows, or of rows with the roles of their sets, are broadcast, some 20 MB; more are joined by a shuffle.
BROADCAST_SETS = 200_000
_FACTORS = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def shingles_of(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of SHINGLE words; all words in one if there are fewer."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words))], np.uint64)
    one = np.array([digest(w) for w in words], np.uint64)
    n = len(one) - SHINGLE + 1
    x = one[:n] * _FACTORS[0]
    for k in range(1, SHINGLE):
        x += one[k : k + n] * _FACTORS[k]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(x ^ (x >> np.uint64(31)))


def prefix_of(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first hashes of a set in the order of all hashes, where ``common`` (sorted) ones come last.

    Two sets with a similarity of PART / WHOLE share at least that part of the larger one, so they
    have one of these hashes in common, whatever the order is.
    """
    n = len(shingles) - (PART * len(shingles) + WHOLE - 1) // WHOLE + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        late = common[at] == shingles
        if late[:n].any():
            return np.concatenate([shingles[~late], shingles[late]])[:n]
    return shingles[:n]


def parity_map(shingles: np.ndarray) -> bytes:
    """MAP_BITS bits, each the parity of the hashes that fall on it: maps differ in no more bits than sets in hashes."""
    odd = np.bincount((shingles & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def verdicts(apart: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What maps that differ in ``apart`` bits say of two sets with ``sizes`` hashes together: -1 far, 1 near, 0 not sure.

    Sets are near if they differ in at most a ninth of ``sizes``. Far is a bound and always right.
    Near is said where a number of differences beyond that ninth would have to fall on one another
    in more pairs than ten standard deviations and eight pairs above what chance gives.
    """
    most = sizes / ((PART + WHOLE) / (WHOLE - PART))
    pairs = most * most / (2 * MAP_BITS)  # expected number of pairs that cancel out
    sure = apart + 2 * (pairs + 10 * np.sqrt(pairs) + 8) <= most
    return np.where((PART + WHOLE) * apart > (WHOLE - PART) * sizes, -1, np.where(sure & (most < MAP_BITS / 4), 1, 0))


def _set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Name, size, parity map and SimHash fingerprint of each text's set."""
    from xxhash import xxh64_intdigest as digest

    for pdf in batches:
        for first in range(0, len(pdf), 500):
            part = pdf.iloc[first : first + 500]
            sets = [shingles_of(t) for t in part["text"]]
            sizes = np.array([len(x) for x in sets])
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "h": part["h"],
                "s": np.array([digest(x.tobytes()) for x in sets], np.uint64).view(np.int64),
                "n": sizes.astype(np.int32),
                "map": [parity_map(x) for x in sets],
                "fp": _majority(np.concatenate(sets), np.cumsum(sizes) - sizes, sizes).view(np.int64),
            })
        pdf = part = sets = None
        trim()


def _key_rows(common: np.ndarray):
    """(key, s, n) for the first hashes of every set; a set that a task meets again gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest as digest

        seen: set[int] = set()
        for pdf in batches:
            for first in range(0, len(pdf), 500):
                names, sizes, keys = [], [], []
                for text in pdf["text"].iloc[first : first + 500]:
                    x = shingles_of(text)
                    name = digest(x.tobytes())
                    if name not in seen:
                        seen.add(name)
                        names.append(name)
                        sizes.append(len(x))
                        keys.append(prefix_of(x, common).view(np.int64))
                if keys:
                    many = [len(k) for k in keys]
                    yield pd.DataFrame({"key": np.concatenate(keys), "s": np.repeat(np.array(names, np.uint64).view(np.int64), many), "n": np.repeat(np.array(sizes, np.int32), many)})
            pdf = None
            trim()

    return run


def _shingle_set(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles_of(t).view(np.int64) for t in texts.tolist()], dtype=object)
            del texts
            trim()

    return of(text)


def _sizes_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return WHOLE * np.minimum(a, b) >= PART * np.maximum(a, b)


def _first_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of each bucket's first set with its others, and the rows of buckets with more than two sets.

    Rows come sorted and pass in a stream: of a bucket only its first row and up to one more are held.
    A pair is a row with ``b``, a bucket's row one without.
    """
    held = pd.DataFrame({"key": np.zeros(0, np.int64), "s": np.zeros(0, np.int64), "n": np.zeros(0, np.int32)})
    flows: tuple[int, int, int, int] | None = None  # key, first set, its size and last set of a bucket whose rows go straight on

    def out(whole: pd.DataFrame, heads: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
        key, s, n = whole["key"].to_numpy(), whole["s"].to_numpy(), whole["n"].to_numpy().astype(np.int64)
        lead = np.repeat(heads, sizes)
        later = np.flatnonzero((np.arange(len(key)) != lead) & _sizes_near(n, n[lead]))
        rest = np.flatnonzero(np.repeat(sizes, sizes) > 2)
        return pd.concat([_pair_frame(s[lead[later]], s[later]), pd.DataFrame({"key": key[rest], "a": s[rest], "b": None, "n": n[rest]})], ignore_index=True).astype({"b": "Int64"})

    for pdf in batches:
        if flows is not None:
            mine = pdf["key"].to_numpy() == flows[0]
            if mine.any():
                s, n = pdf["s"].to_numpy()[mine], pdf["n"].to_numpy()[mine].astype(np.int64)
                new = np.append(s[0] != flows[3], s[1:] != s[:-1])
                s, n = s[new], n[new]
                near = _sizes_near(n, np.int64(flows[2]))
                yield pd.concat([_pair_frame(np.full(near.sum(), flows[1]), s[near]), pd.DataFrame({"key": flows[0], "a": s, "b": None, "n": n})], ignore_index=True).astype({"b": "Int64"})
                flows = (*flows[:3], s[-1] if len(s) else flows[3])
            if mine.all():
                continue
            flows, pdf = None, pdf[~mine]
        whole = pd.concat([held, pdf], ignore_index=True)
        if not len(whole):
            continue
        key, s = whole["key"].to_numpy(), whole["s"].to_numpy()
        whole = whole[np.append(True, (key[1:] != key[:-1]) | (s[1:] != s[:-1]))]  # a set that several tasks met
        key = whole["key"].to_numpy()
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(key)))
        if sizes[-1] > 2:
            first = whole.iloc[heads[-1]]
            flows = (int(key[-1]), int(first["s"]), int(first["n"]), int(whole["s"].iat[-1]))
            held = whole.iloc[:0]
        else:
            held, whole, heads, sizes = whole.iloc[heads[-1] :], whole.iloc[: heads[-1]], heads[:-1], sizes[:-1]
        if len(whole):
            yield out(whole, heads, sizes)
    if len(held):
        yield out(held, np.array([0]), np.array([len(held)]))


def _pair_frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"key": np.zeros(len(a), np.int64), "a": np.minimum(a, b), "b": np.maximum(a, b), "n": np.zeros(len(a), np.int64)})


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of sorted rows that hold whole buckets."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        if held[0]["key"].iat[0] == pdf["key"].iat[-1]:
            continue
        whole = pd.concat(held, ignore_index=True)
        end = int(np.searchsorted(whole["key"].to_numpy(), whole["key"].iat[-1]))
        held = [whole.iloc[end:]]
        yield whole.iloc[:end]
    if held:
        yield pd.concat(held, ignore_index=True)


def _pairs_of(s: np.ndarray, n: np.ndarray, maps: np.ndarray, group: np.ndarray, rows: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's given rows with later ones that no bound rules out and that no sure link or ``group`` joins already."""
    for i in rows:
        later = i + 1 + np.flatnonzero((group[i + 1 :] != group[i]) & _sizes_near(n[i + 1 :], n[i]))
        if not len(later):
            continue
        say = verdicts(np.bitwise_count(maps[later] ^ maps[i]).sum(axis=1, dtype=np.int64), n[later] + n[i])
        sure, first = np.unique(group[later[say == 1]], return_index=True)
        linked = later[say == 1][first]
        if len(sure):
            group[np.isin(group, sure)] = group[i]
        open_ = later[(say == 0) & (group[later] != group[i])]
        both = np.concatenate([linked, open_])
        if len(both):
            yield np.full(len(both), s[i]), s[both]


def _bucket_pairs(first: int, last: int):
    """Pairs of the rows ``first`` to ``last`` of every bucket with later ones; a row without ``b`` says that a bucket has more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(batches):
            key, s, n = pdf["key"].to_numpy(), pdf["s"].to_numpy(), pdf["n"].to_numpy().astype(np.int64)
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(heads, len(key)))
            maps = np.frombuffer(b"".join(pdf["map"]), np.uint64).reshape(len(pdf), -1)
            group = np.unique(pdf["root"].to_numpy(), return_inverse=True)[1]
            more = False
            for head, size in zip(heads.tolist(), sizes.tolist(), strict=True):
                at = slice(head, head + size)
                own = group[at]
                for i in range(first, min(last, size - 1), 256):
                    got = list(_pairs_of(s[at], n[at], maps[at], own, range(i, min(i + 256, last, size - 1))))
                    if got:
                        yield _pair_frame(*(np.concatenate(x) for x in zip(*got, strict=True)))[["a", "b"]].astype({"b": "Int64"})
                more = more or bool((own[last:] != own[-1]).any())
            if more:
                yield pd.DataFrame({"a": [0], "b": [None]}).astype({"b": "Int64"})

    return run


def _by_key(rows: DataFrame) -> DataFrame:
    # Rows stand in the same order in every bucket, so buckets of one group share their first rows.
    return rows.repartition("key").sortWithinPartitions("key", F.xxhash64("s"))


def _map_verdict(a: Column, b: Column, sizes: Column) -> Column:
    @F.pandas_udf(T.IntegerType())
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, two, total in batches:
            if not len(one):
                yield pd.Series([], dtype=np.int32)
                continue
            x, y = (np.frombuffer(b"".join(m), np.uint64).reshape(len(m), -1) for m in (one, two))
            yield pd.Series(verdicts(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), total.to_numpy().astype(np.int64)), dtype=np.int32)

    return of(a, b, sizes)


def _small(names: DataFrame) -> DataFrame:
    """A table that is to be broadcast if it has few rows."""
    return F.broadcast(names) if names.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS else names


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose SimHash fingerprints are linked by the operator, or equal."""
    named = nodes.select(F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "s")
    first = cut(named.groupBy("f").agg(F.min("s").alias("s")), "near-prints")
    links = forest_links(nodes.select(F.array("fp").alias("fp")).distinct(), 64, 3)
    over = links.join(first.select(F.col("f").alias("u"), F.col("s").alias("a")), "u").join(first.select(F.col("f").alias("v"), F.col("s").alias("b")), "v")
    equal = named.withColumnRenamed("s", "b").join(first.withColumnRenamed("s", "a"), "f").where("a <> b")
    pairs = over.select("a", "b").unionByName(equal.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _against_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether each member is near to its head, whose set stands before those of its members."""
    at, own = None, np.zeros(0, np.int64)
    for pdf in batches:
        out = []
        for head, salt, total, name, x in zip(pdf["head"].tolist(), pdf["salt"].tolist(), pdf["total"].tolist(), pdf["s"].tolist(), pdf["x"], strict=True):
            if not total:
                at, own = (head, salt), x
            else:
                assert at == (head, salt)
                shared = len(np.intersect1d(own, x, assume_unique=True))
                out.append((min(head, name), max(head, name), (PART + WHOLE) * shared >= PART * total))
        yield pd.DataFrame(out, columns=["a", "b", "near"])


def similar_groups(texts: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, root) of the shingle sets that links of a similarity of SIMILAR or more join to others.

    ``texts`` has rows (mark, text), ``nodes`` a row (s, n, map, fp, mark) for each set, with the mark
    of one of its rows, and ``keys`` the rows (key, s, n) of the buckets. First come the links of the
    SimHash operator and the pairs of each bucket's first set; buckets whose sets aren't all joined
    by then go on in rounds of growing numbers of rows. A pair is ruled out by its sizes or parity
    maps, which are bounds that no near pair fails, joined over checked links already, sure by its
    maps (see ``verdicts``), or checked on its complete sets.
    """
    found = cut(_by_key(keys).mapInPandas(_first_pairs, "key long, a long, b long, n int"), "near-first")
    pairs = cut(found.where("b is not null").select("a", "b").unionByName(_simhash_pairs(nodes)).distinct(), "near-pairs")
    left = found.where("b is null").select("key", F.col("a").alias("s"), "n")

    def side(x: str) -> DataFrame:
        return nodes.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"map{x}"))

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, near) that maps don't show to be far; ``near`` is right for all of them."""
        with scratch(pairs.sparkSession):
            both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("total", F.col("na") + F.col("nb"))
            say = cut(both.select("a", "b", "total", _map_verdict(F.col("mapa"), F.col("mapb"), F.col("total")).alias("say")).where("say >= 0"), "near-say")
            near = say.where("say = 1").select("a", "b", F.lit(True).alias("near"))
            return keep(near.unionByName(compared(say.where("say = 0"))), "near-checked")

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, near) by their complete sets.

        Of a pair the set with more pairs is the head. Sets of members go to their head's, which
        has a copy for every MEMBERS of them, so each is sent once and no task gets all of a head's.
        """
        ends = pairs.select(F.explode(F.array("a", "b")).alias("s")).groupBy("s").agg(F.count("*").alias("d"))
        both = pairs.join(ends.select(F.col("s").alias("a"), F.col("d").alias("da")), "a").join(ends.select(F.col("s").alias("b"), F.col("d").alias("db")), "b")
        first = F.col("da") >= F.col("db")
        member = F.when(first, F.col("b")).otherwise(F.col("a"))
        salt = F.pmod(F.xxhash64(member), F.ceil(F.greatest("da", "db") / MEMBERS)).cast("int")
        roles = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("head"), member.alias("s"), "total", salt.alias("salt"))
        roles = roles.unionByName(roles.select("head", F.col("head").alias("s"), F.lit(0).alias("total"), "salt").distinct())
        roles = roles.join(nodes.select("s", "mark"), "s").groupBy("mark").agg(F.collect_list(F.struct("head", "salt", "total", "s")).alias("roles"))
        read = texts.join(_small(cut(roles, "near-roles")), "mark").select("roles", _shingle_set(F.col("text")).alias("x"))
        sets = read.select(F.inline("roles"), "x").repartition("head", "salt").sortWithinPartitions("head", "salt", "total", "s")
        return sets.mapInPandas(_against_heads, "a long, b long, near boolean").distinct()

    seen = checked(pairs)
    first, last, rows = 1, ROUND, None
    while True:
        groups = components(seen.where("near").select(F.col("a").alias("u"), F.col("b").alias("v")))
        rooted = (left if rows is None else rows).join(groups.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
        # Buckets that are all one group by now are done.
        open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        rows = rooted.join(open_, "key", "left_semi")
        if first == 1:
            rows = rows.join(nodes.select("s", "map"), "s")
        rows = cut(rows, "near-open")
        if rows.isEmpty():
            return groups
        found = cut(_by_key(rows).mapInPandas(_bucket_pairs(first, last), "a long, b long").distinct(), "near-pairs")
        new = found.where("b is not null").join(seen.where("not near").select("a", "b"), ["a", "b"], "left_anti")
        seen = seen.unionByName(checked(new))
        if found.where("b is null").isEmpty():
            return components(seen.where("near").select(F.col("a").alias("u"), F.col("b").alias("v")))
        rows = rows.drop("root")
        first, last = last, ROUND * last


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest id, with its columns as they were.

    Near-duplicates are texts whose sets of shingles of five words have a similarity of 0.8 or
    more, and groups are what such links connect. Candidates are the pairs of the SimHash operator
    (fingerprints of the sets, 64 bits, 3 of them apart), and for those it misses the sets that
    share one of their first hashes in an order of all hashes (see ``prefix_of``), which misses no
    such pair. Null texts are copies of empty ones; null ids come last. Of repeated rows one
    stays. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with scratch(docs.sparkSession):
        given = docs.select("doc_id", F.md5(text.cast("binary")).alias("h"), text.alias("text"))
        kind = given.schema["doc_id"].dataType.simpleString()
        rows = given.mapInPandas(_set_rows, f"doc_id {kind}, h string, s long, n int, map binary, fp long")
        rows = cut(rows.withColumn("mark", _mark(F.col("doc_id"), F.col("h"))), "near-rows")
        nodes = cut(rows.groupBy("s").agg(F.min("mark").alias("mark"), *[F.first(c).alias(c) for c in ("n", "map", "fp")]), "near-nodes")
        keys = "key long, s long, n int"
        own = given.select("text")
        full = own.mapInPandas(_key_rows(np.zeros(0, np.uint64)), keys).groupBy("key").count().where(F.col("count") > FEW)
        common = [r["key"] for r in full.orderBy(F.desc("count"), "key").limit(COMMON_HASHES).collect()]
        common = np.sort(np.array(common, np.int64).view(np.uint64))
        texts = given.select(_mark(F.col("doc_id"), F.col("h")).alias("mark"), "text")
        groups = similar_groups(texts, nodes, own.mapInPandas(_key_rows(common), keys))
        least = rows.groupBy("s", "h").agg(F.min("doc_id").alias("least"))
        rooted = least.join(groups.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
        first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "h"))
        winners = rooted.groupBy("root").agg(first.alias("w")).select(_mark(F.col("w.least"), F.col("w.h")).alias("__mark"))
        each = cut(rows.groupBy(F.col("mark").alias("__mark")).count(), "near-marks")
        gone = keep(each.join(winners, "__mark", "left_anti").select("__mark"), "near-gone")
        twice = keep(each.where("count > 1").join(winners, "__mark", "left_semi").select("__mark"), "near-twice")
    marked = docs.withColumn("__mark", _mark(F.col("doc_id"), F.md5(text.cast("binary"))))
    kept = marked.join(_small(gone), "__mark", "left_anti")
    if not twice.isEmpty():
        twice = _small(twice)
        kept = kept.join(twice, "__mark", "left_anti").unionByName(kept.join(twice, "__mark", "left_semi").dropDuplicates(["__mark"]))
    return kept.select(*[F.col(c) for c in docs.columns])


def _mark(doc_id: Column, h: Column) -> Column:
    """What names a row: 16 bytes of its id, which may be null, and its text's hash."""
    return F.unhex(F.md5(F.concat_ws(" ", h, doc_id.cast("string"))))
