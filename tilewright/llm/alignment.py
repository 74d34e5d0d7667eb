"""Alignment of the tokens of two tokenizers over the same bytes.

Each side's token ends are filed in a dictionary from end to index. The ends that both have, in
order, cut the two id lists into groups, and every pair of tokens of a group is linked. The
corpus then says of each pair of ids how many documents hold it linked, and of each first id which
pairs are its most frequent.

Both tokenizers start anew at a blank that follows anything but white space, so a text is cut
there into segments that stand for themselves; a worker aligns each distinct segment once. Tokens
of a document are those of its segments in a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.lineage import cut
from tilewright.llm.token_output import byte_symbols
from tilewright.llm.workers import trim

#: Bytes that a worker remembers of segments with their alignment, roughly; some 350 of an entry are overhead.
MEMORY, OVERHEAD = 160 << 20, 350
#: Characters of texts that are worked on at once; one longer text is taken alone.
CHARS = 2_000_000
#: Pairs of ids that are broadcast with their counts, at most (16 bytes each); the rest is joined by a shuffle.
HOT_PAIRS = 200_000
#: Links of a group from which on they are counted by distinct ids.
LARGE = 4096
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
#: A blank after anything but white space begins a segment.
_segments = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*").findall
#: Fixed value: how sentence pieces write a blank.
BLANK = "▁"


class Aligner:
    """Tokens of a blank and a text by a byte-level BPE (A) and by sentence pieces (B), and their groups."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # The table of bytes of each id: A's entries decoded from their symbols, B's pieces.
        symbols = {s: bytes([b]) for s, b in byte_symbols().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = b"".join(symbols.get(c, c.encode()) for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.name = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.width = len(self.b_bytes)
        self.kind = np.int32 if len(self.a_bytes) * self.width < 2**31 else np.int64
        self._forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(BLANK, " ").encode()

    def _forget(self) -> None:
        """Nothing is known. Of segment k: ``written[k]``, ``sizes[k]``, how often it was met, and its links at ``starts[k]:starts[k + 1]``."""
        self.known: dict[str, int] = {}
        self.free = MEMORY
        self.written: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether the bytes differ
        self.starts = np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)

    def _forget_rare(self) -> None:
        """Make room: the half that was met least goes."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: len(self.met) // 2])
        names, written, sizes, met = list(self.known), self.written, self.sizes[keep], self.met[keep] // 2
        take, rows = self._rows(keep)
        pairs, times = self.pairs[take], self.times[take]
        self._forget()
        self.written = [written[k] for k in keep.tolist()]
        self._store([names[k] for k in keep.tolist()], sizes, rows, pairs, times)
        self.met = met

    def _rows(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the links of some segments one after the other, and how many each has."""
        rows = self.starts[segments + 1] - self.starts[segments]
        return np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows) + np.repeat(self.starts[segments], rows), rows

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids by A of a text that begins with a blank, and by B, which adds that blank itself."""
        # B adds no blank to an empty text, so one that ends another text is taken from there.
        b = self.b.encode(text[1:]) if text != " " else self.b.encode("x ")[len(self.b.encode("x")) :]
        return self.a.encode(text, add_special_tokens=False).ids, b

    def agree(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ends in bytes that both sides have, and how many tokens of each side stand before each."""
        a_at = dict(zip(np.cumsum(self.a_size[a]).tolist(), range(1, len(a) + 1), strict=True))
        b_at = dict(zip(np.cumsum(self.b_size[b]).tolist(), range(1, len(b) + 1), strict=True))
        common = sorted(a_at.keys() & b_at.keys())
        return common, *(np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (a_at, b_at))

    def _slices(self, a: list[int], b: list[int], k: np.ndarray, m: np.ndarray) -> list[str]:
        """Each group as text: the ids of A, a bar, the ids of B."""
        xs, ys = list(map(self.name.__getitem__, a)), list(map(self.name.__getitem__, b))
        out, i, j = [], 0, 0
        for to_a, to_b in zip(k.tolist(), m.tolist(), strict=True):
            if to_a - i == 1 and to_b - j == 1:
                out.append(f"{xs[i]}|{ys[j]}")
            else:
                out.append(f"{','.join(xs[i:to_a])}|{','.join(ys[j:to_b])}")
            i, j = to_a, to_b
        return out

    def _links(self, a: np.ndarray, b: np.ndarray, k: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, pair, times): every link of every group; a group of over LARGE links has a row for each distinct pair."""
        at_a, at_b = np.concatenate([[0], k[:-1]]), np.concatenate([[0], m[:-1]])
        n_b, many = m - at_b, (k - at_a) * (m - at_b)
        small = np.where(many <= LARGE, many, 0)
        group = np.repeat(np.arange(len(k)), small)
        place = np.arange(len(group)) - np.repeat(np.cumsum(small) - small, small)
        pair = a[at_a[group] + place // n_b[group]] * self.width + b[at_b[group] + place % n_b[group]]
        groups, pairs, times = [group], [pair], [np.ones(len(pair), np.int64)]
        for g in np.flatnonzero(many > LARGE):
            x, nx = np.unique(a[at_a[g] : k[g]], return_counts=True)
            y, ny = np.unique(b[at_b[g] : m[g]], return_counts=True)
            pairs.append((x[:, None] * self.width + y).ravel())
            times.append((nx[:, None] * ny).ravel())
            groups.append(np.full(len(pairs[-1]), g))
        group, pair, one = (np.concatenate(v) for v in (groups, pairs, times))
        order = np.argsort(group, kind="stable") if len(groups) > 1 else slice(None)
        return group[order], pair[order], one[order]

    def _add(self, segments: list[str], ends: np.ndarray, a: list[int], b: list[int]) -> None:
        """Remember segments that stand side by side, given their ends in bytes and all their tokens."""
        common, k, m = self.align(a, b)
        upto = np.searchsorted(common, ends) + 1  # groups up to each segment's end
        seg = np.searchsorted(upto, np.arange(len(common)), side="right")
        group, pair, times = self._links(np.asarray(a, np.int64), np.asarray(b, np.int64), k, m)
        by = lambda v: np.bincount(seg[group], weights=v, minlength=len(segments)).astype(np.int64)
        each = lambda v: np.diff(v[upto - 1], prepend=0)
        sizes = np.stack([each(k), each(m), np.diff(upto, prepend=0), by(times), np.zeros(len(ends), np.int64)], axis=1)
        written, g = self._slices(a, b, k, m), 0
        for to in upto.tolist():
            self.written.append(";".join(written[g:to]))
            g = to
        self._store(segments, sizes, by(np.ones(len(group))), pair, times)

    def _store(self, segments: list[str], sizes: np.ndarray, rows: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        first = len(self.sizes)
        self.known.update(zip(segments, range(first, first + len(segments)), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(rows)])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])
        self.met = np.concatenate([self.met, np.zeros(len(segments), np.int64)])
        self.free -= sum(OVERHEAD + 2 * len(s) + len(w) for s, w in zip(segments, self.written[first:], strict=True)) + 16 * len(pair)

    def learn(self, segments: list[str]) -> None:
        """Align segments that aren't known yet; all that may stand side by side are encoded as one text."""
        plain = [s for s in segments if BLANK not in s and not s[-1].isspace()]
        if plain:
            whole = "".join(plain)
            a, b = self.encode(whole)
            ends = np.cumsum([len(s.encode()) for s in plain])
            if self.agree(whole, a, b) and np.isin(ends, np.cumsum(self.a_size[a])).all() and np.isin(ends, np.cumsum(self.b_size[b])).all():
                self._add(plain, ends, a, b)
        for s in segments:
            if s not in self.known:
                a, b = self.encode(s)
                if self.agree(s, a, b):
                    self._add([s], np.array([len(s.encode())]), a, b)
                else:
                    self.written.append("")
                    self._store([s], np.array([[0, 0, 0, 0, 1]]), np.zeros(1, np.int64), self.pairs[:0], self.times[:0])

    def batch(self, texts: list[str]) -> dict[str, list]:
        """Digests of texts, and each one's distinct pairs of ids with the number of their links."""
        if self.free < 0:
            self._forget_rare()
        parts = [_segments(f" {t}") if t else [] for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        for at in range(0, len(new), 20_000):
            self.learn(new[at : at + 20_000])
        known = self.known
        ids = [list(map(known.__getitem__, p)) for p in parts]
        doc = np.repeat(np.arange(len(texts)), [len(i) for i in ids])
        at = np.fromiter(chain.from_iterable(ids), np.int64, len(doc))
        self.met += np.bincount(at, minlength=len(self.met))
        sums = np.stack([np.bincount(doc, weights=self.sizes[at, c], minlength=len(texts)) for c in range(5)], axis=1).astype(np.int64)
        good = sums[:, 4] == 0
        sums[~good] = 0
        # Each text's distinct segments with their number, and from them its pairs with the number of links.
        n = max(1, len(self.sizes))
        seen, many = np.unique(doc[good[doc]] * n + at[good[doc]], return_counts=True)
        seg_doc, seg = seen // n, seen % n
        take, lens = self._rows(seg)
        pair, links = self.pairs[take], self.times[take] * np.repeat(many, lens)
        span = len(self.a_bytes) * self.width
        key, inverse = np.unique(np.repeat(seg_doc, lens) * span + pair, return_inverse=True)
        total = np.bincount(inverse, weights=links, minlength=len(key)).astype(np.int64) if len(key) else links
        offsets = np.searchsorted(key // span, np.arange(len(texts) + 1)).astype(np.int32)
        digest = []
        for i, ok in zip(ids, good, strict=True):
            text = ";".join(map(self.written.__getitem__, i)) if ok else ""
            digest.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((key % span).astype(self.kind), total)]
        return {"n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "n_links": sums[:, 3], "groups_sha256": digest, "pairs": lists[0], "links": lists[1]}


def groups_of(aligner: Aligner, text: str | None) -> list[tuple[list[int], list[int]]]:
    """Groups of one whole text, as ids of both sides; none if it has no tokens."""
    if not text:
        return []
    a, b = aligner.encode(f" {text}")
    if not aligner.agree(f" {text}", a, b):
        return []
    _, k, m = aligner.align(a, b)
    return [(a[i:to_a], b[j:to_b]) for i, to_a, j, to_b in zip([0, *k[:-1]], k, [0, *m[:-1]], m, strict=True)]


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most CHARS characters, or of one."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def align_texts(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """The rows without their text, each with ``n_a, n_b, n_groups, n_links, groups_sha256`` and its ``pairs`` of ids (a * size of B + b) with their ``links``.

    Null and empty texts, and those whose bytes one tokenizer doesn't give back, have no tokens:
    numbers are 0 and the digest is empty. Texts are encoded whole. Columns with the names of
    results are replaced.
    """
    results = T.StructType([T.StructField(n, T.LongType()) for n in NUMBERS]).add("groups_sha256", "string")
    results = results.add("pairs", T.ArrayType(T.IntegerType() if _sizes(a_path, b_path)[2] is np.int32 else T.LongType())).add("links", T.ArrayType(T.LongType()))
    others = [f for f in docs.schema if f.name != text and f.name.lower() not in results.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for lo, hi in _pieces(texts):
                part, got = batch.slice(lo, hi - lo), aligner.batch(texts[lo:hi])
                made = [v if isinstance(v, pa.Array) else pa.array(v) for v in got.values()]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in others], *made], [*[f.name for f in others], *got])
                del part, got, made
            trim()

    return docs.mapInArrow(run, T.StructType([*others, *results]))


def _sizes(a_path: str, b_path: str) -> tuple[int, int, type]:
    """Sizes of the two vocabularies, and the type of a pair of ids."""
    a = Aligner(a_path, b_path)
    return len(a.a_bytes), a.width, a.kind


def pair_counts(coded: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many rows hold each pair, and whether no pair of its first id is in more."""
    counts = cut(coded.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    first = F.floor(F.col("pair") / width)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return cut(counts.withColumn("a", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def _split(counts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, HOT_PAIRS at most, and the others if there are any."""
    level = F.floor(F.log2("n")).cast("int")
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level).count().collect()), reverse=True)  # 64 rows at most
    taken, least = 0, 64
    for k, n in levels:
        if taken + n > HOT_PAIRS:
            break
        taken, least = taken + n, k
    rest = counts.where(level < least) if levels and levels[-1][0] < least else None
    return counts.where(level >= least), rest


def align_corpus(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """The rows without their text, with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A pair's count is the number of rows that hold it linked, so repeated rows count each. ``n_best``
    are the links whose pair has its first id's highest count, and ``count_sum`` is the sum of the
    counts over the links. Frequent pairs are broadcast, HOT_PAIRS at most; what is left is joined
    by pair, and no such pair is in more rows than a broadcast one. An empty table gives none.
    """
    own = [c for c in docs.columns if c != text and c.lower() not in (*NUMBERS, "n_best", "count_sum", "groups_sha256")]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*own).alias("own") if own else F.lit(0).alias("own"), F.col(text).alias("text"))
    coded = cut(align_texts(rows, a_path, b_path), "aligned")
    hot, rest = _split(pair_counts(coded, _sizes(a_path, b_path)[1]))
    each = coded.select("row", F.inline(F.arrays_zip("pairs", "links"))).toDF("row", "pair", "links")
    value = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    sums = value(each.join(F.broadcast(hot), "pair"))
    if rest is not None:
        rare = each.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rest, "pair")
        sums = sums.unionByName(value(rare)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = coded.drop("pairs", "links").join(sums, "row", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*(["own.*"] if own else []), "n_a", "n_b", "n_groups", "n_links", number("n_best"), number("count_sum"), "groups_sha256")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
