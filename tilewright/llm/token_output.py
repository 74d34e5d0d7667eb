"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt into ranges of ascending ids and encoded inside the task that writes
their file, so ids never cross the network. Each file is one range; part numbers ascend with
the ids. Stripes are read in parallel, and a lookup of some documents skips files and stripes
by their statistics, row indexes and Bloom filters.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions.lineage import fresh_path
from tilewright.functions.tables import small_table
from tilewright.llm.workers import trim

#: Bytes that a worker remembers of pretokens with their ids; some 200 of an entry are overhead.
MEMORY, OVERHEAD = 64 << 20, 200
#: Fixed value: how byte-level BPE files of this kind split a text into pretokens.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ORC_OPTIONS = {"orc.compress": "ZSTD", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "orc.bloom.filter.fpp": "0.01"}


class _Memory(dict):
    """Ids, as bytes, of the strings that came first, which has all frequent ones; beyond ``free`` bytes the rest is made anew each time."""

    def __init__(self, make, free: int):
        super().__init__()
        self.make, self.free = make, free

    def __missing__(self, key: str) -> bytes:
        coded = self.make(key)
        cost = OVERHEAD + 4 * len(key) + len(coded)
        if cost <= self.free:
            self.free -= cost
            self[key] = coded
        return coded


class Encoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct pretoken.

    Standing alone, a pretoken encodes as it does inside its text, so the ids of a text are those
    of its pretokens in a row.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.symbols = str.maketrans({chr(b): c for c, b in byte_symbols().items()})
        self.pretokens = _Memory(self._one, MEMORY)
        self.exact, self.quick = regex.compile(SPLIT).findall, re.compile(_quick_split()).findall
        self.far = re.compile("[\U00010000-\U0010ffff]").search
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}

    def _one(self, pretoken: str) -> bytes:
        if pretoken in self.special:
            ids = [self.special[pretoken]]
        else:  # the model is the library's last step, after the bytes have got their symbols
            ids = [t.id for t in self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.symbols))]
        return array("i", ids).tobytes()

    def _split(self, text: str) -> list[str]:
        return self.exact(text) if self.far(text) else self.quick(text)

    def _words(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self._split(text)
        parts: list[str] = [text]
        for s in self.special:
            parts = [q for p in parts for q in ([p] if p in self.special else _between(p, s))]
        return [w for p in parts for w in ([p] if p in self.special else self._split(p))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        return [b"".join(map(self.pretokens.__getitem__, self._words(t))) for t in texts]


def _quick_split() -> str:
    """SPLIT for the standard library's faster patterns, right for texts of the basic plane: its classes are listed by ranges."""
    import regex

    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(kind: str) -> str:
        out = ""
        for m in regex.finditer(f"{kind}+", plane):
            out += re.escape(m.group()[0]) + "-" + re.escape(m.group()[-1])
        return out

    letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return rf" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{letter}{number}{space}]+|[{space}]+(?![^{space}])|[{space}]+"


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or from 256 on in turn."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _between(text: str, mark: str) -> list[str]:
    """The text's parts with the mark between them, empty parts left out."""
    out: list[str] = []
    for i, part in enumerate(text.split(mark)):
        out += ([mark] if i else []) + ([part] if part else [])
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``doc_id, row, n_tokens, ids`` as ORC files in ascending order of the ids.

    ``row`` numbers the documents of a file; ``ids`` ends with ``end_id``. Null texts are empty
    and give the end id alone; null ids come first; rows of equal id go by a hash of the text.
    Repeated rows are all written. An empty table gives files without rows. Other columns of
    the input are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        e, row, end = encoder(public_tokenizers.path(tokenizer)), 0, np.array([end_id], "<i4").tobytes()
        for batch in batches:
            for at, count in _slices(batch.column(1)):
                part = batch.slice(at, count)
                coded = e.encode(part.column(1).to_pylist())
                sizes = np.array([len(c) // 4 + 1 for c in coded], np.int64)
                ids = np.frombuffer(b"".join([x for c in coded for x in (c, end)]), np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))
                rows = pa.array(np.arange(row, row + count, dtype=np.int64))
                row += count
                yield pa.RecordBatch.from_arrays([part.column(0), rows, pa.array(sizes), listed], ["doc_id", "row", "n_tokens", "ids"])
                del part, coded, ids, listed
                trim()

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    out = ordered.mapInArrow(encode, f"doc_id {kind}, row long, n_tokens long, ids array<int>")
    out.write.options(**ORC_OPTIONS | {"orc.bloom.filter.columns": "doc_id"}).orc(path)


def _slices(texts: pa.Array, most: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes each; a longer text is a run of its own."""
    size = texts.nbytes // max(1, len(texts))
    step = max(1, most // max(1, size))
    for at in range(0, len(texts), step):
        yield at, min(step, len(texts) - at)


def read_tokens(spark: SparkSession, path: str, wanted: list | None = None, id_type: str = "bigint") -> DataFrame:
    """The files' rows with their part number; ``wanted`` ids are looked up through the indexes."""
    df = spark.read.schema(f"doc_id {id_type}, row long, n_tokens long, ids array<int>").orc(path)
    if wanted is not None:
        df = df.where(F.col("doc_id").isin(wanted))
    return df.withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and CRC-32 of each row's ids, straight from the column's buffer."""
    for batch in batches:
        ids = batch.column(3)
        ends = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
        crcs = [zlib.crc32(data[a * 4 : b * 4]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        columns = [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files.

    ``start`` is the number of ids of all documents before it; ``ids_crc32`` is unsigned, over the
    ids as little-endian unsigned 32-bit integers. The totals of the files, one row
    each, go to the driver; inside the files the sums run in parallel.
    """
    read = read_tokens(spark, path, id_type=id_type)
    totals = sorted((r["part"], r["n"]) for r in read.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    firsts, run = [], 0
    for part, n in totals:
        firsts.append({"part": part, "first": run})
        run += n
    table = small_table(spark, firsts, "part:int,first:bigint")
    schema = f"doc_id {id_type}, part int, row long, n_tokens long, ids_crc32 long"
    digest = read.select("doc_id", "part", "row", "ids").mapInArrow(_digests, schema)
    ahead = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    digest = digest.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))
    out = digest.join(F.broadcast(table), "part")
    return out.select("doc_id", (F.col("first") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, "byte_bpe_50k.json")
    return token_digest(spark, path)
