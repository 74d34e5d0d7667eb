"""Hard negatives by a vertical scan of vectors: columns of dimensions, read until bounds settle.

Vectors lie in blocks, each as columns of dimensions with every column's least and greatest value.
An anchor reads the columns of a block in the descending order of its own magnitudes. What the
columns not yet read can still add lies between sums of their least and greatest contributions,
so each candidate has bounds; those whose bounds leave every window drop out of the block's
bitmap. What is left when all columns are read has its exact score.

Two scans: the first finds each anchor's positives, the highest scores of its own label; the
second fills the windows that the positives' scores open below themselves for other labels.
Anchors are taken in chunks of a bounded size, which are broadcast, and every block meets
every chunk once; a task keeps only the best few of each window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.lineage import cut
from tilewright.functions.ordering import with_index
from tilewright.llm.workers import trim

#: Vectors of a block, anchors of a chunk (broadcast: 8 bytes a dimension and anchor), and dimensions read at once.
BLOCK, CHUNK, STEP = 4096, 20_000, 8
#: Fixed values of the contract: components are floor(SCALE * x); a negative scores from LOW to HIGH hundredths of the positive.
SCALE, LOW, HIGH = 256, 80, 100
#: Rows without an id come last among equal scores.
NO_ID = np.iinfo(np.int64).max


@dataclass
class Best:
    """The highest ``most`` scores so far, ties by the smaller id; ``row`` names the vector itself."""

    most: int
    score: np.ndarray
    id: np.ndarray
    row: np.ndarray

    @staticmethod
    def none(most: int, kind: type) -> Best:
        return Best(most, np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        score, ids, row = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.row, row])
        first = np.lexsort((row, ids, -score))[: self.most]
        self.score, self.id, self.row = score[first], ids[first], row[first]

    def least(self, low: float) -> float:
        """The score below which nothing can come in."""
        return max(low, self.score[-1]) if len(self.score) == self.most else low


class Block:
    """Columns of some vectors, with the bounds of each column."""

    def __init__(self, columns: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.columns, self.ids, self.rows, self.labels = columns, ids, rows, labels
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)

    def scan(self, q: np.ndarray, alive: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of the bitmap whose scores lie between two bounds, and these scores, exactly.

        Columns are read in the descending order of the anchor's magnitudes; after every STEP of
        them, candidates whose remaining contributions can't bring them between the bounds leave.
        """
        order = np.argsort(-np.abs(q), kind="stable")
        a, b = q[order] * self.low[order], q[order] * self.high[order]
        # What is still to come after each number of columns read, at least and at most.
        to_come = [np.concatenate([np.cumsum(f(a, b)[::-1])[::-1], np.zeros(1, a.dtype)]) for f in (np.minimum, np.maximum)]
        left = np.flatnonzero(alive)
        partial = np.zeros(len(left), q.dtype)
        for at in range(0, len(order), STEP):
            if not len(left):
                break
            dims = order[at : at + STEP]
            read = self.columns[dims] if len(left) == self.columns.shape[1] else self.columns[np.ix_(dims, left)]
            partial = partial + q[dims] @ read
            done = min(at + STEP, len(order))
            stay = (partial + to_come[1][done] >= least) & (partial + to_come[0][done] <= most)
            if not stay.all():
                left, partial = left[stay], partial[stay]
        return left, partial


def _kind(dims: int, high: float) -> type:
    """Numbers in which all scores are exact: doubles where they suffice, else longs."""
    if dims * high * high >= 2**62:
        raise ValueError("components are too large for scores that are longs")
    return np.float64 if dims * high * high < 2**53 else np.int64


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, id, label, v): rows that take part, with whole components. Null labels and vectors, and null or non-finite components, don't.

    Where the id is divisible by 7, the label moves on by one of ten. Vectors of different lengths
    are compared as if the shorter ended in zeros. Components whose scores wouldn't be longs are an error.
    """
    x = F.transform(F.col(vector), lambda e: F.floor(F.lit(SCALE) * e.cast("double")))
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))
    ok = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), fine)
    moved = F.when(F.col(id_col) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label)).cast("long")
    huge = F.exists(F.col(vector), lambda e: F.abs(e.cast("double")) >= float(2**52 // SCALE))
    value = F.when(huge, F.raise_error(F.lit("a component is too large for exact scores"))).otherwise(x).cast("array<bigint>")
    return df.where(ok).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), moved.alias("label"), value.alias("v"))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """dims x vectors, zeros where a vector is shorter."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = lists.flatten().to_numpy()
    return np.ascontiguousarray(out.T)


def pack(vectors: DataFrame, dims: int) -> DataFrame:
    """Blocks of at most BLOCK vectors as bytes: (n, ids, rows, labels, columns).

    Vectors of a label lie together inside a task, so that most blocks hold one label and the
    first scan reads an anchor's own label only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = part.column("id").fill_null(NO_ID).to_numpy()
                values = [ids, part.column("row").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"), dims)]
                cells = [pa.array([part.num_rows], pa.int32()), *[pa.array([v.astype("<i8").tobytes()]) for v in values]]
                yield pa.RecordBatch.from_arrays(cells, ["n", "ids", "rows", "labels", "columns"])
            trim()

    return vectors.sortWithinPartitions("label", "id").mapInArrow(run, "n int, ids binary, rows binary, labels binary, columns binary")


def _blocks(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[Block]:
    for batch in batches:
        for r in batch.to_pylist():
            ids, rows, labels, columns = (np.frombuffer(r[c], "<i8") for c in ("ids", "rows", "labels", "columns"))
            yield Block(columns.reshape(-1, r["n"]).astype(kind), ids, rows, labels)
        trim()


def _best_rows(best: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    """(anchor, window, score, id, row) of what each window holds."""
    found = [(a, w, int(s), int(i), int(r)) for a, w, b in best for s, i, r in zip(b.score, b.id, b.row, strict=True)]
    columns = list(zip(*found, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["anchor", "window", "score", "id", "row"])


FOUND = "anchor long, window long, score long, id long, row long"


def _merge(found: DataFrame, most: int) -> DataFrame:
    """The best of what the tasks have kept, with a rank from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _scan_positives(blocks: DataFrame, chunk, kind: type, most: int) -> DataFrame:
    """Highest scores of each anchor's own label, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, q = chunk.value
        best = [Best.none(most, kind) for _ in rows]
        for block in _blocks(batches, kind):
            for label in np.unique(block.labels):
                mine = block.labels == label
                for n in np.flatnonzero(labels == label):
                    left, score = block.scan(q[n].astype(kind), mine & (block.rows != rows[n]), best[n].least(-np.inf), np.inf)
                    best[n].add(score, block.ids[left], block.rows[left])
        yield _best_rows([(n, 0, b) for n, b in enumerate(best)])

    return _merge(blocks.mapInArrow(run, FOUND), most)


def _scan_negatives(blocks: DataFrame, chunk, windows, kind: type, most: int) -> DataFrame:
    """Best of other labels in each window of scores of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, q = chunk.value
        open_ = windows.value
        best = {(n, w): Best.none(most, kind) for n, tops in open_.items() for w, _ in tops}
        for block in _blocks(batches, kind):
            for n, tops in open_.items():
                # The smallest whole score that is at least LOW hundredths of the positive's.
                spans = [(best[n, w], max(best[n, w].least(-np.inf), -(-LOW * top // HIGH)), top) for w, top in tops]
                spans = [s for s in spans if s[1] <= s[2]]
                if not spans:
                    continue
                left, score = block.scan(q[n].astype(kind), block.labels != labels[n], min(s[1] for s in spans), max(s[2] for s in spans))
                for b, low, top in spans:
                    inside = (score >= low) & (score <= top)
                    if inside.any():
                        b.add(score[inside], block.ids[left[inside]], block.rows[left[inside]])
        yield _best_rows([(n, w, b) for (n, w), b in best.items()])

    return _merge(blocks.mapInArrow(run, FOUND), most)


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible by ``every``.

    ``vectors`` come from ``quantised``. Repeated rows count each: a copy of an anchor is another
    row, which may be its positive, and an anchor itself. A positive whose score is negative opens no
    window. Rows without an id are no anchors and come last among ties. Without anchors, or in an
    empty table, there is no result.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors, "vectors")
    size = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dims, high = size[0] or 0, float(size[1] or 0)
    kind = _kind(max(1, dims), high)
    blocks = cut(pack(vectors, dims), "blocks")
    anchors = vectors.where(F.col("id") % every == 0)
    count = anchors.count()
    pieces = max(1, -(-count // chunk))
    dealt = with_index(anchors, [F.col("row")], "n").withColumn("chunk", F.floor(F.col("n") / chunk)) if pieces > 1 else anchors.withColumn("chunk", F.lit(0))
    out = None
    for c in range(pieces):
        got = dealt.where(F.col("chunk") == c).select("row", "id", "label", "v").toArrow()
        rows, ids, labels = (got.column(n).to_numpy() for n in ("row", "id", "label"))
        q = _matrix(got.column("v").combine_chunks(), dims).T if len(rows) else np.zeros((0, dims), np.int64)
        shared = spark.sparkContext.broadcast((rows, labels, q))
        positives = _scan_positives(blocks, shared, kind, n_positives).collect() if len(rows) else []
        tops: dict[int, list[tuple[int, int]]] = {}
        for r in positives:
            if r["score"] >= 0:
                tops.setdefault(r["anchor"], []).append((r["rank"], r["score"]))
        listed = [{"a": r["anchor"], "w": r["rank"], "anchor_id": int(ids[r["anchor"]]), "positive_id": None if r["id"] == NO_ID else r["id"], "positive_score": r["score"]} for r in positives]
        pairs = spark.createDataFrame([tuple(x.values()) for x in listed], "a long, w long, anchor_id long, positive_id long, positive_score long")
        found = _scan_negatives(blocks, shared, spark.sparkContext.broadcast(tops), kind, n_negatives)
        part = found.join(F.broadcast(pairs), (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("w"))).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NO_ID, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        out = part if out is None else out.unionByName(part)
    return out


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


OP12_SQL = f"""
with e as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.r as ar, b.r as br, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
  from e a join e b on a.r <> b.r where a.vec_id % 100 = 0
), p as (
  select * from s where same qualify row_number() over (partition by ar order by score desc, vec_id, br) <= 5
)
select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.ar, p.br order by s.score desc, s.vec_id, s.br)::int as rank,
       s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.ar = p.ar and not s.same and {LOW} * p.score <= 100 * s.score and s.score <= p.score
qualify row_number() over (partition by p.ar, p.br order by s.score desc, s.vec_id, s.br) <= 5
"""
