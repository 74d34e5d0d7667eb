"""A training corpus from ``documents``: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.functions.lineage import cut, fresh_path
from tilewright.llm.decontaminate import drop_contaminated
from tilewright.llm.mixing import mix
from tilewright.llm.quality import fit_quality, keep_quality
from tilewright.llm.simhash import drop_near_duplicates
from tilewright.llm.token_output import token_digest, write_tokens


#: What a Python worker gets at once, unless the session says otherwise: rows, and bytes for long texts. Workers
#: and the executor's own buffers take several times as much, beside the heap.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}


def _small_batches(spark: SparkSession) -> None:
    for name, (usual, small) in BATCHES.items():
        now = spark.conf.get(name, None)
        if now == usual or usual is None and int(now or 1 << 62) > int(small):
            spark.conf.set(name, small)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts have no words and go; repeated rows share their verdict; an empty table stays empty."""
    _small_batches(spark)
    return keep_quality(docs, fit_quality(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: of repeated rows, and of null and empty texts, one stays. An empty table stays empty."""
    _small_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts hold none; equal rows share their verdict; without items all stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights takes them; null and empty texts once, null sources as a source of their own."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as ORC files; returns what the files say of each document. Null and empty texts have the end id only; repeated rows are written each."""
    path = fresh_path(spark, "corpus-tokens")
    write_tokens(docs, path, "byte_bpe_50k.json")
    return token_digest(spark, path)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]
#: Trained scores, fingerprints and token ids have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
