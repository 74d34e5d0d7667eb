"""Quality classifier trained without labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over
the counts of all vote patterns of the corpus estimates each labeller's accuracies and gives
each pattern the posterior that its documents are good. These posteriors are the targets of a
linear scorer over hashed features, fitted on a bounded sample and applied to every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.lineage import cut
from tilewright.functions.tables import small_table
from tilewright.llm.workers import trim

#: Slots of the hashed features.
DIM = 2048
#: Documents that the scorer is fitted on: at most so many of each side, with the lowest hashes.
SAMPLE = 1500
GOOD, BAD, NONE = 1, 0, -1
#: Frequent words of the corpus's languages.
COMMON = (
    "the of and to in is it that for was on are be this with as from by at an or not "
    "der die das und den von zu mit ist nicht ein eine auf im dem des sich "
    "le la les de des et un une du en que qui dans pour sur est par au "
    "el los las del y que es por con para una su se lo al"
).split()
#: Labellers that know some languages only; in a corpus of others they would call most texts bad.
LANGUAGE = ("stops", "common", "length")
_COMMON = frozenset(w.encode() for w in COMMON)


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(0x80, 0x100))
_ODD = rb"#$%&*|<>=@^~_{}[]\/+`"


def _measures(text: str) -> dict[str, float]:
    data = text.encode()
    words = data.split()
    many = lambda chars: len(data) - len(data.translate(None, chars))
    w, letters = max(1, len(words)), many(_LETTERS)
    return {
        "words": len(words),
        "odd": many(_ODD) / max(1, len(data)),
        "upper": many(_UPPER) / max(1, letters),
        "bars": data.count(b"|") / w,
        "again": sum(map(eq, words, words[1:])) / w,
        "stops": many(b".!?") / w,
        "common": sum(map(_COMMON.__contains__, data.lower().split())) / w,
        "shouts": data.count(b"!") / w,
        "mean": letters / w,
    }


def _band(x: float, bad_from: float, good_to: float) -> int:
    return BAD if x >= bad_from else GOOD if x <= good_to else NONE


#: Votes from a text's measures. The labellers overlap, and each errs on its own.
LABELLERS = {
    "symbols": lambda m: _band(m["odd"], 0.04, 0.01),
    "capitals": lambda m: _band(m["upper"], 0.4, 0.12),
    "bars": lambda m: _band(m["bars"], 0.25, 0.03),
    "repeats": lambda m: _band(m["again"], 0.25, 0.05),
    "stops": lambda m: NONE if m["words"] < 40 else BAD if m["stops"] < 0.004 or m["stops"] > 0.5 else GOOD if m["stops"] > 0.02 else NONE,
    "common": lambda m: NONE if m["words"] < 40 else BAD if m["common"] < 0.03 else GOOD if m["common"] > 0.12 else NONE,
    "shouts": lambda m: _band(m["shouts"], 0.25, 0.05),
    "length": lambda m: BAD if not 2 <= m["mean"] <= 14 else GOOD if 3 < m["mean"] < 10 else NONE,
}


def votes_of(text: str) -> list[int]:
    """Votes of all labellers; a text without words is bad to all of them."""
    m = _measures(text)
    return [f(m) for f in LABELLERS.values()] if m["words"] else [BAD] * len(LABELLERS)


def vote_code(text: Column) -> Column:
    """All votes of a text in one number: digits of base 3, from 0 for none to 2 for good."""

    @F.pandas_udf(T.IntegerType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sum((v + 1) * 3**i for i, v in enumerate(votes_of(t))) for t in texts.tolist()], dtype=np.int32)
            del texts
            trim()

    return of(F.coalesce(text, F.lit("")))


def votes_in(code: int) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(len(LABELLERS))]


@dataclass(frozen=True)
class LabelModel:
    """Shares of the good class and of the kinds of bad, and by labeller and class the chances of its votes.

    Class 0 is good. Class k + 1 is the kind of bad that labeller k is after: junk of different
    kinds sets off different labellers, so one class for all of it would hide their accuracies.
    """

    names: list[str]
    shares: np.ndarray
    chances: np.ndarray  # labeller x class x vote (none, bad, good); a missing vote says nothing, so its chance is 1

    used: np.ndarray  # by labeller: whether its votes count

    def classes(self, votes: np.ndarray) -> np.ndarray:
        votes = np.where(self.used, votes, NONE)
        each = np.log(self.chances)[np.arange(len(self.names)), :, votes + 1]  # pattern x labeller x class
        score = each.sum(axis=1) + np.log(self.shares)
        score -= score.max(axis=1, keepdims=True)
        return np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that documents with these votes (rows of -1, 0, 1) are good."""
        return self.classes(votes)[:, 0]

    def accuracy(self) -> dict[str, tuple[float, float]]:
        """By labeller: the chance of a good vote on good documents, of a bad one on its own kind."""
        return {n: (float(c[0, 2]), float(c[k + 1, 1])) for k, (n, c) in enumerate(zip(self.names, self.chances, strict=True))}


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their numbers of documents.

    Starts from the votes themselves: a pattern belongs to the kinds of its bad votes, to the
    good class without any. A labeller of LANGUAGE that calls more of the corpus bad than good, mostly
    where no other labeller agrees, says nothing about single documents and is set aside.
    Kinds that a single labeller sees and errors on good documents would fit the votes alike, so
    a prior of one good vote a document on the good class decides for the kinds.
    """
    weighed = lambda vote: ((patterns == vote) * counts[:, None]).sum(0)
    said_bad = patterns == BAD
    others = said_bad.sum(1, keepdims=True) > said_bad  # whether another labeller says bad too
    agreed = ((said_bad & others) * counts[:, None]).sum(0)
    used = ~np.isin(names, LANGUAGE) | (weighed(BAD) <= weighed(GOOD)) | (2 * agreed > weighed(BAD))
    patterns = np.where(used, patterns, NONE)
    bad = patterns == BAD
    start = np.concatenate([np.where(bad.any(1), 0.1, 1.0)[:, None], 0.9 * bad / np.maximum(bad.sum(1, keepdims=True), 1)], axis=1) + 1e-3
    belongs = start / start.sum(1, keepdims=True)
    model = LabelModel(names, np.ones(0), np.ones(0), used)
    for _ in range(rounds):
        weight = (counts[:, None] * belongs).T  # class x pattern
        said = np.stack([((patterns == v).T[:, None, :] * weight[None]).sum(-1) for v in (BAD, GOOD)], axis=-1) + 0.1
        said[:, 0, 1] += counts.sum()
        said /= said.sum(-1, keepdims=True)
        chances = np.concatenate([np.ones_like(said[..., :1]), said], axis=-1)
        shares = weight.sum(1) + 0.1
        model = LabelModel(names, shares / shares.sum(), chances, used)
        new = model.classes(patterns)
        if np.abs(new - belongs).max() < 1e-6:
            break
        belongs = new
    return model


def _slot(name: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(name) % DIM


def features(texts: list[str]) -> np.ndarray:
    """Hashed features of each text: shares of its byte trigrams, of repeated and distinct words, one for a bias."""
    out = np.zeros((len(texts), DIM), np.float32)
    named = [_slot(k) for k in ("bias", "next word again", "distinct words", "no words")]
    for i, text in enumerate(texts):
        data = text.encode()
        words = data.split()
        for at in range(0, max(0, len(data) - 2), 1 << 20):
            b = np.frombuffer(data[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
            key = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            out[i] += np.bincount(((key * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64), minlength=DIM)
        total = out[i].sum()
        if total:
            out[i] = np.sqrt(out[i] / total)
        n = max(1, len(words))
        out[i, named] += [1, sum(map(eq, words, words[1:])) / n, len(set(words)) / n, float(not words)]
    return out


def train_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 300, decay: float = 1e-4, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic scorer for soft targets, by gradient steps with momentum (Adam)."""
    w, m, v = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - target) / max(1, len(x)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) / 5
    return w


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: Column) -> Column:
        """Chance from 0 to 1 that a text is good. The weights (DIM numbers) travel with the task."""
        weights = self.weights

        @F.pandas_udf(T.DoubleType())
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                texts, out = texts.tolist(), []
                for at in range(0, len(texts), 256):
                    out.append(1 / (1 + np.exp(-np.clip(features(texts[at : at + 256]) @ weights, -50, 50))))
                yield pd.Series(np.concatenate(out) if out else np.zeros(0))
                del texts
                trim()

        return of(F.coalesce(text, F.lit("")))


def fit_quality(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Fit the label model on all documents and the scorer on a sample.

    The vote patterns that reach the driver are at most 3 to the number of labellers. The sample
    is at most ``sample`` distinct texts on each side of a posterior of one half, those with the
    lowest hashes, so a refit agrees.
    """
    marked = cut(docs.select(F.xxhash64(text_col).alias("h"), vote_code(F.col(text_col)).alias("code")), "quality-votes")
    counted = sorted((r["code"], r["count"]) for r in marked.groupBy("code").count().collect())
    names = list(LABELLERS)
    if not counted:
        return QualityModel(LabelModel(names, np.ones(1), np.ones((len(names), 1, 3)) / 3, np.ones(len(names), bool)), np.zeros(DIM))
    patterns = np.array([votes_in(code) for code, _ in counted])
    model = fit_label_model(patterns, np.array([n for _, n in counted], float), names)
    listed = [{"code": code, "p": p} for (code, _), p in zip(counted, model.posterior(patterns).tolist(), strict=True)]
    table = small_table(docs.sparkSession, listed, "code:int,p:double")
    drawn = marked.distinct().join(F.broadcast(table), "code")
    sides = [drawn.where("p >= 0.5"), drawn.where("p < 0.5")]
    picked = sides[0].orderBy("h").limit(sample).unionByName(sides[1].orderBy("h").limit(sample)).select("h", "p")
    # At most 2 * sample rows, so the texts are fetched with one pass and a broadcast.
    own = docs.select(F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = own.join(F.broadcast(picked), "h").dropDuplicates(["h"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "p": pdf["p"], "x": list(map(bytes, features(pdf["text"].tolist()).astype(np.float16)))})

    got = {r["h"]: r for r in texts.mapInPandas(rows, "h long, p double, x binary").collect()}
    order = sorted(got)
    x = np.stack([np.frombuffer(got[h]["x"], np.float16) for h in order]).astype(np.float32)
    return QualityModel(model, train_scorer(x, np.array([got[h]["p"] for h in order])))


def keep_quality(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``least``, with their columns as they were, whatever their names.

    Null and empty texts have no words and go; repeated rows stay or go together; an empty table stays empty.
    """
    return docs.where(model.score(F.col("text")) >= least)


def classify(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, score, keep`` of every row.

    A null text counts as empty; texts without words are bad to every labeller. Repeated rows get
    the same score. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    return rows.select("doc_id", fit_quality(rows).score(F.col("text")).alias("score")).withColumn("keep", F.col("score") >= least)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
