"""Evaluation of predictions: confusion matrices and overlap, focal and distance scores.

Inputs are pixel rows (sample, t, p, p0.., lu): truth, predicted class, class probabilities and
land use. Every score is a sum by class or sample, so map-side aggregation does the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distances between classes, and the terms that keep quotients finite.
WASSERSTEIN = ((0.0, 1.0, 1.0), (1.0, 0.0, 0.5), (1.0, 0.5, 0.0))
EPS = 1e-10


def _pairs(df: DataFrame, k: int) -> DataFrame:
    cls = lambda n: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(n)
    one = df.sparkSession.range(1)
    return one.select(cls("t")).select("t", cls("p"))


def confusion_report(ev: DataFrame, k: int) -> DataFrame:
    """(t, p, n, n_forest, share, share_forest): all K x K cells, rows by truth; empty rows have share 0."""
    got = ev.groupBy("t", "p").agg(F.count("*").alias("n"), F.count_if(F.col("lu") == 1).alias("n_forest"))
    full = _pairs(ev, k).join(got, ["t", "p"], "left").fillna(0, ["n", "n_forest"])
    sums = got.groupBy("t").agg(F.sum("n").alias("a"), F.sum("n_forest").alias("f"))
    share = lambda c, s: F.coalesce(F.when(F.col(s) > 0, F.col(c) / F.col(s)), F.lit(0.0))
    return full.join(sums, "t", "left").select("t", "p", "n", "n_forest", share("n", "a").alias("share"), share("n_forest", "f").alias("share_forest"))


def confusion(ev: DataFrame, k: int, normalize: bool = False) -> DataFrame:
    return confusion_report(ev, k).select("t", "p", "share" if normalize else "n")


def planes(ev: DataFrame, k: int) -> DataFrame:
    """One row a pixel and class: (sample, k, hot, prob)."""
    each = F.array(*[F.struct(F.lit(i).alias("k"), (F.col("t") == i).cast("double").alias("hot"), F.col(f"p{i}").cast("double").alias("prob")) for i in range(k)])
    return ev.select("sample", F.explode(each).alias("c")).select("sample", "c.*")


def fscore(ev: DataFrame, k: int, ignore: Sequence[int] = (), threshold: float = 0.5, beta: float = 1.0, eps: float = 1e-7) -> DataFrame:
    """(fscore): pooled over all pixels and classes but the ignored ones."""
    rows = planes(ev, k).where(~F.col("k").isin(list(ignore))) if ignore else planes(ev, k)
    said = (F.col("prob") > threshold).cast("double")
    sums = rows.agg(F.sum(F.col("hot") * said).alias("tp"), F.sum("hot").alias("pos"), F.sum(said).alias("said"))
    b = beta * beta
    fp, fn = F.col("said") - F.col("tp"), F.col("pos") - F.col("tp")
    return sums.select((((1 + b) * F.col("tp") + eps) / ((1 + b) * F.col("tp") + b * fn + fp + eps)).alias("fscore"))


def dice(ev: DataFrame, k: int, by: str = "sample", eps: float = EPS) -> DataFrame:
    """Dice coefficient by sample and class, or by class over the batch."""
    keys = ["sample", "k"] if by == "sample" else ["k"]
    sums = planes(ev, k).groupBy(*keys).agg(F.sum(F.col("hot") * F.col("prob")).alias("i"), F.sum(F.col("hot") + F.col("prob")).alias("u"))
    return sums.select(*keys, ((2 * F.col("i") + eps) / (F.col("u") + eps)).alias("dice"))


def inter_union(ev: DataFrame, k: int) -> DataFrame:
    """(sample, k, inter, uni): sizes of the intersection and union of true and predicted planes."""
    said = F.array(*[F.struct(F.lit(i).alias("k"), (F.col("t") == i).cast("int").alias("a"), (F.col("p") == i).cast("int").alias("b")) for i in range(k)])
    rows = ev.select("sample", F.explode(said).alias("c")).select("sample", "c.*")
    return rows.groupBy("sample", "k").agg(F.sum(F.col("a") * F.col("b")).alias("inter"), F.sum(F.greatest("a", "b")).alias("uni"))


def soft_size(ev: DataFrame, k: int) -> DataFrame:
    return planes(ev, k).groupBy("sample", "k").agg(F.sum("prob").alias("size"))


def class_set(df: DataFrame, k: int, col: str = "t") -> DataFrame:
    """(classes, valid): how many classes occur, and whether all are in 0..k-1."""
    return df.agg(F.count_distinct(col).alias("classes"), F.bool_and(F.col(col).between(0, k - 1)).alias("valid"))


def cross_entropy(ev: DataFrame, k: int, eps: float = EPS) -> DataFrame:
    sums = planes(ev, k).agg(F.sum(F.col("hot") * F.log(F.col("prob") + eps)).alias("s"), F.sum("hot").alias("n"))
    return sums.select((-F.col("s") / (F.col("n") + eps)).alias("cross_entropy"))


def dice_loss(ev: DataFrame, k: int, classes: Sequence[int], eps: float = EPS) -> DataFrame:
    """Mean over samples and classes of one less the dice coefficient."""
    return dice(ev.select("*"), k, "sample", eps).where(F.col("k").isin(list(classes))).agg(F.avg(1 - F.col("dice")).alias("dice_loss"))


def gdice_sample(ev: DataFrame, k: int, eps: float = EPS) -> DataFrame:
    """Generalized dice loss with a weight for each sample and class; mean over samples."""
    sums = planes(ev, k).groupBy("sample", "k").agg(F.sum("hot").alias("t"), F.sum("prob").alias("p"), F.sum(F.col("hot") * F.col("prob")).alias("i"))
    w = 1 / (F.col("t") * F.col("t") + eps)
    per = sums.withColumn("w", w).groupBy("sample").agg(F.sum(F.col("w") * F.col("i")).alias("i"), F.sum(F.col("w") * (F.col("t") + F.col("p"))).alias("u"))
    return per.agg(F.avg(1 - 2 * (F.col("i") + eps) / (F.col("u") + eps)).alias("gdice_sample"))


def gdice(ev: DataFrame, k: int, eps: float = 1e-9) -> DataFrame:
    """Generalized dice loss with one weight a class over the batch; an absent class weighs 1 / eps."""
    sums = planes(ev, k).groupBy("k").agg(F.sum("hot").alias("t"), F.sum("prob").alias("p"), F.sum(F.col("hot") * F.col("prob")).alias("i"))
    w = 1 / (F.col("t") * F.col("t") + eps)
    both = sums.agg(F.sum(w * F.col("i")).alias("i"), F.sum(w * (F.col("t") + F.col("p"))).alias("u"))
    return both.select((1 - 2 * (F.col("i") + eps) / (F.col("u") + eps)).alias("gdice"))


def focal(ev: DataFrame, k: int, gamma: float = 2.0, eps: float = EPS) -> DataFrame:
    loss = F.pow(1 - F.col("prob"), F.lit(gamma)) * F.col("hot") * F.log(F.col("prob") + eps)
    sums = planes(ev, k).agg(F.sum(loss).alias("s"), F.sum("hot").alias("n"))
    return sums.select((-F.col("s") / (F.col("n") + eps)).alias("focal"))


def boundary(probs: DataFrame, dist: DataFrame) -> DataFrame:
    """Mean of probability times signed distance over the classes but the background: (img, k, y, x, prob) and (.., dist)."""
    both = probs.where("k > 0").join(dist, ["img", "k", "y", "x"])
    return both.agg(F.avg(F.col("prob") * F.col("dist")).alias("boundary"))


def _to_class(row: Column, matrix: Sequence[Sequence[float]], k: int) -> Column:
    """Expected distance of the predicted classes to the true one."""
    top = max(max(r) for r in matrix)
    out = F.lit(0.0)
    for l in range(k):
        out = F.when(row == l, sum((F.col(f"p{j}") * (matrix[l][j] / top) for j in range(k)), F.lit(0.0))).otherwise(out)
    return out


def softmax(ev: DataFrame, k: int) -> DataFrame:
    """The rows with ``p0``.. as scores turned into probabilities."""
    top = F.greatest(*[F.col(f"p{i}") for i in range(k)]) if k > 1 else F.col("p0")
    raised = {f"p{i}": F.exp(F.col(f"p{i}") - top) for i in range(k)}
    total = sum(raised.values(), F.lit(0.0))
    return ev.withColumns({name: e / total for name, e in raised.items()})


def gwdice(ev: DataFrame, k: int, matrix: Sequence[Sequence[float]] = WASSERSTEIN, mode: str = "default", reduction: str = "mean", eps: float = 1e-10, scores: bool = False) -> DataFrame:
    """Generalized Wasserstein dice loss by sample (``none``), or its mean or sum.

    ``default`` weighs true positives by the distance to the background; ``gdl`` weighs classes by
    one over their size in the sample. ``p0``.. are probabilities, or with ``scores`` the outputs of a
    network that a softmax has still to turn into such.
    """
    ev = softmax(ev, k) if scores else ev
    matrix = [list(r[:k]) for r in matrix[:k]]
    top = max(max(r) for r in matrix)
    delta = _to_class(F.col("t"), matrix, k)
    if mode == "default":
        alpha = sum((F.when(F.col("t") == l, matrix[0][l] / top).otherwise(0.0) for l in range(1, k)), F.lit(0.0))
        sums = ev.groupBy("sample").agg(F.sum(alpha * (1 - delta)).alias("tp"), F.sum(delta).alias("e"))
        per = sums.select("sample", (1 - (2 * F.col("tp") + eps) / (2 * F.col("tp") + F.col("e") + eps)).alias("loss"))
    else:
        by = ev.groupBy("sample", "t").agg(F.count("*").alias("n"), F.sum(delta).alias("d"))
        w = 1 / (F.col("n") + eps)
        sums = by.groupBy("sample").agg(F.sum(w * (F.col("n") - F.col("d"))).alias("tp"), F.sum(w * F.col("d")).alias("e"))
        per = sums.select("sample", (1 - (2 * F.col("tp") + eps) / (2 * F.col("tp") + F.col("e") + eps)).alias("loss"))
    return per if reduction == "none" else per.agg((F.avg if reduction == "mean" else F.sum)("loss").alias("gwdice"))


def total_score(dice_part: DataFrame, focal_part: DataFrame, boundary_part: DataFrame, epoch: int) -> DataFrame:
    """Dice + alpha * boundary + focal from three one-row tables; alpha grows with the epoch up to 0.99."""
    alpha = min((epoch + 1) * 0.01, 0.99)
    one = lambda df: df.select(df[df.columns[0]].alias("s"))
    weighted = one(dice_part).unionByName(one(focal_part)).unionByName(one(boundary_part).withColumn("s", F.col("s") * alpha))
    return weighted.agg(F.sum("s").alias("total_score"))


def vote(rows: DataFrame, keys: Sequence[str], models: int) -> DataFrame:
    """(keys, cls): the most frequent class of an odd number of models, the smallest on ties."""
    if models % 2 == 0:
        raise ValueError("an even number of models can't vote")
    counts = rows.groupBy(*keys, "cls").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("cls", F.struct("n", -F.col("cls"))).alias("cls"))
