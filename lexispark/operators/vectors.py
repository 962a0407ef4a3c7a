"""Pair distances and pair losses over vector pairs (V11-V17); all per-row array
expressions plus one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.arrays import cosine, euclidean, sq_distance


def pair_distance(a, b, kind: str = "euclidean") -> Column:
    if kind == "euclidean":
        return euclidean(a, b)
    if kind == "squared":
        return sq_distance(a, b)
    if kind == "cosine":
        return cosine(a, b)
    raise ValueError(kind)


def contrastive_loss(y, d2, margin: float = 1.0, inverted: bool = False) -> Column:
    """.5 * (y * d^2 + (1 - y) * max(m - sqrt(d^2 + 1e-9), 0)^2); inverted swaps the roles
    of the labels: (1 - y) * d^2 + y * max(m - d, 0)^2."""
    y = F.col(y).cast("double") if isinstance(y, str) else y
    d = F.sqrt(d2 + F.lit(1e-9))
    hinge = F.pow(F.greatest(F.lit(margin) - d, F.lit(0.0)), 2)
    if inverted:
        return (1 - y) * d2 + y * F.pow(F.greatest(F.lit(margin) - F.sqrt(d2), F.lit(0.0)), 2)
    return 0.5 * (y * d2 + (1 - y) * hinge)


def euclidean_loss(y, d, margin: float = 1.0, weight: float = 0.5) -> Column:
    y = F.col(y).cast("double") if isinstance(y, str) else y
    return y * weight * d * d + (1 - y) * F.pow(F.greatest(F.lit(margin) - d, F.lit(0.0)), 2)


def cosine_loss(y, s, margin: float = 0.4, weight: float = 0.25) -> Column:
    y = F.col(y).cast("double") if isinstance(y, str) else y
    return y * weight * F.pow(1 - s, 2) + (1 - y) * F.pow(F.greatest(F.lit(margin) - (1 - s), F.lit(0.0)), 2)


def pair_losses(pairs: DataFrame, y: str = "y", e1: str = "e1", e2: str = "e2") -> DataFrame:
    d2 = sq_distance(e1, e2)
    return pairs.select("*", d2.alias("d2"), euclidean(e1, e2).alias("d"), cosine(e1, e2).alias("cos")) \
        .withColumn("contrastive", contrastive_loss(y, F.col("d2"))) \
        .withColumn("contrastive_inv", contrastive_loss(y, F.col("d2"), inverted=True)) \
        .withColumn("euclidean_loss", euclidean_loss(y, F.col("d"))) \
        .withColumn("cosine_loss", cosine_loss(y, F.col("cos")))


def mean_loss(losses: DataFrame, col: str, batch: str | None = None) -> DataFrame:
    """Plain mean over pairs, or (batch given) the mean of per-batch means, which weights a
    short last batch more — the reference's behaviour."""
    if batch is None:
        return losses.agg(F.avg(col).alias("loss"))
    return losses.groupBy(batch).agg(F.avg(col).alias("_m")).agg(F.avg("_m").alias("loss"))


def compare_vector_sets(sets: DataFrame, labels: DataFrame, k: int, label: str, id_col: str = "id",
                        set_col: str = "set", vec_col: str = "embedding") -> DataFrame:
    """Retrieval quality (micro/macro accuracy and ap) of several vector sets of the same items, e.g.
    before and after a learnt transform.  The set is part of every key: one grid of tiles, one scoring and
    one summary for all sets, whatever their number."""
    from lexispark.operators import knn as K
    v = sets.join(labels.select(id_col, label), id_col)
    near = K.knn(v, k, id_col=id_col, vec_col=vec_col, metric="cosine", carry=[label], by=set_col)
    items = v.select(F.col(set_col).cast("string").alias(set_col), id_col, label)
    scores = K.retrieval_scores(near, items, k, label, id_col=id_col, by=[set_col])
    return K.micro_macro(scores, label, by=[set_col])
