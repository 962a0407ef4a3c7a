"""Sense classification and its metrics.

Vectors are averaged with ``Summarizer.mean`` (a JVM aggregate with partial merge), never
by exploding d rows per vector.  Test rows meet centroids with a salted equi-join on the lemma
(``join_dim``): a hot lemma is several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.arrays import dot, l2_normalize
from lexispark.functions.keys import seeded_int
from lexispark.operators.sampling import _list, join_dim


def centroids(train: DataFrame, keys, vec_col: str = "embedding", out: str = "centroid",
              sense: str = "sense") -> DataFrame:
    """Mean vector per (keys..., sense); rows without a vector are simply absent."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    keys = _list(keys) + [sense]
    v = train.where(F.col(vec_col).isNotNull()).withColumn(
        "_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    return v.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"),
                                F.count(F.lit(1)).alias("n_train")) \
        .select(*keys, vector_to_array("_m").alias(out), "n_train")


def nearest_centroid(test: DataFrame, cents: DataFrame, keys, metric: str = "cosine",
                     vec_col: str = "embedding", sense: str = "sense", id_col: str = "id",
                     out: str = "pred") -> DataFrame:
    """Predict, per test row, the sense whose centroid is most similar (cosine or dot),
    among the centroids sharing the row's keys (e.g. run and lemma).  Ties: larger sense."""
    keys = _list(keys)
    c = cents.select(*keys, F.col(sense).alias("_cs"), F.col("centroid").alias("_cv"))
    t = test.select(id_col, *keys, vec_col)
    if metric == "cosine":
        c = c.withColumn("_cv", l2_normalize("_cv"))
        t = t.withColumn(vec_col, l2_normalize(vec_col))
    j = join_dim(t, c, keys).withColumn("_sim", dot(vec_col, "_cv"))
    return j.groupBy(id_col, *keys).agg(
        F.max_by("_cs", F.struct("_sim", "_cs")).alias(out), F.max("_sim").alias("sim"))


def majority_baseline(train: DataFrame, test: DataFrame, keys, sense: str = "sense",
                      id_col: str = "id", out: str = "pred") -> DataFrame:
    """Most frequent train sense per key group (ties: smallest sense) for every test row."""
    keys = _list(keys)
    counts = train.groupBy(*keys, sense).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_c"), F.col(sense))
    best = counts.withColumn("_r", F.row_number().over(w)).where("_r = 1") \
        .select(*keys, F.col(sense).alias(out))
    return join_dim(test.select(id_col, *keys), best, keys)


def frequency_baseline(train: DataFrame, test: DataFrame, keys, sense: str = "sense",
                       id_col: str = "id", seed="freq", out: str = "pred") -> DataFrame:
    """A sense drawn with probability proportional to its train frequency, per test row.

    Integer draw u mod total, matched against cumulative count intervals per key group
    (a small dimension joined on the keys, then a range filter).
    """
    keys = _list(keys)
    counts = train.groupBy(*keys, sense).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(sense)
    dim = counts.withColumn("_hi", F.sum("_c").over(w)) \
        .withColumn("_lo", F.col("_hi") - F.col("_c")) \
        .withColumn("_tot", F.sum("_c").over(Window.partitionBy(*keys)))
    t = test.select(id_col, *keys)
    j = join_dim(t, dim, keys).withColumn(
        "_u", F.pmod(seeded_int(seed, id_col), F.col("_tot")))
    return j.where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))) \
        .select(id_col, *keys, F.col(sense).alias(out))


def class_index(support: DataFrame, keys, sense: str = "sense", out: str = "class_idx"):
    """Senses ordered by support frequency (desc, then sense) -> 0-based class index."""
    keys = _list(keys)
    counts = support.groupBy(*keys, sense).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_c"), F.col(sense))
    return counts.select(*keys, sense, (F.row_number().over(w) - 1).alias(out))


def query_not_covered(support: DataFrame, query: DataFrame, keys, sense: str = "sense"):
    """Violations: query rows whose sense never occurs in the support (should be empty)."""
    keys = _list(keys) + [sense]
    return join_dim(query, support.select(*keys).distinct(), keys, "left_anti")


def lemma_scores(preds: DataFrame, keys, true: str = "true", pred: str = "pred") -> DataFrame:
    """Per group accuracy (single-label micro F1 = precision = recall) and support."""
    keys = _list(keys)
    return preds.groupBy(*keys).agg(
        F.avg((F.col(true) == F.col(pred)).cast("double")).alias("f1"),
        F.count(F.lit(1)).alias("support"))


def aggregate_scores(scores: DataFrame, naming: str = "reference", by=()) -> DataFrame:
    """Plain mean over groups and support-weighted mean.  naming='reference' keeps the
    reference's swapped labels (plain mean called micro); 'standard' swaps them back."""
    by = _list(by)
    plain = F.avg("f1")
    weighted = F.sum(F.col("f1") * F.col("support")) / F.sum("support")
    a, b = ("f1_micro", "f1_macro") if naming == "reference" else ("f1_macro", "f1_micro")
    return scores.groupBy(*by).agg(plain.alias(a), weighted.alias(b))


def per_class_scores(preds: DataFrame, keys, true: str = "true", pred: str = "pred"):
    """True per-class precision / recall / F1 (tp, fp, fn by one aggregate each)."""
    keys = _list(keys)
    tp = preds.where(F.col(true) == F.col(pred)).groupBy(*keys, F.col(true).alias("cls")) \
        .agg(F.count(F.lit(1)).alias("tp"))
    nt = preds.groupBy(*keys, F.col(true).alias("cls")).agg(F.count(F.lit(1)).alias("n_true"))
    npred = preds.groupBy(*keys, F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = nt.join(npred, keys + ["cls"], "full").join(tp, keys + ["cls"], "left").fillna(0)
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    return j.select(*keys, "cls", "tp", "n_true", "n_pred", p.alias("precision"), r.alias("recall"),
                    F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def running_centroids(train: DataFrame, keys, sizes: Sequence[int | None], vec_col: str = "embedding",
                      sense: str = "sense", id_col: str = "id", seed="ladder", size: str = "n_items") -> DataFrame:
    """(keys.., sense, size, centroid, n_train) of the first rows of each sense in seeded order, for every
    size (None: all rows, called 'all').

    A row is ranked once and falls between two sizes; the vectors between two sizes are summed once,
    and the sums up to a size are read off.  So all sizes cost one pass, not one each."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from lexispark.functions.keys import rkey
    from lexispark.operators.sampling import exact_rank
    group = _list(keys) + [sense]
    steps = sorted({s for s in sizes if s is not None})
    names = [(len(steps) if s is None else steps.index(s), "all" if s is None else str(s))
             for s in dict.fromkeys(sizes)]
    ranked = exact_rank(train.select(*group, id_col, vec_col), group, rkey(seed, id_col), id_col, out="_r")
    step = F.lit(len(steps))
    for i, s in reversed(list(enumerate(steps))):
        step = F.when(F.col("_r") <= s, i).otherwise(step)
    parts = ranked.withColumn("_b", step).where(F.col(vec_col).isNotNull()).withColumn(
        "_v", array_to_vector(F.col(vec_col).cast("array<double>"))).groupBy(*group, "_b").agg(
        Summarizer.sum(F.col("_v")).alias("_s"), F.count(F.lit(1)).alias("_n")).select(
        *group, "_b", vector_to_array("_s").alias("_s"), "_n")
    # a sense has as many parts as there are sizes, at most one more
    held = parts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_b", "_s", "_n"))).alias("_p"))
    asked = held.select(*group, "_p", F.explode(F.array(*[
        F.struct(F.lit(i).alias("upto"), F.lit(name).alias("name")) for i, name in names])).alias("_z"))
    upto = F.filter("_p", lambda p: p["_b"] <= F.col("_z.upto"))
    got = asked.select(*group, F.col("_z.name").alias(size), upto.alias("_p")).where(F.size("_p") > 0)
    n = F.aggregate("_p", F.lit(0).cast("bigint"), lambda a, p: a + p["_n"])
    total = F.aggregate(F.slice("_p", 2, 1 << 20), F.get("_p", F.lit(0))["_s"],
                        lambda a, p: F.zip_with(a, p["_s"], lambda x, y: x + y))
    return got.select(*group, size, total.alias("_t"), n.alias("n_train")).select(
        *group, size, F.transform("_t", lambda x: x / F.col("n_train")).alias("centroid"), "n_train")


def ladder_predictions(support: DataFrame, query: DataFrame, keys, sizes: Sequence[int | None],
                       vec_col: str = "embedding", sense: str = "sense", id_col: str = "id", seed="ladder",
                       metric: str = "cosine", size: str = "n_items") -> DataFrame:
    """(id, keys.., size, pred) of every query row and size: the sense whose centroid is most similar
    among those of the row's keys (ties: larger sense)."""
    keys = _list(keys)
    cents = running_centroids(support, keys, sizes, vec_col, sense, id_col, seed, size)
    c = cents.select(*keys, size, F.col(sense).alias("_cs"), F.col("centroid").alias("_cv"))
    t = query.select(id_col, *keys, vec_col)
    if metric == "cosine":
        c, t = c.withColumn("_cv", l2_normalize("_cv")), t.withColumn(vec_col, l2_normalize(vec_col))
    j = join_dim(t, c, keys).withColumn("_sim", dot(vec_col, "_cv"))
    return j.groupBy(id_col, *keys, size).agg(F.max_by("_cs", F.struct("_sim", "_cs")).alias("pred"))


def support_ladder(train: DataFrame, test: DataFrame, keys, sizes: Sequence[int | None],
                   vec_col: str = "embedding", sense: str = "sense", id_col: str = "id",
                   seed="ladder", metric: str = "cosine") -> DataFrame:
    """Predictions (and gold) of the test rows for every support size, from one pass over the train rows
    (``running_centroids``)."""
    pred = ladder_predictions(train, test, keys, sizes, vec_col, sense, id_col, seed, metric)
    return pred.join(test.select(id_col, F.col(sense).alias("gold")), id_col)


def episode_loss(episodes: DataFrame, vec_col: str = "embedding", sense: str = "sense",
                 id_col: str = "id") -> DataFrame:
    """Per episode: mean softmax cross-entropy of query rows over dot-product scores against
    the support centroids (max-shifted log-sum-exp), and accuracy."""
    keys = ["episode", "lemma"]
    sup = episodes.where(F.col("role") == "support")
    qry = episodes.where(F.col("role") == "query")
    cents = centroids(sup, keys, vec_col, sense=sense)
    c = cents.select(*keys, F.col(sense).alias("_cs"), F.col("centroid").alias("_cv"))
    j = qry.select(id_col, *keys, F.col(sense).alias("_true"), vec_col).join(c, keys) \
        .withColumn("_z", dot(vec_col, "_cv"))
    per_q = j.groupBy("episode", id_col).agg(
        F.max("_z").alias("_m"),
        F.collect_list(F.struct("_z", "_cs", "_true")).alias("_all"))
    lse = F.col("_m") + F.log(F.aggregate("_all", F.lit(0.0),
                                          lambda a, x: a + F.exp(x["_z"] - F.col("_m"))))
    ztrue = F.aggregate("_all", F.lit(0.0),
                        lambda a, x: a + F.when(x["_cs"] == x["_true"], x["_z"]).otherwise(0.0))
    per_q = per_q.select("episode", id_col, (lse - ztrue).alias("loss"))
    return per_q.groupBy("episode").agg(F.avg("loss").alias("loss"))


# --- C15-C18 thresholds and pair scores ---------------------------------------------------------

def constant_baselines(labels: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy of always predicting 1 and always predicting 0."""
    return labels.agg(F.avg(F.col(label).cast("double")).alias("acc_all_1"),
                      F.avg((1 - F.col(label)).cast("double")).alias("acc_all_0"))


def score_histogram(scores: DataFrame, score: str = "score", label: str = "label", n: int = 25,
                    lo: float | None = 0.0, hi: float | None = 1.0, strict: bool = False, by=()) -> DataFrame:
    """(by.., _lo, _hi, _k, _pos, _cnt): rows and positive rows by the number k of the n cut-offs that a score
    passes.  Counts add up, so histograms of parts of the data merge.

    The cut-offs are lo + i * (hi - lo) / (n - 1), the last one hi itself.  k is floor((score - lo) / step),
    corrected by one against the cut-offs next to it, so a score on a cut-off is never misplaced by
    rounding; a score is evaluated once.  A null score passes none, NaN all."""
    by = _list(by)
    df = scores.select(*by, F.col(score).cast("double").alias("_s"), F.col(label).alias("_y"))
    if lo is None or hi is None:
        mm = df.groupBy(*by).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
        df = df.join(mm, by) if by else df.crossJoin(F.broadcast(mm))
    else:
        df = df.withColumn("_lo", F.lit(float(lo))).withColumn("_hi", F.lit(float(hi)))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(n - 1))
    place = F.try_divide(F.col("_s") - F.col("_lo"), step)
    df = df.withColumn("_g", F.floor(F.least(F.greatest(place, F.lit(-1.0)), F.lit(float(n - 1)))).cast("int"))
    cut = lambda i: F.when(i >= n - 1, F.col("_hi")).otherwise(F.col("_lo") + i * step)
    passes = lambda i: F.col("_s") > cut(i) if strict else F.col("_s") >= cut(i)
    g = F.col("_g")
    k = F.when(F.col("_s").isNull(), 0) \
        .when(F.col("_hi") <= F.col("_lo"), F.when(passes(F.lit(0)), n).otherwise(0)) \
        .when((g < n - 1) & passes(g + 1), g + 2) \
        .when((g >= 0) & passes(F.greatest(g, F.lit(0))), g + 1).otherwise(F.greatest(g, F.lit(0)))
    return df.withColumn("_k", k).groupBy(*by, "_lo", "_hi", "_k").agg(
        F.sum(F.col("_y").cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_cnt"))


def best_threshold(scores: DataFrame, score: str = "score", label: str = "label", n: int = 25,
                   lo: float | None = 0.0, hi: float | None = 1.0, strict: bool = False,
                   by=()) -> DataFrame:
    """The cut-off among n evenly spaced values in [lo, hi] (inclusive; None = the data's
    min/max) with the best accuracy of 'score >= th' (or '>' when strict); first best wins.

    The scores become a histogram of <= n+1 buckets a group, which is summed cumulatively: one
    shuffle of tiny rows instead of n passes.
    """
    by = _list(by)
    b = score_histogram(scores, score, label, n, lo, hi, strict, by)
    tot = b.groupBy(*by).agg(F.sum("_pos").alias("_P"), F.sum("_cnt").alias("_T"))
    th = b.sparkSession.range(n).select(F.col("id").cast("int").alias("_i"))
    # predicted 1 for threshold i: rows with _k > i
    g = b.crossJoin(F.broadcast(th)).groupBy(*by, "_lo", "_hi", "_i").agg(
        F.sum(F.when(F.col("_k") > F.col("_i"), F.col("_pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col("_k") > F.col("_i"), F.col("_cnt") - F.col("_pos")).otherwise(0)).alias("_fp"))
    g = g.join(tot, by) if by else g.crossJoin(tot)
    acc = (F.col("_tp") + (F.col("_T") - F.col("_P") - F.col("_fp"))) / F.col("_T")
    g = g.withColumn("accuracy", acc).withColumn(
        "threshold", F.col("_lo") + F.col("_i") * (F.col("_hi") - F.col("_lo")) / F.lit(n - 1))
    w = Window.partitionBy(*by).orderBy(F.desc("accuracy"), "_i")
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1") \
        .select(*by, "threshold", "accuracy")


def bilinear_scores(pairs: DataFrame, weights: DataFrame, lemma: str = "lemma",
                    e1: str = "e1", e2: str = "e2") -> DataFrame:
    """p = sigmoid(w_lemma . [e1; e2]) with a weight vector per lemma (joined on lemma)."""
    j = pairs.join(weights.select(lemma, F.col("weight").alias("_w")), lemma)
    z = dot(F.concat(F.col(e1).cast("array<double>"), F.col(e2).cast("array<double>")), "_w")
    return j.withColumn("p", 1.0 / (1.0 + F.exp(-z))).drop("_w")


def bce(scored: DataFrame, p: str = "p", label: str = "label", eps: float = 1e-7) -> DataFrame:
    pc = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return scored.agg(F.avg(-(y * F.log(pc) + (1 - y) * F.log(1 - pc))).alias("bce"))
