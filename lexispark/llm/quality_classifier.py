"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled set is web text of the training fold,
whatever its label.  The class prior is estimated from how the scores of held-back positives and
of unlabelled text compare at the top (the smallest ratio of the two upper tails), and a logistic
model then minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

by full-batch Adam steps.  Fitting takes a bounded sample (``max_positive``, ``max_unlabelled``
rows, drawn by hash); features and scores are of whole texts.

Defined cases: null and empty texts share the feature vector of an empty text and get its score;
a null doc_id belongs to no training row and is not held out; repeated label rows count once,
and a document that any row labels other than 1 is no trusted positive; without positives every
score is the prior 0.5; extra columns of the input are carried (same-named ones are replaced);
an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import TWO_60, crc_fold, hash60

BUCKETS = 512           # hashed byte pairs
STYLE = 16
WIDTH = BUCKETS + STYLE
SHORT = 300.0           # bytes at which byte pairs count half: fewer say little about a text
_SPACES = bytes([9, 10, 11, 12, 13, 32])
_SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"


def _class_table() -> np.ndarray:
    """Byte -> class: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 symbol,
    7 end of sentence, 8 other punctuation, 9 above ASCII."""
    t = np.zeros(256, np.uint8)
    t[ord("a"):ord("z") + 1], t[ord("A"):ord("Z") + 1], t[ord("0"):ord("9") + 1] = 1, 2, 3
    t[list(_SPACES)], t[10] = 4, 5
    t[list(b",;:'\"()-/`")], t[list(b".!?")], t[list(_SYMBOLS)] = 8, 7, 6
    t[128:] = 9
    return t


CLASSES = _class_table()
PAIRS = ((np.arange(65536, dtype=np.uint32) * np.uint32(2654435769)) >> np.uint32(23)).astype(
    np.int16)  # 16-bit pair -> one of 512 buckets


def features(text: str | None) -> np.ndarray:
    """Style and hashed byte-pair features of a whole text, all of order 1."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(WIDTH, np.float32)
    words = raw.split()
    n, size = len(words), len(raw)
    out[0] = SHORT / (SHORT + size)
    if not n:
        return out
    b = np.frombuffer(raw, np.uint8)
    share = np.bincount(CLASSES[b], minlength=10) / size
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[1:11] = np.sqrt(share)
    out[11] = np.sqrt(again)
    out[12] = 1.0 - distinct / n
    out[13] = min(lengths.mean() / 10.0, 5.0)
    out[14] = 1.0 - len(set(lines)) / len(lines)
    out[15] = (lengths == 1).mean()
    pairs = b[:-1].astype(np.uint16) << np.uint16(8) | b[1:]
    counts = np.bincount(PAIRS[pairs], minlength=BUCKETS).astype(np.float32)
    out[STYLE:] = np.sqrt(counts / max(1, size - 1))
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(standard(x, self.mean, self.scale) @ self.weight + self.bias)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred and scaled; byte pairs of short texts shrink towards the mean."""
    z = ((x - mean) / scale).astype(np.float32)
    z[:, STYLE:] *= 1.0 - x[:, :1]
    return z


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, decay: float):
    """Weights (last: bias; the rows end in 1) by Adam.  prior None: plain positives against
    unlabelled."""
    w, m, v = (np.zeros(p.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        up = p.T @ (sp - 1.0) / len(p)               # gradient of E_P[loss(+)]
        down_p, down_u = p.T @ sp / len(p), u.T @ su / len(u)
        if prior is None:
            g = up + down_u
        else:
            risk = np.mean(-np.log1p(-su + 1e-6)) - prior * np.mean(-np.log1p(-sp + 1e-6))
            # where the negative part falls below 0, step back instead of fitting it further
            g = prior * up + (down_u - prior * down_p) if risk >= 0 else prior * down_p - down_u
        g = (g + decay * np.append(w[:-1], np.float32(0))).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(
            np.float32)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of the upper tails of the unlabelled and the held-back positive scores, each
    widened by its sampling error; tails of under a fifth of the positives are too uncertain."""
    cuts = np.unique(np.quantile(positive, np.linspace(0.0, 0.8, 161)))
    tail = lambda s: 1.0 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    tp, tu = tail(positive), tail(unlabelled)
    slack = np.sqrt(np.log(20) / (2 * len(positive))) + np.sqrt(np.log(20) / (2 * len(unlabelled)))
    bound = (tu + slack) / np.maximum(tp, 1e-9)
    best = int(np.argmin(bound))
    return float(np.clip(tu[best] / max(tp[best], 1e-9), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200, decay: float = 1e-4,
        prior: float | None = None) -> Model:
    """A model from feature rows; without rows of either kind it scores 0.5 throughout."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n
    square = (np.einsum("ij,ij->j", positive, positive, dtype=np.float64)
              + np.einsum("ij,ij->j", unlabelled, unlabelled, dtype=np.float64)) / n
    mean, scale = mean.astype(np.float32), (np.sqrt(np.maximum(square - mean ** 2, 0))
                                            + 0.02).astype(np.float32)
    p, u = (np.hstack([standard(x, mean, scale), np.ones((len(x), 1), np.float32)])
            for x in (positive, unlabelled))
    if prior is None:
        back = np.arange(len(p)) % 4 == 0 if len(p) >= 8 else np.ones(len(p), bool)
        first = _descend(p if back.all() else p[~back], u, None, steps // 3, 1e-2)
        prior = estimate_prior(p[back] @ first, u @ first)
    w = _descend(p, u, prior, steps, decay)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _feature_batches(batches):
    for pdf in batches:
        yield pd.DataFrame({"positive": pdf["positive"], "x": [
            features(t).astype(np.float16).tobytes() for t in pdf["text"]]})


def train(docs: DataFrame, labels: DataFrame, *, max_positive: int = 6_000,
          max_unlabelled: int = 12_000, seed: int = 3) -> Model:
    """Fit on the training fold (crc32 of doc_id modulo 5 not 0).  Both sets are hash samples of
    about the stated sizes at most, so what reaches the driver is bounded whatever the input."""
    train_fold = crc_fold(F.col("doc_id")) > 0
    positive = (labels.filter(train_fold).groupBy("doc_id").agg(F.min("quality").alias("q"),
                F.max("quality").alias("q2")).filter("q = 1 and q2 = 1").select("doc_id"))
    def drawn(most: int, of: int, salt: int):
        return hash60(salt, F.col("doc_id")) < F.lit(int(min(1.0, most / max(of, 1)) * TWO_60))

    chosen = positive.filter(drawn(max_positive, positive.count(), seed)).withColumn(
        "positive", F.lit(True))
    n = docs.select("doc_id").filter(train_fold).count()
    # about max_positive ids of 8 bytes: the broadcast is bounded by that parameter
    rows = (docs.select("doc_id", "text").filter(train_fold)
            .join(F.broadcast(chosen), "doc_id", "left")
            .select("text", F.coalesce("positive", F.lit(False)).alias("is_p"),
                    drawn(max_unlabelled, n, seed + 1).alias("is_u"))
            .filter("is_p or is_u")
            .select("text", F.explode(F.filter(F.array(
                F.when(F.col("is_p"), True), F.when(F.col("is_u"), False)),
                lambda x: x.isNotNull())).alias("positive"))
            .mapInPandas(_feature_batches, "positive boolean, x binary"))
    got = rows.toArrow()
    x = np.concatenate([np.zeros(0, np.float16), *(
        np.frombuffer(b"".join(c.to_pylist()), np.float16) for c in got.column("x").chunks)])
    x, flag = x.reshape(-1, WIDTH), got.column("positive").to_numpy().astype(bool)
    del got
    # rows in an order of their own, so that the fit does not depend on how they arrived
    order = np.lexsort([*x[:, :STYLE].T, flag]) if len(x) else np.zeros(0, np.int64)
    positive, rest = order[flag[order]], order[~flag[order]]
    return fit(x[positive].astype(np.float32), x[rest].astype(np.float32))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` up) of every whole text."""
    base = docs.drop("score", "predicted")

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        out = np.empty(len(text))
        for a in range(0, len(text), 512):
            out[a:a + 512] = model.scores(np.stack([features(t) for t in text[a:a + 512]]))
        return pd.Series(out)
    return (base.withColumn("score", scored(F.col("text")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options), threshold)
