"""One logistic model per lemma against numpy on all rows of the lemma."""

import numpy as np
from pyspark.sql import functions as F

from lexispark.operators import logistic as G
from lexispark.operators import senses as C

SCHEMA = "pair_id long, lemma string, label int, e1 array<double>, e2 array<double>"


def optimum(x, y, l2):
    """Plain gradient descent with a fixed small step, then Newton: no code of the operator."""
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) / len(y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        f = lambda v: np.logaddexp(0, x @ v).mean() - (y * (x @ v)).mean() + l2 / 2 * v @ v
        t = 1.0
        while f(w - t * step) > f(w) and t > 1e-8:
            t /= 2
        w = w - t * step
    return w


def made(sizes, d=3, seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for lemma, n in sizes.items():
        true = rng.normal(size=2 * d) * 3
        for _ in range(n):
            x = rng.normal(size=2 * d)
            y = int(rng.random() < 1 / (1 + np.exp(-(x @ true))))
            rows.append((k, lemma, y, x[:d].tolist(), x[d:].tolist()))
            k += 1
    return rows


def check(got, rows, l2):
    by = {}
    for _, lemma, y, a, b in rows:
        by.setdefault(lemma, []).append((a + b, y))
    assert sorted(r.lemma for r in got) == sorted(by)
    for r in got:
        x, y = (np.array(v, float) for v in zip(*by[r.lemma]))
        want = optimum(x, y, l2)
        assert r.n == len(y) and r.converged
        assert np.abs(np.array(r.weight) - want).max() < 1e-6, r.lemma
        f = np.logaddexp(0, x @ want).mean() - (y * (x @ want)).mean() + l2 / 2 * want @ want
        assert abs(r.objective - f) < 1e-9


def test_every_lemma_has_its_optimum(spark):
    """A lemma with a third of all rows, tiny ones, one whose classes can be told apart, one class only."""
    rows = made({"hot": 400, **{f"l{i}": 8 + 3 * i for i in range(20)}, "one": 1})
    n = len(rows)
    rows += [(n + i, "apart", int(i % 2), [1.0 if i % 2 else -1.0, 0.1, 0.0], [0.0, 0.0, 5.0]) for i in range(30)]
    rows += [(n + 100 + i, "flat", 1, [0.5 * i, 1.0, 0.0], [0.0, 1.0, 0.0]) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for parts, tile in ((1, 1024), (6, 32)):
        check(G.fit_lemma_logistic(df.repartition(parts), l2=0.01, tile_rows=tile).collect(), rows, 0.01)


def test_a_hot_lemma_is_many_tiles(spark):
    df = spark.createDataFrame(made({"hot": 500, "a": 3, "b": 20}), SCHEMA)
    tiles = G.tiles_of(df, "label", "lemma", "pair_id", "e1", "e2", 64)
    n = {r.lemma: (r.t, r.n, r.m) for r in tiles.groupBy("lemma").agg(
        F.count("*").alias("t"), F.sum("n").alias("n"), F.max("n").alias("m")).collect()}
    assert n == {"hot": (8, 500, 64), "a": (1, 3, 3), "b": (1, 20, 20)}


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert G.fit_lemma_logistic(none).count() == 0
    rows = made({"a": 40})
    odd = [(90, None, 1, [1.0] * 3, [1.0] * 3), (91, "a", None, [1.0] * 3, [1.0] * 3),
           (92, "a", 1, None, [1.0] * 3), (93, "z", 1, [1.0] * 3, None)]
    check(G.fit_lemma_logistic(spark.createDataFrame(rows + odd, SCHEMA)).collect(), rows, 0.01)
    stopped = G.fit_lemma_logistic(spark.createDataFrame(rows, SCHEMA), iters=1).collect()
    assert [(r.steps, r.converged) for r in stopped] == [(1, False)]


def test_weights_score_pairs(spark):
    """The fitted weights go into the pair scorer, and give each lemma the loss that was reached."""
    rows = made({"a": 120, "b": 60}, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    fit = G.fit_lemma_logistic(df, l2=0.05)
    scored = C.bilinear_scores(df, fit)
    for r in fit.collect():
        bce = C.bce(scored.where(F.col("lemma") == r.lemma), "p", "label").first()[0]
        assert abs(bce + 0.025 * np.dot(r.weight, r.weight) - r.objective) < 1e-9
