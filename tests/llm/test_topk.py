import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import topk as K


def brute(rows, k, queries=lambda i: i % 20 == 0, factor=64):
    clean = [(i, [math.floor(factor * x) for x in v]) for i, v in rows if i is not None
             and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in clean:
        if queries(q):
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean
                           if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def ask(spark, rows, k=20, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(
        F.col("vec_id").alias("id"), K.quantised(F.col("embedding")).alias("v"))
    return sorted(map(tuple, K.top_k(df, df.filter("id % 20 = 0"), k, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"tile": 37, "query_tile": 3, "stripes": 5}])
def test_equals_brute_force(spark, options):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(9, 16))
    rows = [(i, (centres[i % 9] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist())
            for i in range(700)]
    assert ask(spark, rows, **options) == brute(rows, 20)


def test_ties_and_copies(spark):
    """Many equal vectors: ties go to the smaller id."""
    rng = random.Random(1)
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(300)] + [
        (300 + i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(200)]
    assert ask(spark, rows, 7, tile=64) == brute(rows, 7)


def test_outsiders_are_left_before_the_lists_end(monkeypatch):
    """With clear winners few exact scores are computed."""
    rng = np.random.default_rng(2)
    rows = rng.integers(-8, 8, (4000, 16))
    near = rng.integers(-8, 8, (1, 16)) * 8
    rows[:30] = near + rng.integers(-2, 2, (30, 16))
    counted = []
    real = np.einsum
    monkeypatch.setattr(K.np, "einsum", lambda *a: counted.append(len(a[1])) or real(*a))
    best = K.Best(np.array([-5]), 20)
    K.search_tile(near, best, K.Tile(np.arange(4000), rows))
    want = np.lexsort((np.arange(4000), -(rows @ near[0])))[:20]
    assert best.vec.tolist() == want.tolist() and sum(counted) < 400


@pytest.mark.parametrize("scale", [1, 10 ** 6, 10 ** 8, 10 ** 15])
def test_exact_at_every_size(scale):
    rng = np.random.default_rng(3)
    rows = rng.integers(-9, 9, (300, 4)).astype(object) * scale + rng.integers(0, 9, (300, 4))
    queries = rows[:5]
    best = K.Best(np.arange(5), 6)
    K.search_tile(queries.astype(np.int64), best, K.Tile(np.arange(300), rows.astype(np.int64)))
    for q in range(5):
        want = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(
            queries[q].tolist(), rows[i].tolist())))), i) for i in range(300) if i != q)[:6]
        assert [(-s, v) for s, v in zip(best.score[best.q == q].tolist(),
                                        best.vec[best.q == q].tolist())] == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]),
            (4, [inf, 1.0]), (5, [1.0, 2.0, 3.0]), (40, [3.0, 2.0, 1.0]), (6, []), (60, []),
            (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [9.0, 9.0]), (8, [-1.0, -0.01])]
    got = ask(spark, rows, 3)
    assert got == brute(rows, 3)
    assert [r for r in got if r[0] == 60] == [(60, 1, 6, 0)]
    assert ask(spark, rows[2:6]) == [] and ask(spark, []) == []
    twice = ask(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0])], 5)
    assert twice == [(0, 1, 1, 64 * 128), (0, 1, 1, 64 * 128)]
