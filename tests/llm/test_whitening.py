import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import whitening as W
from lexispark.llm.queries import op13_whitening

VECS = "vec_id long, embedding array<float>"


def exact(rows):
    """(n, deviations, eigenvalues, covariance) by Python integers and numpy's own solver."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    v = y.T @ y / n
    return n, [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], np.linalg.eigh(v), v, y


def check(got, vectors):
    """Rows of the query against the covariance of ``vectors`` (id -> vector)."""
    ids = sorted(vectors)
    n, dev, (values, _), v, y = exact([vectors[i] for i in ids])
    k = max((r.component for r in got), default=0)
    w = np.full((len(ids), k), np.nan)
    at = {i: j for j, i in enumerate(ids)}
    for r in got:
        assert r.n == n and r.deviation == dev[at[r.vec_id]]
        assert abs(r.explained / (values[::-1][r.component - 1] / np.trace(v)) - 1) < 1e-9
        assert r.identity_error < 1e-9
        w[at[r.vec_id], r.component - 1] = r.whitened
    assert not np.isnan(w).any()
    if k:
        assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
        # whitened = y u / sqrt(e): so y.T w / n = u sqrt(e), an eigenvector of v
        u = y.T @ w / n
        assert np.allclose(v @ u, u * (u * u).sum(0), rtol=1e-9, atol=1e-9 * np.trace(v))
    return k


@pytest.mark.parametrize("rank", [1, 3, 7, 40])
def test_factorisation(rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(40, rank)) * 10.0 ** rng.uniform(-4, 4, rank)
    v = a @ a.T
    factor = W.pivoted_cholesky(v)
    assert factor.shape[1] <= rank and np.allclose(factor @ factor.T, v, rtol=1e-12, atol=1e-12 * v.max())
    values, u = W.one_sided_jacobi(factor)
    assert np.allclose(u.T @ u, np.eye(len(values)), atol=1e-12) and (np.diff(values) <= 0).all()
    assert np.allclose(u * values @ u.T, v, atol=1e-12 * v.max())
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:len(values)], rtol=1e-6, atol=1e-12 * values[0])


def test_the_factor_is_triangular():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(9, 9))
    factor, left = W.pivoted_cholesky(a @ a.T), set(range(9))
    for k in range(9):          # the row of each pivot has nothing right of its own column
        left -= {min(i for i in left if not np.abs(factor[i, k + 1:]).any())}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = op13_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"] + ["double"] * 3
    assert check(got.collect(), rows) == 32


def test_partitions_change_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one, many = (sorted((r.vec_id, r.component, r.deviation, round(r.whitened, 9)) for r in
                        W.components_long(df.repartition(p), 5).collect()) for p in (1, 7))
    assert one == many


def test_few_and_flat_vectors(spark):
    rng = np.random.default_rng(1)
    rows = {i: [float(x) for x in rng.normal(size=3)] + [2.0, -1.0] for i in range(50)}
    df = spark.createDataFrame(list(rows.items()), VECS)
    assert check(W.components_long(df).collect(), rows) == 3      # two dimensions never change
    two = {1: [0.0, 1.0], 2: [1.0, 3.0]}
    assert check(W.components_long(spark.createDataFrame(list(two.items()), VECS)).collect(), two) == 1
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], VECS)
    rows, found = W.whiten(same)
    assert found.n == 9 and [(r.deviation, r.whitened) for r in rows.collect()] == [(0, [])] * 9
    assert W.components_long(same).count() == 0


def test_edges(spark):
    rng = np.random.default_rng(4)
    good = {i: [float(x) for x in rng.normal(size=4)] for i in range(30)}
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 2.0, 3.0]),
           (103, [float("inf"), 1.0, 2.0, 3.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([*good.items(), *bad], VECS) \
        .withColumn("v", F.lit("x")).withColumn("id", F.lit(3)).withColumn("n", F.lit(None))
    assert check(W.components_long(df).collect(), good) == 4
    assert W.components_long(df.limit(0)).count() == 0
    assert W.components_long(df.where("vec_id = 100")).count() == 0
    twice = spark.createDataFrame([(None, good[0]), (None, good[0]), (1, good[1]), (1, good[1])], VECS)
    got = W.components_long(twice).collect()
    assert len(got) == 4 and {r.n for r in got} == {4} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in got)
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 5.0])], VECS)
    rows, found = W.whiten(huge)
    assert found.n == 3 and [r.deviation for r in rows.orderBy("id").collect()][:2] == [None, None]
