"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

The centred scatter of all vectors is factored with diagonal pivoting into L L^T.  Plane rotations
from the right (one-sided Jacobi) are applied to the triangular factor itself until its columns are
orthogonal; then the squared column norms are the eigenvalues of the covariance and the normalised
columns its components.  The covariance is never squared or decomposed again, so small eigenvalues
keep their relative accuracy.

Each entry c becomes the integer floor(scale * c) + offset, so sums over all rows are exact and do
not depend on the order of rows.  Four passes over the rows: sums, scatter, check (the covariance of
the whitened vectors), and output.  A task gives one row a dimension in each of the first three;
they are added up by Spark, and only tables of the size of the dimensions reach the driver or are
broadcast (at most MOST_DIMS squared numbers).

Defined cases: vectors null, empty, or holding null or non-finite entries take no part and have no
output; of vectors of several lengths the most frequent length counts (of equally frequent ones
the longest), others take no part; entries beyond 2^40 / scale count as that; null ids are kept and
repeated rows count each; extra columns are ignored; directions without variance have no component,
so equal vectors (or a single one) give no components; a deviation beyond 64 bits is null; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import settle

MOST = float(1 << 40)     # quantised entries are held within this
MOST_DIMS = 4096
SWEEPS = 60


def usable(df: DataFrame, vec: str, vec_id: str, scale: float) -> DataFrame:
    """id and v (array of bigint, without the offset) of the vectors that take part."""
    c = F.col(vec)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.transform(c, lambda x: F.floor(F.greatest(F.least(
        x.cast("double") * F.lit(scale), F.lit(MOST)), F.lit(-MOST))))
    return df.where(c.isNotNull() & (F.size(c) > 0) & finite).select(
        F.col(vec_id).alias("id"), x.alias("v"))


def matrix(column, dims: int | None = None) -> np.ndarray:
    """(rows, dims) of an Arrow list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ---- the factorisation ----------------------------------------------------------------------------

def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d x rank) with v = L L^T; rows in the order of v, columns in the order of the pivots."""
    v = v.copy()
    d = len(v)
    out, done = np.zeros((d, d)), np.zeros(d, bool)
    least = d * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        rest = np.where(done, -1.0, v.diagonal())
        p = int(rest.argmax())
        if rest[p] <= least:
            return out[:, :k]
        column = np.where(done, 0.0, v[:, p]) / np.sqrt(v[p, p])
        out[:, k] = column
        v -= np.outer(column, column)
        done[p] = True
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components as columns) of factor @ factor.T.

    A sweep meets every two columns once, in rounds of disjoint pairs that are rotated together."""
    a = factor.copy()
    d, r = a.shape
    if r == 0:
        return np.zeros(0), np.zeros((d, 0))
    ring = list(range(r + r % 2))
    eps = np.finfo(float).eps
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            p, q = np.array(ring[:half]), np.array(ring[half:][::-1])
            inside = (p < r) & (q < r)
            p, q = p[inside], q[inside]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > eps
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(size), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1.0 / np.hypot(1.0, t)
            c, s = np.where(turn, c, 1.0), np.where(turn, c * t, 0.0)
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= 8 * eps:
            break
    norm = np.sqrt((a * a).sum(0))
    order = np.argsort(-norm, kind="stable")
    order = order[norm[order] > d * eps * norm.max()]
    u = a[:, order] / norm[order]
    top = np.abs(u).argmax(0)                       # a sign of its own: the largest entry is positive
    return norm[order] ** 2, u * np.where(u[top, np.arange(len(order))] < 0, -1.0, 1.0)


# ---- passes over the rows -------------------------------------------------------------------------

@dataclass
class Fit:
    """A whitening: all of it is bounded by the dimensions."""
    n: int
    dims: int
    whole: np.ndarray           # floor of the mean of each dimension (without the offset)
    part: np.ndarray            # what the mean has beyond it, times n
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    identity_error: float = 0.0

    def centred(self, v: np.ndarray) -> np.ndarray:
        """Integers minus their mean: the whole part is taken off exactly."""
        return (v - self.whole) - self.part / self.n

    def whitened(self, v: np.ndarray) -> np.ndarray:
        return self.centred(v) @ self.components / np.sqrt(self.values)

    def deviation(self, v: np.ndarray) -> pa.Array:
        """Sum of (n * x - S)^2, exact; the offset falls out of it."""
        low = v - self.whole
        most = self.n * (int(np.abs(low).max(initial=0)) + 1)
        if most * most * self.dims < 1 << 63:
            return pa.array(((self.n * low - self.part) ** 2).sum(1), pa.int64())
        exact = [sum((self.n * x - p) ** 2 for x, p in zip(row, self.part.tolist()))
                 for row in low.tolist()]
        return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())


def _sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """(dims, n, sum of each dimension) of the most frequent length."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            column = batch.column("v")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                v = matrix(column if (sizes == d).all() else column.filter(pa.array(sizes == d)))
                got = held.setdefault(d, [0, np.zeros(d, object)])
                got[0] += len(v)
                # both halves of a sum fit 64 bits; Python integers carry on
                got[1] = got[1] + (v >> 20).sum(0).astype(object) * (1 << 20) + (
                    v & 0xFFFFF).sum(0).astype(object)
        for d, (n, s) in held.items():
            if d > MOST_DIMS:
                raise ValueError(f"vectors of more than {MOST_DIMS} dimensions")
            yield pd.DataFrame({"dims": d, "i": np.arange(d), "n": n, "s": [str(x) for x in s]})

    def arrow(batches):
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf.astype({"dims": "int64"}), preserve_index=False)
    parts = settle(rows.select("v").mapInArrow(arrow, "dims bigint, i bigint, n bigint, s string")
                   .groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum(
                       F.col("s").cast("decimal(38,0)")).alias("s")), "sums")
    best = parts.where("i = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if best is None:
        return 0, 0, []
    got = parts.where(F.col("dims") == best.dims).orderBy("i").collect()    # a row a dimension
    return best.dims, best.n, [int(r.s) for r in got]


def _added(rows: DataFrame, rows_of, width: int) -> np.ndarray:
    """Sum over all tasks of the (k, width) array that ``rows_of(matrices)`` gives for each."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def run(batches):
        total = rows_of(matrix(b.column("v")) for b in batches if b.num_rows)
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"i": np.arange(len(total)),
                 "part": pa.FixedSizeListArray.from_arrays(
                     pa.array(total.reshape(-1)), width).cast(pa.list_(pa.float64()))})
    got = (rows.select("v").mapInArrow(run, "i bigint, part array<double>")
           .withColumn("part", array_to_vector("part"))
           .groupBy("i").agg(Summarizer.sum(F.col("part")).alias("s"))
           .select("i", vector_to_array("s").alias("s")).orderBy("i").collect())
    return np.array([r.s for r in got])


def fit(rows: DataFrame, k: int) -> Fit:
    """The whitening of the vectors of ``usable``."""
    dims, n, sums = _sums(rows)
    if not n:
        return Fit(0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    whole = [s // n for s in sums]
    out = Fit(n, dims, np.array(whole, np.int64),
              np.array([s - n * w for s, w in zip(sums, whole)], np.int64))
    rows = rows.where(F.size("v") == dims)

    def scatter(matrices):
        total = None
        for v in matrices:
            y = out.centred(v)
            total = y.T @ y if total is None else total + y.T @ y
        return total
    cov = _added(rows, scatter, dims) / n
    out.trace = float(np.trace(cov))
    values, components = one_sided_jacobi(pivoted_cholesky(cov))
    out.values, out.components = values[:k], components[:, :k]
    size = len(out.values)
    if size:
        def check(matrices):
            total = None
            for v in matrices:
                w = out.whitened(v)
                part = np.vstack([w.T @ w, w.sum(0)])
                total = part if total is None else total + part
            return total
        got = _added(rows, check, size) / n
        mean = got[-1]                              # of centred vectors: rounding alone
        out.identity_error = float(np.abs(got[:-1] - np.outer(mean, mean) - np.eye(size)).max())
    return out


def whiten(df: DataFrame, k: int = 32, vec: str = "embedding", vec_id: str = "vec_id",
           scale: float = 64.0) -> tuple[DataFrame, Fit]:
    """(id, deviation, whitened: array of up to ``k`` numbers) of every vector, and the fit."""
    rows = usable(df, vec, vec_id, scale)
    found = fit(rows, k)
    shared = df.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        f = shared.value
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                w = f.whitened(v)
                at = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), f.deviation(v),
                     pa.ListArray.from_arrays(at, pa.array(w.reshape(-1)))],
                    names=["id", "deviation", "whitened"])
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.where(F.size("v") == found.dims).mapInArrow(
        run, f"id {kind}, deviation bigint, whitened array<double>")
    return out, found


def components_long(df: DataFrame, k: int = 32, vec: str = "embedding", vec_id: str = "vec_id",
                    scale: float = 64.0) -> DataFrame:
    """A row a vector and component, numbered from 1 by falling eigenvalue."""
    rows, found = whiten(df, k, vec, vec_id, scale)
    share = F.array(*[F.lit(float(e / found.trace)) for e in found.values]) \
        if len(found.values) else F.lit(None).cast("array<double>")
    return rows.select(F.col("id").alias(vec_id), "deviation",
                       F.posexplode("whitened").alias("component", "whitened")).select(
        vec_id, (F.col("component") + 1).cast("int").alias("component"),
        F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("component")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"))
