"""Neighbour retrieval.

Exact top-k uses a grid of tiles.  Partitions pack their vectors into tiles of TILE_ROWS rows (one
row a tile: ids, matrix bytes as stored, lengths, carried labels).  Tiles of queries are put together to
blocks, as many as keep all cores busy, and every tile of targets meets every block: cells are (block, stripe
of targets), a cell's task holds one block, one tile of targets and the running top-k of its queries.  So the
targets are sent once a block, and the shuffle grows with the table while blocks of BLOCK_BYTES can be that few.  Where
there are fewer blocks than cores, targets are dealt over stripes and the k best of each are merged by a window.
A target is looked at further only if it beats the k-th best that a query has so far; ids and labels are
gathered for these only, so a task's arrays are bounded by TILE_ROWS x TILE_ROWS and the block.  Work is
O(N^2 d) by nature; for large N use ``knn_approx`` (``ivf``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.functions.arrays import sq_norm
from lexispark.functions.keys import r6

TILE_ROWS = 2048
CHUNK = 128
BLOCK_BYTES = 96 << 20      # vectors of a block of queries, with their running top-k
STRIPE_BYTES = 512 << 20    # vectors that a task reads as targets


def _tile_schema(carry):
    fields = [T.StructField("tile", T.LongType()), T.StructField("within", T.StringType()),
              T.StructField("ids", T.BinaryType()),
              T.StructField("mat", T.BinaryType()), T.StructField("norm", T.BinaryType()),
              T.StructField("d", T.IntegerType())]
    fields += [T.StructField(f"c_{c}", T.ArrayType(T.StringType())) for c in carry]
    return T.StructType(fields)


def _packer(carry, tile_rows: int, stored):
    def run(batches):
        from pyspark import TaskContext
        number, seq = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}          # rows of each set that wait for a full tile

        def emit(pdf, within):
            mat = np.stack([np.asarray(v, dtype=stored) for v in pdf["vec"]])
            row = {"tile": [number << 32 | seq], "within": [within], "ids": [pdf["id"].to_numpy("<i8").tobytes()],
                   "mat": [mat.tobytes()], "norm": [pdf["norm"].to_numpy(np.float64).tobytes()], "d": [mat.shape[1]]}
            for c in carry:
                row[f"c_{c}"] = [pdf[c].to_numpy(object)]
            return pd.DataFrame(row)
        for batch in batches:
            for within, pdf in batch.groupby("within", sort=True):
                held.setdefault(within, []).append(pdf)
                while sum(map(len, held[within])) >= tile_rows:
                    whole = pd.concat(held[within], ignore_index=True)
                    seq += 1
                    yield emit(whole[:tile_rows], within)
                    held[within] = [whole[tile_rows:]]
        for within, parts in held.items():
            rest = pd.concat(parts, ignore_index=True)
            if len(rest):
                seq += 1
                yield emit(rest, within)
    return run


class _Tile:
    """One row of a batch: its vectors, as doubles divided by their lengths, and its labels."""

    def __init__(self, batch, i, carry):
        self.ids = np.frombuffer(batch.column("ids")[i].as_buffer(), "<i8")
        mat, d = batch.column("mat")[i].as_buffer(), batch.column("d")[i].as_py()
        mat = np.frombuffer(mat, "<f4" if mat.size == 4 * d * len(self.ids) else "<f8").reshape(len(self.ids), d)
        self.mat = mat / np.frombuffer(batch.column("norm")[i].as_buffer(), np.float64)[:, None]
        self.carry = [np.array(batch.column(f"c_{c}")[i].as_py(), dtype=object) for c in carry]


class _Best:
    """The running top-k of one tile of queries: similarities, ids and labels, best first."""

    def __init__(self, tile, n_carry):
        # the ids' memory is the batch's, which goes
        self.ids, self.mat, self.carry = tile.ids.copy(), tile.mat, tile.carry
        self.s, self.i = np.empty((len(self.ids), 0)), np.empty((len(self.ids), 0), np.int64)
        self.x = [np.empty((len(self.ids), 0), object) for _ in range(n_carry)]

    def meet(self, tile, k):
        if self.s.shape[1] < k:
            sims = self.mat @ tile.mat.T
            col = _winners(sims, tile.ids, k)
            s = np.concatenate([self.s, np.take_along_axis(sims, col, 1)], axis=1)
            i = np.concatenate([self.i, tile.ids[col]], axis=1)
            x = [np.concatenate([a, t[col]], axis=1) for a, t in zip(self.x, tile.carry)]
            best = np.lexsort((i, -s), axis=1)[:, :k]
            self.s, self.i = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            self.x = [np.take_along_axis(a, best, 1) for a in x]
            return
        # those that beat the k-th best so far, or equal it and have a smaller id
        found = []
        for a in range(0, len(self.ids), CHUNK):       # products that stay in the processor's cache
            sims = self.mat[a:a + CHUNK] @ tile.mat.T
            at = np.flatnonzero(sims >= self.s[a:a + CHUNK, -1:])
            if len(at):
                found.append((at + a * sims.shape[1], sims.ravel()[at]))
        if not found:
            return
        at, new = map(np.concatenate, zip(*found))
        row, col = np.divmod(at, len(tile.ids))
        use = (new > self.s[row, -1]) | (tile.ids[col] < self.i[row, -1])
        row, col, new = row[use], col[use], new[use]
        if not len(row):
            return
        some, place = np.unique(row, return_inverse=True)
        where = np.concatenate([np.repeat(np.arange(len(some)), k), place])
        s = np.concatenate([self.s[some].ravel(), new])
        i = np.concatenate([self.i[some].ravel(), tile.ids[col]])
        order = np.lexsort((i, -s, where))
        first = np.searchsorted(where[order], np.arange(len(some)))
        best = order[first[:, None] + np.arange(k)]
        self.s[some], self.i[some] = s[best], i[best]
        for a, t in zip(self.x, tile.carry):
            a[some] = np.concatenate([a[some].ravel(), t[col]])[best]


def _winners(score: np.ndarray, ids: np.ndarray, k: int):
    """(row, column) of the k best of each row, best first, ties to the smaller id."""
    k = min(k, score.shape[1])
    if not k:
        return np.zeros((len(score), 0), np.int64)
    if score.shape[1] > k:
        # by id among equal scores: the k-th best score may be shared by more columns than fit
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
        row, col = np.nonzero(score >= least)
    else:
        row, col = (x.ravel() for x in np.indices(score.shape))
    order = np.lexsort((np.broadcast_to(ids, score.shape)[row, col], -score[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(score)))
    return col[np.arange(len(row)) - first[row] < k].reshape(len(score), k)


def _cells(k: int, carry, by=None):
    """Rows come sorted by (cell, stripe), the tiles of queries first."""
    def run(batches):
        here, block = None, []

        def out():
            for q in block:
                n, kk = q.s.shape
                cols = {"qid": np.repeat(q.ids, kk), "rank": np.tile(np.arange(1, kk + 1, dtype=np.int32), n),
                        "nid": q.i.ravel(), "sim": q.s.ravel()}
                if by is not None:
                    cols["within"] = pa.repeat(pa.scalar(here[2], pa.string()), n * kk)
                for j, c in enumerate(carry):
                    cols[f"q_{c}"] = pa.array(np.repeat(q.carry[j], kk), pa.string())
                    cols[f"n_{c}"] = pa.array(q.x[j].ravel(), pa.string())
                yield pa.RecordBatch.from_pydict(cols)
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("cell", "stripe", "within", "kind")]
            for i, (cell, stripe, within, kind) in enumerate(zip(*names)):
                tile = _Tile(batch, i, carry)
                if here is None or here[:2] != (cell, stripe):
                    yield from out()
                    here, block = (cell, stripe, within), []
                if kind == 0:
                    block.append(_Best(tile, len(carry)))
                else:
                    for q in block:
                        q.meet(tile, k)
        yield from out()
    return run


def knn(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
        metric: str = "ip", carry=(), tile_rows: int = TILE_ROWS, stripes: int | None = None,
        by: str | None = None) -> DataFrame:
    """Exact top-k neighbours of every vector among all vectors (self included), or among those with
    the same value of ``by``: sets of vectors share one grid, whose tiles hold one set each and meet
    tiles of their set only (rows without a set take no part).

    Output ([by,] qid, rank, nid, sim [, q_<c>, n_<c> for carried columns]); ties by nid.
    metric 'cosine' normalises first (zero vectors are dropped: no direction).  ``stripes`` is the number
    of tasks that a block of queries is dealt over; by default enough for two tasks a core, and one where
    there are as many blocks.
    """
    carry = list(carry)
    within = F.lit("") if by is None else F.col(by).cast("string")
    # floats travel as floats, with their lengths, and are normalised where they are multiplied
    kind, stored = ("array<float>", "<f4") if dict(vectors.dtypes)[vec_col] == "array<float>" else (
        "array<double>", "<f8")
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), within.alias("within"),
                       F.col(vec_col).cast(kind).alias("vec"),
                       *[F.col(c).cast("string").alias(c) for c in carry]).where(
        F.col("vec").isNotNull() & F.col("within").isNotNull())
    # a zero vector has no length to divide by
    v = v.withColumn("norm", F.sqrt(sq_norm("vec"))).where(F.col("norm") > 0) if metric == "cosine" else \
        v.withColumn("norm", F.lit(1.0))
    # read several times below: one packing for all, kept in the shared checkpoint folder
    tiles = v.mapInPandas(_packer(carry, tile_rows, stored), _tile_schema(carry)).checkpoint()
    tasks = 2 * v.sparkSession.sparkContext.defaultParallelism
    n_tiles, d = tiles.agg(F.count(F.lit(1)), F.coalesce(F.max("d"), F.lit(1))).first()
    span = max(1, min(-(-n_tiles // tasks), BLOCK_BYTES // (tile_rows * (8 * d + 24 * k))))
    # the names of all tiles are some 30 bytes for TILE_ROWS vectors
    order = Window.partitionBy("within").orderBy("tile")
    names = tiles.select("tile", "within").withColumn("at", F.row_number().over(order) - 1).select(
        "tile", "within", "at", (F.dense_rank().over(Window.orderBy("within", F.floor(F.col("at") / span))) - 1)
        .cast("int").alias("cell"))
    if stripes is None:
        stripes = max(1, min(n_tiles, max(tasks * span // max(n_tiles, 1),
                                          -(-n_tiles * tile_rows * 8 * d // STRIPE_BYTES))))
    wide = ["ids", "mat", "norm", "d", *[f"c_{c}" for c in carry]]
    named = tiles.drop("within").join(F.broadcast(names), "tile")
    met = named.join(F.broadcast(names.select("cell", "within").distinct().select(
        F.col("cell").alias("asked"), F.col("within").alias("_w"))), F.col("within") == F.col("_w")).select(
        F.lit(1).alias("kind"), "tile", "within", F.pmod("at", F.lit(stripes)).alias("stripe"), *wide,
        F.col("asked").alias("cell"))
    held = named.select(F.lit(0).alias("kind"), "tile", "within", F.explode(F.sequence(
        F.lit(0), F.lit(stripes - 1))).alias("stripe"), *wide, "cell")
    fields = [T.StructField("qid", T.LongType()), T.StructField("rank", T.IntegerType()),
              T.StructField("nid", T.LongType()), T.StructField("sim", T.DoubleType())]
    if by is not None:
        fields.append(T.StructField("within", T.StringType()))
    for c in carry:
        fields += [T.StructField(f"q_{c}", T.StringType()), T.StructField(f"n_{c}", T.StringType())]
    # cells are numbered, so each of them is a task of its own
    number = (F.col("cell") * stripes + F.col("stripe")).cast("int")
    n_cells = max(1, names.agg(F.max("cell")).first()[0] + 1 if n_tiles else 1)
    ranked = (met.unionByName(held).repartitionById(n_cells * stripes, number)
              .sortWithinPartitions("cell", "stripe", "kind", "tile")
              .mapInArrow(_cells(k, carry, by), T.StructType(fields)))
    sets = [] if by is None else ["within"]
    if stripes > 1:
        w = Window.partitionBy(*sets, "qid").orderBy(F.desc("sim"), "nid")
        ranked = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*[F.col(x).alias(by) for x in sets], "qid", "rank", "nid", "sim", *[x for c in carry for x in (f"q_{c}", f"n_{c}")])


def knn_approx(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", **options) -> DataFrame:
    """Approximate cosine top-k by an inverted-file index (``ivf.knn_ivf``)."""
    from lexispark.operators.ivf import knn_ivf
    return knn_ivf(vectors, k, id_col, vec_col, **options)


# --- V6/V7 retrieval scores -------------------------------------------------------------------

def retrieval_scores(neighbors: DataFrame, labels: DataFrame | None, k: int, label: str,
                     id_col: str = "id", drop: str = "first", by=()) -> DataFrame:
    """Per query (of each set, with ``by`` columns in both inputs): nNeighbors (label size incl. self), retrieved (hits in ranks 2..k),
    ap (mean precision at each hit, 0 without hits), accuracy = retrieved/min(nNeighbors, k).

    ``neighbors`` either carries q_<label>/n_<label> (from ``knn(carry=...)``: no join) or
    labels are joined from ``labels(id, label)``.  drop='first' drops rank 1 whatever it
    is (reference behaviour); 'self' drops the query's own id instead.
    """
    nb, by = neighbors, list(by)
    if f"q_{label}" not in nb.columns:
        lab = labels.select(*by, F.col(id_col).alias("_id"), F.col(label).cast("string").alias("_l"))
        nb = (nb.join(lab.withColumnRenamed("_id", "qid").withColumnRenamed("_l", f"q_{label}"), [*by, "qid"])
              .join(lab.withColumnRenamed("_id", "nid").withColumnRenamed("_l", f"n_{label}"), [*by, "nid"]))
    if drop == "first":
        nb = nb.where(F.col("rank") > 1).withColumn("pos", F.col("rank") - 1)
    else:
        nb = nb.where(F.col("qid") != F.col("nid"))
        nb = nb.withColumn("pos", F.row_number().over(Window.partitionBy(*by, "qid").orderBy("rank")))
    nb = nb.withColumn("hit", (F.col(f"q_{label}") == F.col(f"n_{label}")).cast("int"))
    w = Window.partitionBy(*by, "qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nb = nb.withColumn("cum", F.sum("hit").over(w))
    per_q = nb.groupBy(*by, "qid").agg(
        F.sum("hit").cast("bigint").alias("retrieved"),
        F.avg(F.when(F.col("hit") == 1, F.col("cum") / F.col("pos"))).alias("_ap"))
    sizes = labels.groupBy(*by, F.col(label).cast("string").alias("_l")) \
        .agg(F.count(F.lit(1)).alias("nNeighbors"))
    qlab = labels.select(*by, F.col(id_col).alias("qid"), F.col(label).cast("string").alias("_l"))
    res = qlab.join(sizes, [*by, "_l"]).join(per_q, [*by, "qid"], "left")
    return res.select(
        *by, "qid", F.col("_l").alias(label), "nNeighbors",
        F.coalesce("retrieved", F.lit(0)).cast("bigint").alias("retrieved"),
        F.coalesce("_ap", F.lit(0.0)).alias("ap"),
        (F.coalesce("retrieved", F.lit(0)) / F.least(F.col("nNeighbors"), F.lit(k))).alias("accuracy"))


def micro_macro(scores: DataFrame, label: str, key: str | None = None, by=()) -> DataFrame:
    """micro = mean over rows; macro = mean over labels of per-label means (one pass), of each set."""
    by = list(by)
    per = scores.groupBy(*by, label).agg(F.sum("accuracy").alias("_sa"), F.sum("ap").alias("_sp"),
                                    F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(*by).agg((F.sum("_sa") / F.sum("_n")).alias("micro_acc"),
                  F.avg(F.col("_sa") / F.col("_n")).alias("macro_acc"),
                  (F.sum("_sp") / F.sum("_n")).alias("micro_ap"),
                  F.avg(F.col("_sp") / F.col("_n")).alias("macro_ap"))
    return out.withColumn("key", F.lit(key or label))


# --- V8/V9 random baselines ---------------------------------------------------------------------

def _pooled(labels: DataFrame, label: str, within: str | None, id_col: str) -> DataFrame:
    """id, label, pool, _N (rows of the pool) and _tn (rows of the pool with the row's label); the
    pool is the row's ``within`` group or the whole table."""
    lab = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("_lab"),
                        (F.col(within) if within else F.lit(1)).alias("_w"))
    n = lab.groupBy("_w", "_lab").agg(F.count(F.lit(1)).alias("_tn"))
    pool = n.groupBy(F.col("_w").alias("_pw")).agg(F.sum("_tn").alias("_N"))
    sizes = n.join(pool, F.col("_w").eqNullSafe(F.col("_pw"))).select(
        F.col("_w").alias("_sw"), F.col("_lab").alias("_sl"), "_tn", "_N")
    return lab.join(sizes, F.col("_w").eqNullSafe(F.col("_sw")) & F.col("_lab").eqNullSafe(F.col("_sl")))


def random_baseline_expected(labels: DataFrame, label: str, k: int, within: str | None = None,
                             id_col: str = "id") -> DataFrame:
    """Closed form of the random baselines: E[retrieved] = min(k, N) * n / N per row, with N the
    candidate pool (whole table, or the row's ``within`` group) and n = nNeighbors the rows of the
    pool that have the row's label."""
    base = _pooled(labels, label, within, id_col)
    exp = F.least(F.lit(k), F.col("_N")) * F.col("_tn") / F.col("_N")
    return base.select(F.col("id").alias(id_col), F.col("_lab").alias(label),
                       F.col("_tn").alias("nNeighbors"), exp.alias("exp_retrieved"),
                       (exp / F.least(F.col("_tn"), F.lit(k))).alias("exp_accuracy"))


def _uniform(seed: int, ids: np.ndarray, i: int) -> np.ndarray:
    """A uniform number of each id, by the splitmix64 finaliser."""
    mask = (1 << 64) - 1
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + (i + 1) * 0x2545F4914F6CDD1D) & mask)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _baseline_sampler(k: int, seed: int):
    """Draw the first k of a random permutation one by one, for all rows of a batch at once."""
    def run(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy(np.int64)
            left, good = pdf["_N"].to_numpy(np.float64), pdf["_tn"].to_numpy(np.float64)
            hits, ap = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            for i in range(k):
                hit = (left > 0) & (_uniform(seed, ids, i) * np.maximum(left, 1) < good)
                hits += hit
                ap += np.where(hit, hits / (i + 1), 0.0)
                good, left = good - hit, left - 1
            yield pdf.assign(retrieved=hits, ap=np.where(hits > 0, ap / np.maximum(hits, 1), 0.0))
    return run


def random_baseline(labels: DataFrame, label: str, k: int, within: str | None = None,
                    id_col: str = "id", seed: int = 1001) -> DataFrame:
    """Sampled random baseline without the N x k explode: each row draws k neighbours without
    replacement from its pool, seeded by its id (Arrow batches, no shuffle for the draw)."""
    base = _pooled(labels, label, within, id_col).select(
        "id", F.col("_lab").cast("string").alias("_lab"), "_tn", "_N")
    drawn = base.mapInPandas(_baseline_sampler(k, seed),
                             "id bigint, _lab string, _tn bigint, _N bigint, retrieved bigint, ap double")
    return drawn.select(F.col("id").alias(id_col), F.col("_lab").alias(label),
                        F.col("_tn").alias("nNeighbors"), "retrieved", "ap",
                        (F.col("retrieved") / F.least(F.col("_tn"), F.lit(k))).alias("accuracy"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df


__all__ = ["knn", "knn_approx", "retrieval_scores", "micro_macro", "random_baseline",
           "random_baseline_expected"]
