"""Exact top-k search by no-random-access aggregation.

Vectors are split into tiles.  In a tile every component has a list of the tile's vectors, sorted
by value; a query reads the list of a positive component from its large end and that of a negative
one from its small end.  The lists are read in growing depths.  After each depth a vector's score
is bounded: above by its seen components and the last value read of every other list, below by
its seen components and the far end of every other list.  Vectors whose upper bound is under the
k-th best score known for sure are outsiders; reading stops once few vectors are left, and their
final scores are resolved.  Bounds of all queries and vectors of a tile are matrix products.

Query tiles and tiles of candidates meet in cells (query tile, stripe of candidates); a cell's
task holds one tile of either kind and the best k so far, which carry over to its next tile, so
later tiles are left early.  The k best of each stripe are merged by a window over at most
stripes x k rows a query.

Defined cases: rows with null ids, null vectors or null or non-finite components take no part;
only vectors of equal length are compared; a query's candidates are all rows with another id;
rows with equal ids are rows of their own, as queries and as candidates; scores beyond the range
of a long are cut to it; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import settle

TILE = 4096            # candidates held at once
QUERY_TILE = 1024      # queries of a cell
QUERIES_AT_ONCE = 128
DEPTHS = (0.125, 0.3, 0.6)
FEW = 4                # stop reading at this many times k vectors a query
LONG = (1 << 63) - 1


def quantised(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of every component, or null if the vector takes no part."""
    value = lambda x: x.cast("double")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(value(x)) | (
        F.abs(value(x)) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)),
                  F.transform(vector, lambda x: F.floor(value(x) * F.lit(factor)).cast("bigint")))


def _tiles(size: int, kind: str):
    """Pack (id, vector) rows of a partition into tiles of one vector length."""
    def run(batches):
        from pyspark import TaskContext
        number, seq = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def emit(dim):
            nonlocal seq
            ids, rows = zip(*held.pop(dim))
            seq += 1
            return pa.RecordBatch.from_pydict({
                "kind": [kind], "tile": [number << 32 | seq], "dim": [dim],
                "ids": [np.array(ids, "<i8").tobytes()],
                "rows": [np.concatenate(rows).astype("<i8").tobytes() if dim else b""]})
        for batch in batches:
            flat = batch.column("v")
            at = np.asarray(flat.offsets)
            values = flat.values.to_numpy(zero_copy_only=False)
            for i, row_id in enumerate(batch.column("id").to_pylist()):
                dim = int(at[i + 1] - at[i])
                held.setdefault(dim, []).append((row_id, values[at[i]:at[i + 1]]))
                if len(held[dim]) == size:
                    yield emit(dim)
        for dim in list(held):
            yield emit(dim)
    return run


TILE_SCHEMA = "kind string, tile bigint, dim bigint, ids binary, rows binary"


class Tile:
    """Candidates with their sorted lists, and bounds at a depth."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.lists = np.sort(rows, axis=0)      # each component's values in ascending order

    def at_depth(self, keep: np.ndarray, read: int):
        """For the vectors ``keep`` after ``read`` entries of each list: matrices whose products
        with the positive and the negative parts of a query are upper and lower bounds."""
        x, n = self.rows[keep], len(self.ids)
        high, low = self.lists[n - read], self.lists[read - 1]   # last values read
        return (np.maximum(x, high), np.minimum(x, low),
                np.where(x >= high, x, self.lists[0]), np.where(x <= low, x, self.lists[-1]))


class Best:
    """The best k of each query so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.q, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.sure = np.full(len(ids), -np.inf)   # k-th best score

    def add(self, q, vec, score):
        q, vec, score = (np.concatenate([a, b]) for a, b in (
            (self.q, q), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, ~score, q))      # ~ turns the order and cannot overflow
        q, vec, score = q[order], vec[order], score[order]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.vec, self.score = q[keep], vec[keep], score[keep]
        full = np.bincount(self.q, minlength=len(self.ids)) >= self.k
        lowest = np.full(len(self.ids), np.inf)
        np.minimum.at(lowest, self.q, self.score.astype(np.float64))
        self.sure = np.where(full, lowest, -np.inf)


def exact_type(a: np.ndarray, b: np.ndarray):
    """A type in which all inner products and their bounds are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (np.float32 if most < 2.0 ** 23 else np.float64 if most < 2.0 ** 52
            else np.int64 if most < 2.0 ** 62 else object)


def search_tile(queries: np.ndarray, best: Best, tile: Tile) -> None:
    """Fold a tile of candidates into the best k of each query."""
    kind = exact_type(queries, tile.rows)
    rows = Tile(tile.ids, tile.rows.astype(kind))
    n, k = len(tile.ids), best.k
    for a in range(0, len(queries), QUERIES_AT_ONCE):
        q = queries[a:a + QUERIES_AT_ONCE].astype(kind)
        up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
        keep = np.arange(n)
        alive = tile.ids[:, None] != best.ids[None, a:a + len(q)]   # vectors x queries
        sure = best.sure[a:a + len(q)].copy()
        # beyond 2^52 bounds as doubles would not be exact: such tiles are resolved whole
        for depth in DEPTHS if kind in (np.float32, np.float64) else ():
            read = max(1, int(depth * n))
            hi_up, hi_down, lo_up, lo_down = rows.at_depth(keep, read)
            lower = np.where(alive, lo_up @ up + lo_down @ down, -np.inf)
            if len(keep) >= k:
                sure = np.maximum(sure, np.partition(lower, len(keep) - k, axis=0)[len(keep) - k])
            alive &= hi_up @ up + hi_down @ down >= sure      # ties stay
            left = alive.any(1)
            keep, alive = keep[left], alive[left]
            if alive.sum() <= FEW * k * len(q):
                break
        if alive.sum() * 8 < alive.size and kind is not object:
            v, who = np.nonzero(alive)
            score = np.concatenate([np.einsum("ij,ij->i", rows.rows[keep[v[i:i + 65536]]],
                                              q[who[i:i + 65536]])
                                    for i in range(0, len(v), 65536)] or [np.zeros(0)])
        else:
            full = rows.rows[keep] @ q.T
            alive &= full >= sure
            v, who = np.nonzero(alive)
            score = full[v, who]
        if kind is object:
            score = np.array([max(-LONG - 1, min(LONG, int(x))) for x in score])
        best.add(who + a, tile.ids[keep[v]], score.astype(np.int64))


def _cells(k: int):
    """Rows come sorted by (query tile, stripe), the query tile first."""
    def run(batches):
        here, queries, best = None, None, None

        def done():
            return pa.RecordBatch.from_pydict({
                "query_row": best.q + (here[0] << 12), "query_id": best.ids[best.q],
                "vec_id": best.vec, "score": best.score})
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                rows = np.frombuffer(row["rows"], "<i8").reshape(len(ids), row["dim"])
                if row["kind"] == "a query":
                    if best is not None and len(best.q):
                        yield done()
                    here, queries, best = (row["cell"], row["stripe"]), rows, Best(ids, k)
                elif here == (row["cell"], row["stripe"]):
                    search_tile(queries, best, Tile(ids, rows))
        if best is not None and len(best.q):
            yield done()
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, *, stripes: int = 4,
          tile: int = TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the highest inner products,
    ties to the smaller id.  Both inputs have id (bigint) and v (array of bigint)."""
    pack = lambda df, size, kind: df.filter("id is not null and v is not null").select(
        "id", "v").mapInArrow(_tiles(size, kind), TILE_SCHEMA)
    # the stated query set in blocks: a number for each block of query_tile queries
    few = pack(queries, query_tile, "a query").withColumn("cell", F.col("tile"))
    few = settle(few, "queries")
    many = pack(candidates, tile, "candidates").withColumn(
        "stripe", F.pmod(F.xxhash64("tile"), F.lit(stripes)).cast("int"))
    cells = few.select("cell", "dim").withColumnRenamed("dim", "qdim")
    # a row of a few numbers for each block of queries; Catalyst knows its size from the files
    met = many.join(cells, F.col("dim") == F.col("qdim")).select(
        "kind", "tile", "dim", "ids", "rows", "cell", "stripe")
    held = few.select("kind", "tile", "dim", "ids", "rows", "cell", F.explode(F.sequence(
        F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    found = (met.union(held).repartition("cell", "stripe")
             .sortWithinPartitions("cell", "stripe", "kind", "tile")
             .mapInArrow(_cells(k), "query_row bigint, query_id bigint, vec_id bigint, score bigint"))
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


TOPK_SQL = """
with e as (
  select vec_id, i, floor(64 * embedding[i]::double)::bigint as x
  from embeddings, unnest(range(1, len(embedding) + 1)) t(i)
  where embedding is not null
    and len([y for y in embedding if y is null or not isfinite(y)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score
  from e q join e c on q.i = c.i and q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0 group by q.vec_id, c.vec_id),
r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
