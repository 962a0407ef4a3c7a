"""One logistic model per lemma, all fitted at once.

The rows of a lemma are packed once into tiles of at most TILE_ROWS rows.  Each turn joins the
weights of the lemmas that are still moving to their tiles; a tile gives the gradient and the
curvature of its rows, these are added up per lemma by an aggregate that merges on the map side,
and a Newton step is solved for each lemma.  A hot lemma is many tiles in many tasks; what a
turn shuffles are the sums.  Lemmas that have converged leave the loop, and the driver sees the number
of those left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.keys import rkey
from lexispark.operators.sampling import exact_rank
from lexispark.sources.io import settle

TILE_ROWS = 1024


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack([np.concatenate([np.asarray(a, np.float64), np.asarray(b, np.float64)])
                  for a, b in zip(pdf["e1"], pdf["e2"])])
    return pd.DataFrame({"lemma": [pdf["lemma"].iloc[0]], "tile": [pdf["tile"].iloc[0]],
                         "n": [len(pdf)], "d": [x.shape[1]], "x": [x.tobytes()],
                         "y": [pdf["y"].to_numpy(np.float64).tobytes()],
                         "reach": [float((x * x).sum(1).max())]})


def tiles_of(pairs: DataFrame, label: str, lemma: str, id_col: str, e1: str, e2: str,
             tile_rows: int = TILE_ROWS) -> DataFrame:
    """lemma, tile, n, d, x, y, reach: rows without a lemma, label or vector take no part."""
    rows = pairs.select(F.col(lemma).alias("lemma"), F.col(id_col).alias("id"),
                        F.col(label).cast("double").alias("y"), F.col(e1).cast("array<double>").alias("e1"),
                        F.col(e2).cast("array<double>").alias("e2")).dropna()
    ranked = exact_rank(rows, ["lemma"], rkey("logistic", "id"), "id", out="r")
    cut = ranked.withColumn("tile", F.floor((F.col("r") - 1) / tile_rows).cast("bigint"))
    kind = dict(rows.dtypes)["lemma"]
    return cut.select("lemma", "tile", "y", "e1", "e2").groupBy("lemma", "tile").applyInPandas(
        _pack, f"lemma {kind}, tile bigint, n bigint, d int, x binary, y binary, reach double")


def _slopes(batches):
    """For each tile: gradient, upper triangle of the curvature, and loss of its rows."""
    for pdf in batches:
        sums = []
        for x, y, d, w in zip(pdf["x"], pdf["y"], pdf["d"], pdf["w"]):
            x, y = np.frombuffer(x).reshape(-1, d), np.frombuffer(y)
            w = np.zeros(d) if w is None else np.asarray(w, np.float64)
            z = x @ w
            p = 0.5 * (1.0 + np.tanh(0.5 * z))
            h = (x * (p * (1.0 - p))[:, None]).T @ x
            loss = np.logaddexp(0.0, z) - y * z
            sums.append(np.concatenate([x.T @ (p - y), h[np.triu_indices(d)], [loss.sum()]]))
        yield pd.DataFrame({"lemma": pdf["lemma"], "sums": sums})


def _steps(l2: float, tol: float):
    """A damped Newton step of each lemma: the length log(1 + r) / r, r = step length x longest row,
    never rises for logistic losses, and tends to 1 near the optimum."""
    def run(batches):
        for pdf in batches:
            out = []
            for s, n, d, reach, w in zip(pdf["sums"], pdf["n"], pdf["d"], pdf["reach"], pdf["w"]):
                s = np.asarray(s, np.float64)
                w = np.zeros(d) if w is None else np.asarray(w, np.float64)
                h = np.zeros((d, d))
                h[np.triu_indices(d)] = s[d:-1]
                h = h + np.triu(h, 1).T + l2 * n * np.eye(d)
                step = np.linalg.solve(h, s[:d] + l2 * n * w)
                r = np.sqrt(reach) * np.linalg.norm(step)
                new = w - step * (np.log1p(r) / r if r > 0 else 1.0)
                out.append((new, float(np.abs(step).max(initial=0.0)),
                            float((s[-1] + 0.5 * l2 * n * (w @ w)) / n)))
            yield pd.DataFrame({"lemma": pdf["lemma"], "n": pdf["n"], "d": pdf["d"], "reach": pdf["reach"],
                                "w": [o[0] for o in out], "moved": [o[1] for o in out],
                                "objective": [o[2] for o in out],
                                "steps": pdf["steps"] + 1, "moving": [o[1] > tol for o in out]})
    return run


def fit_lemma_logistic(pairs: DataFrame, l2: float = 0.01, iters: int = 50, tol: float = 1e-9,
                       label: str = "label", lemma: str = "lemma", id_col: str = "pair_id",
                       e1: str = "e1", e2: str = "e2", tile_rows: int = TILE_ROWS) -> DataFrame:
    """lemma, n, weight, objective, steps, converged: for each lemma the w that minimises
    mean(log loss of sigmoid(w . [e1; e2])) + l2 / 2 * |w|^2 over all its pairs; it is unique for
    l2 > 0.  ``objective`` is its value there, before the last step.  ``weight`` is what
    ``bilinear_scores`` takes.  The dimension d may differ between lemmas, not within one; a lemma
    holds d^2 / 2 numbers in a turn.  Lemmas still moving after ``iters`` turns are not converged."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    tiles = settle(tiles_of(pairs, label, lemma, id_col, e1, e2, tile_rows), "tiles")
    kind = dict(tiles.dtypes)["lemma"]
    state = (f"lemma {kind}, n bigint, d int, reach double, w array<double>, moved double, "
             "objective double, steps int, moving boolean")
    heads = tiles.groupBy("lemma").agg(F.sum("n").alias("n"), F.max("d").alias("d"), F.max("reach").alias("reach"))
    moving = heads.select("*", F.lit(None).cast("array<double>").alias("w"), F.lit(0).alias("steps"))
    done = None
    for turn in range(iters):
        sums = (tiles.select("lemma", "x", "y", "d").join(moving.select("lemma", "w"), "lemma")
                .mapInPandas(_slopes, f"lemma {kind}, sums array<double>")
                .withColumn("sums", array_to_vector("sums"))
                .groupBy("lemma").agg(Summarizer.sum(F.col("sums")).alias("sums"))
                .select("lemma", vector_to_array("sums").alias("sums")))
        now = settle(moving.join(sums, "lemma").select("lemma", "n", "d", "reach", "w", "steps", "sums")
                      .mapInPandas(_steps(l2, tol), state), "weights")
        last = turn == iters - 1
        still = now.where("moving")
        out = now if last else now.where("not moving")
        done = out if done is None else done.unionByName(out)
        if last or not still.limit(1).count():
            break
        moving = still.drop("moved", "objective", "moving")
    return done.select(F.col("lemma").alias(lemma), "n", F.col("w").alias("weight"), "objective", "steps",
                       (~F.col("moving")).alias("converged"))


__all__ = ["fit_lemma_logistic", "tiles_of"]
