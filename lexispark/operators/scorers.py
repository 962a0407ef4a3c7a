"""Batch scorers of sentence pairs and masked words (C20, M3, M5).

A scorer is a function of a batch, as a model would be: lists of texts in, scores out.  Rows are
sorted by length inside their partition, so batches hold texts of about one length, and each batch
goes to the scorer as a whole; rows carry their ids, so no order has to be restored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.tiles import packed

PairScorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
TileScorer = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
MaskScorer = Callable[[Sequence[str]], Sequence[Sequence[tuple[str, float]]]]


def by_length(df: DataFrame, *texts: str) -> DataFrame:
    """Sort rows by the total length of ``texts`` within each partition (no shuffle)."""
    total = sum((F.length(F.coalesce(F.col(t), F.lit(""))) for t in texts), F.lit(0))
    return df.withColumn("_len", total).sortWithinPartitions("_len").drop("_len")


def _batches(pdfs, size: int):
    for pdf in pdfs:
        for a in range(0, len(pdf), size):
            yield pdf[a:a + size]


def score_pairs(pairs: DataFrame, scorers: dict[str, PairScorer], id_col: str = "pair_id",
                s1: str = "s1", s2: str = "s2", backward: bool = False, batch: int = 128) -> DataFrame:
    """(id, model, direction, score) for every pair and scorer; backward hands the sentences over in
    reverse order."""
    kind = dict(pairs.dtypes)[id_col]
    a, b = (s2, s1) if backward else (s1, s2)

    def run(pdfs):
        for pdf in _batches(pdfs, batch):
            for name, scorer in scorers.items():
                yield pd.DataFrame({id_col: pdf[id_col], "model": name, "score": list(
                    map(float, scorer(pdf[a].tolist(), pdf[b].tolist())))})
    got = by_length(pairs.select(id_col, s1, s2), s1, s2).mapInPandas(
        run, f"{id_col} {kind}, model string, score double")
    return got.withColumn("direction", F.lit("backward" if backward else "forward"))


def score_background(items: DataFrame, background: DataFrame, scorer: TileScorer, item_cols: Sequence[str],
                     bg_cols: Sequence[str], item_id: str = "item_id", bg_id: str = "bg_id",
                     directions: Sequence[str] = ("forward", "backward"), tile: int = 256) -> DataFrame:
    """Every item against every row of the background pool, in tiles of items x pool that a batch scorer
    fills: (item columns.., background columns.., direction, score).

    The scorer gets the frames of the first and of the second sentences and gives a matrix of scores;
    'forward' has the items first, 'backward' the pool, and one pass over the items gives both.  Items
    are spread by a hash, so a table of one file is many tasks; the pool, a fixed number of rows a
    time bin, is one packed row that is broadcast and meets each tile once."""
    from lexispark.operators.pairs import spread
    left = [item_id, *[c for c in item_cols if c != item_id]]
    right = [bg_id, *[c for c in bg_cols if c != bg_id]]
    pool = background.select(*right).agg(F.array_sort(F.collect_list(F.struct(*right))).alias("_p")).select(
        *[F.col("_p").getField(c).alias(f"_b_{c}") for c in right])
    tiles = packed(spread(items.select(*left), item_id), tile).crossJoin(F.broadcast(pool))
    kinds = {**{c: t for c, t in background.dtypes if c in right}, **{c: t for c, t in items.dtypes if c in left}}
    kept = [c for c in dict.fromkeys([*left, *right]) if not kinds[c].startswith(("array", "struct", "map"))]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c).slice(k, 1).flatten() for c in batch.schema.names}
                one = pd.DataFrame({c: r[c].to_pandas() for c in left})
                bg = pd.DataFrame({c: r[f"_b_{c}"].to_pandas() for c in right})
                n, m = len(one), len(bg)
                if not n or not m:
                    continue
                i, j = pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(np.arange(m), n))
                held = [r[c].take(i) if c in left else r[f"_b_{c}"].take(j) for c in kept]
                for name in directions:
                    got = scorer(one, bg) if name == "forward" else np.asarray(scorer(bg, one)).T
                    yield pa.RecordBatch.from_arrays(
                        [*held, pa.array([name]).take(pa.array(np.zeros(n * m, np.int64))),
                         pa.array(np.asarray(got, np.float64).reshape(n * m))], names=[*kept, "direction", "score"])
    return tiles.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", direction string, score double")


def order_scorer(*vecs: str, sharpness: float = 8.0) -> TileScorer:
    """sigmoid(sharpness * (first half of a . second half of b - second half of a . first half of b)): how
    sure it is that sentence a is the later one.  Deterministic and without a model; swapping the
    sentences gives the complement.  A frame's vectors are in the first of the columns ``vecs`` it has."""
    def run(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        x, y = (np.stack([np.asarray(v, np.float64) for v in f[next(c for c in vecs if c in f)]]) for f in (a, b))
        h = x.shape[1] // 2
        return 1.0 / (1.0 + np.exp(-sharpness * (x[:, :h] @ y[:, h:].T - x[:, h:] @ y[:, :h].T)))
    return run


def score_masks(df: DataFrame, scorers: dict[str, MaskScorer], id_col: str = "quote_id",
                quote: str = "quote", keyword: str = "keyword", mask: str = "[MASK]",
                batch: int = 200) -> DataFrame:
    """(id, model, keyword, rank, score): the first occurrence of the keyword is masked, each scorer
    ranks candidates for the mask, and rank is the keyword's place from 1 (-1 and no score if it is
    not among them)."""
    from lexispark.functions.text import mask_first
    kind = dict(df.dtypes)[id_col]
    masked = df.select(id_col, F.col(keyword).alias("keyword"), mask_first(quote, keyword, mask).alias("masked"))

    def run(pdfs):
        for pdf in _batches(pdfs, batch):
            for name, scorer in scorers.items():
                ranks, scores = [], []
                for word, found in zip(pdf["keyword"], scorer(pdf["masked"].tolist())):
                    at = next((i for i, (w, _) in enumerate(found) if w == word), -1)
                    ranks.append(at + 1 if at >= 0 else -1)
                    scores.append(float(found[at][1]) if at >= 0 else None)
                yield pd.DataFrame({id_col: pdf[id_col], "model": name, "keyword": pdf["keyword"],
                                    "rank": ranks, "score": pd.array(scores, "Float64")})
    return by_length(masked, "masked").mapInPandas(
        run, f"{id_col} {kind}, model string, keyword string, rank int, score double")


def overlap_scorer(a: Sequence[str], b: Sequence[str]) -> list[float]:
    """Share of the first sentence's distinct characters that the second one has; a deterministic
    scorer without a model, which tells the order of the two."""
    return [len(set(x) & set(y)) / max(1, len(set(x))) for x, y in zip(a, b)]


def length_scorer(words: Sequence[str]) -> MaskScorer:
    """Ranks ``words`` by how near their length is to that of the word before the mask, then by
    name: a deterministic scorer without a model."""
    def run(texts):
        out = []
        for t in texts:
            before = t.split("[MASK]")[0].split()
            n = len(before[-1]) if before else 0
            ranked = sorted(words, key=lambda w: (abs(len(w) - n), w))
            out.append([(w, 1.0 / (i + 2)) for i, w in enumerate(ranked)])
        return out
    return run
