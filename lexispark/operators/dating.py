"""Sentence dating.

Curves are per-item running sums ordered by background year: a window partitioned by the
item (rows per item = the bounded background pool).  Knees come from a polynomial fit, as
the evaluation has it, or from the curve's chord, which is pure SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.keys import rkey
from lexispark.functions.text import year_bin
from lexispark.operators.sampling import _list


def unpivot_pairs(pairs: DataFrame, span: int, s1="s1", s2="s2", y1="y1", y2="y2",
                  id_col: str = "pair_id") -> DataFrame:
    """(pair, side, text, year, bin): first sentences then second, one pass (stack)."""
    st = F.expr(f"stack(2, 1, {s1}, {y1}, 2, {s2}, {y2}) as (side, text, year)")
    return pairs.select(id_col, st).withColumn("bin", year_bin("year", span))


def ordinal_ids(df: DataFrame, bin_col: str = "bin") -> DataFrame:
    """Bin -> class id by ascending bin (distinct bins form a small dimension)."""
    bins = df.select(bin_col).distinct()
    return bins.select(bin_col, (F.row_number().over(Window.orderBy(bin_col)) - 1).alias("class_id"))


def dating_scores(preds: DataFrame, mapping: DataFrame, span: int, pred: str = "pred_class",
                  true_class: str = "class_id", year: str = "year") -> DataFrame:
    """Accuracy of the predicted class and MAE of the predicted bin's midpoint."""
    m = F.broadcast(mapping.select(F.col("class_id").alias(pred), F.col("bin").alias("_pbin")))
    j = preds.join(m, pred, "left")
    return j.agg(F.avg((F.col(pred) == F.col(true_class)).cast("double")).alias("accuracy"),
                 F.avg(F.abs(F.col("_pbin") + F.lit(span / 2.0) - F.col(year))).alias("mae"))


def ordinal_loss(df: DataFrame, cutpoints: Sequence[float], z: str = "z", k: str = "class_id",
                 eps: float = 1e-7) -> DataFrame:
    """Cumulative-link loss -log(sigmoid(c_k - z) - sigmoid(c_{k-1} - z)) per row, with
    cut-points forced non-decreasing and c_-1 = -inf, c_K = +inf."""
    cps, run = [], float("-inf")
    for c in cutpoints:
        run = max(run, float(c))
        cps.append(run)
    arr = F.array(*[F.lit(c) for c in cps])
    n = len(cps)
    sig = lambda x: 1.0 / (1.0 + F.exp(-x))
    kk = F.col(k).cast("int")
    upper = F.when(kk >= n, F.lit(1.0)).otherwise(sig(F.element_at(arr, kk + 1) - F.col(z)))
    lower = F.when(kk <= 0, F.lit(0.0)).otherwise(sig(F.element_at(arr, F.greatest(kk, F.lit(1))) - F.col(z)))
    p = F.greatest(upper - lower, F.lit(eps))
    return df.withColumn("loss", -F.log(p))


def cumulative_curve(scores: DataFrame, keys=("item_id",), threshold: float | None = None,
                     score: str = "score", bg_year: str = "bg_year", bg_id: str = "bg_id"):
    """Running sum of score (or of score > threshold) over the background sorted by year."""
    keys = _list(keys)
    v = F.col(score) if threshold is None else (F.col(score) > F.lit(threshold)).cast("double")
    w = Window.partitionBy(*keys).orderBy(bg_year, bg_id).rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumn("curve", F.sum(v).over(w))


def knees(curve: DataFrame, keys, curves: dict[str, str], x: str = "bg_year",
          order=("bg_year", "bg_id")) -> DataFrame:
    """Kneedle (chord form) of several curves over the same x in one pass: keys.. and, for each
    (out, y), x and y min-max normalised per key and out = x at the first maximum of y_n - x_n.  A flat
    curve (or a single x) has no knee: NULL."""
    keys = _list(keys)
    w = Window.partitionBy(*keys)
    ends = [F.min(x).over(w).alias("_x0"), F.max(x).over(w).alias("_x1")]
    for out, y in curves.items():
        ends += [F.min(y).over(w).alias(f"_y0_{out}"), F.max(y).over(w).alias(f"_y1_{out}")]
    c = curve.select("*", *ends)
    xn = (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    found = []
    for out, y in curves.items():
        y0, y1 = F.col(f"_y0_{out}"), F.col(f"_y1_{out}")
        c = c.withColumn(f"_d_{out}", F.when((F.col("_x1") > F.col("_x0")) & (y1 > y0),
                                            (F.col(y) - y0) / (y1 - y0) - xn))
        first = F.struct(F.col(f"_d_{out}"), *[F.negative(F.col(o)) for o in order])
        found.append(F.max_by(F.col(x), F.when(F.col(f"_d_{out}").isNotNull(), first)).alias(out))
    return c.groupBy(*keys).agg(*found)


def knee(curve: DataFrame, keys=("item_id",), x: str = "bg_year", y: str = "curve",
         order=("bg_year", "bg_id")) -> DataFrame:
    """``knees`` of one curve, as column knee."""
    return knees(curve, keys, {"knee": y}, x, order)


def polynomial_basis(x: np.ndarray, weight: np.ndarray, degree: int = 7) -> np.ndarray:
    """B, a column a dimension: B @ (B.T @ sums) are the least squares values, at the distinct years x, of
    a polynomial through points of which ``weight`` lie at each x and have these sums of y.

    The evaluation fits powers of the year by singular values and drops those below
    (number of points) * eps of the largest.  Where none is dropped the fit is that of all polynomials
    up to the degree, and their basis is made from Legendre polynomials on the scaled years, in which
    the problem is well conditioned (the powers of years around 1700 lose about 10 digits, so a solver
    that works on them gives knees that depend on the machine where two maxima are about equal).  Where some are
    dropped, the columns are the singular vectors that are left."""
    degree = min(degree, len(x) - 1)
    root = np.sqrt(weight)
    powers = np.vander(x, degree + 1)
    powers = powers / np.sqrt((weight[:, None] * powers * powers).sum(0)) * root[:, None]
    u, s, _ = np.linalg.svd(powers, full_matrices=False)
    left = s > weight.sum() * np.finfo(float).eps * s[0]
    if left.all():
        t = (2 * x - x[0] - x[-1]) / (x[-1] - x[0]) if len(x) > 1 else np.zeros(1)
        u, _ = np.linalg.qr(np.polynomial.legendre.legvander(t, degree) * root[:, None])
    else:
        u = u[:, left]
    return u / root[:, None]


def find_knee(x: np.ndarray, curves: np.ndarray, sensitivity: float = 1.0, degree: int = 7,
              grids: dict | None = None) -> np.ndarray:
    """Knees of concave rising curves (rows) over the ascending x by Kneedle with a polynomial fit;
    nan where there is none.  The fit is one projection for all curves over the same years;
    ``grids`` keeps the projections from call to call.

    The fitted curve and x are scaled to 0..1.  A local maximum of their difference is the knee if
    the difference falls below (maximum - sensitivity * mean step of x) before it rises to another
    maximum; a local minimum sets that bound to 0."""
    return _fitted_knees(x, np.ascontiguousarray(curves.T), {} if grids is None else grids, sensitivity, degree)


def _fitted_knees(x: np.ndarray, curves: np.ndarray, grids: dict, sensitivity: float = 1.0,
                  degree: int = 7) -> np.ndarray:
    """``find_knee`` of the columns of ``curves`` (a row a point).

    Equal years have equal fitted values.  Of the points between the first and the last of a year each is a
    maximum and a minimum as much as the next, so one of them stands for all."""
    out = np.full(curves.shape[1], np.nan)
    if len(x) < 2 or x[0] == x[-1]:
        return out
    key = (x.tobytes(), degree)
    if key not in grids:
        if len(grids) > 1000:
            grids.clear()
        years, first_of, n = np.unique(x, return_index=True, return_counts=True)
        grids[key] = (years, polynomial_basis(years, n.astype(np.float64), degree), first_of,
                      np.repeat(np.arange(len(years)), np.minimum(n, 3)),
                      abs(np.diff((x - x[0]) / (x[-1] - x[0])).mean()))
    years, basis, first_of, at, step = grids[key]
    value = basis @ (basis.T @ np.add.reduceat(curves, first_of, axis=0))       # year by curve
    low, span = value.min(0), np.ptp(value, axis=0)
    ok = span > 1e-12 * np.maximum(1.0, np.abs(value).max(0))
    xn = (years - years[0]) / (years[-1] - years[0])
    d = ((value - low) / np.where(ok, span, 1.0) - xn[:, None])[at]
    rises, falls = d[1:] >= d[:-1], d[1:] <= d[:-1]
    peak, dip = np.ones((2, *d.shape), bool)
    peak[1:], dip[1:] = rises, falls
    peak[:-1] &= falls
    dip[:-1] &= rises
    place = np.arange(len(d), dtype=np.int32)[:, None]
    last_peak = np.maximum.accumulate(np.where(peak, place, np.int32(-1)), axis=0)
    last_dip = np.maximum.accumulate(np.where(dip, place, np.int32(-1)), axis=0)
    bound = np.where(last_dip >= last_peak, 0.0, np.take_along_axis(d, np.maximum(last_peak, 0), 0) - sensitivity * step)
    fell = (last_peak >= 0)[:-1] & (d[1:] < bound[:-1]) & ok
    first = fell.argmax(0)
    found = fell.any(0)
    out[found] = years[at[last_peak[first[found], np.flatnonzero(found)]]]
    return out


def knee_polynomial(curve: DataFrame, keys=("item_id",), x: str = "bg_year", y: str = "curve",
                    order=("bg_year", "bg_id")) -> DataFrame:
    """``find_knee`` of each key's curve.  A key has as many rows as the bounded background pool,
    so its curve is one array; batches of curves over the same years are fitted together."""
    keys = _list(keys)
    kind = dict(curve.dtypes)[x]
    rows = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y")))).alias("_c"))
    rows = rows.select(*keys, F.transform("_c", lambda c: c["x"]).alias("_x"),
                       F.transform("_c", lambda c: c["y"]).alias("_y"))

    @F.pandas_udf("double")
    def located(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out, grids = np.full(len(xs), np.nan), {}
        same: dict[bytes, list[int]] = {}
        for i, v in enumerate(xs):
            same.setdefault(np.asarray(v, np.float64).tobytes(), []).append(i)
        for raw, at in same.items():
            out[at] = find_knee(np.frombuffer(raw), np.stack([np.asarray(ys.iloc[i], np.float64) for i in at]),
                                grids=grids)
        return pd.Series(out)
    found = rows.withColumn("_k", located("_x", "_y"))
    return found.select(*keys, F.when(~F.isnan("_k"), F.col("_k")).cast(kind).alias("knee"))


def date_items(scores: DataFrame, threshold: float | None = None, keys=("item_id",),
               method: str = "chord") -> DataFrame:
    """Knee year per item, from the raw cumulative score or the thresholded count.  'chord' takes the
    first maximum of the curve above its chord, 'polynomial' the knee of a polynomial fit."""
    return KNEES[method](cumulative_curve(scores, keys, threshold), keys)


KNEES = {"chord": knee, "polynomial": knee_polynomial}


def date_sentences(scores: DataFrame, n: int = 50, models=("model",)) -> DataFrame:
    """D8, the whole dating run: (model.., item_id, item_year, kind, knee), kind 'raw' (knee of the summed
    scores) and 'threshold' (of the count of scores above the cut-off that tells best, over all items
    and background rows of a model, whether the item is the later one).

    The scores are read twice: for the histogram of the threshold, and for both curves of an item in one
    window pass.  A costly score should be settled before."""
    from lexispark.operators.senses import best_threshold
    models = _list(models)
    truth = scores.withColumn("_y", (F.col("item_year") > F.col("bg_year")).cast("int"))
    cuts = best_threshold(truth, "score", "_y", n=n, strict=True, by=models)
    rows = threshold_hits(scores, cuts, models) if models else scores.crossJoin(
        F.broadcast(cuts.select(F.col("threshold").alias("_th")))).withColumn(      # one row
        "hit", (F.col("score") > F.col("_th")).cast("double")).drop("_th")
    keys = [*models, "item_id", "item_year"]
    w = Window.partitionBy(*keys).orderBy("bg_year", "bg_id").rowsBetween(Window.unboundedPreceding, 0)
    curves = rows.select(*keys, "bg_year", "bg_id", F.sum("score").over(w).alias("_raw"),
                         F.sum("hit").over(w).alias("_count"))
    found = knees(curves, keys, {"raw": "_raw", "threshold": "_count"})
    return found.unpivot(keys, ["raw", "threshold"], "kind", "knee")


def mae(knees: DataFrame, truth: DataFrame, models=("model",), item: str = "item_id",
        year: str = "item_year", knee_col: str = "knee", by=()) -> DataFrame:
    """Per model MAE over items that have a knee in every model, plus counts."""
    models, by = _list(models), _list(by)
    ok = knees.groupBy(*by, item).agg(F.bool_and(F.col(knee_col).isNotNull()).alias("_ok"))
    j = knees.join(ok, by + [item]).join(truth.select(item, year), item)
    return j.groupBy(*by, *models).agg(
        F.avg(F.when(F.col("_ok"), F.abs(F.col(knee_col) - F.col(year)))).alias("mae"),
        F.sum(F.col("_ok").cast("int")).alias("n_items"),
        F.sum(F.col(knee_col).isNull().cast("int")).alias("n_missing"))


def threshold_hits(scores: DataFrame, thresholds: DataFrame, models=("model",),
                   score: str = "score") -> DataFrame:
    """``scores`` with hit = 1.0 where the score is above its model's cut-off (models, threshold).
    There is one cut-off a model, so what is broadcast is a few rows."""
    models = _list(models)
    return (scores.join(F.broadcast(thresholds.select(*models, F.col("threshold").alias("_th"))), models)
            .withColumn("hit", (F.col(score) > F.col("_th")).cast("double")).drop("_th"))


def chord_knees(x: np.ndarray, scores: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """(items, draws) knees of the chord form for scores (items, pool) over the ascending x, where each
    draw (draws, pool) leaves out some of the pool; nan where there is none.

    A draw's rows of the pool are summed for all items at once."""
    out = np.full((len(scores), len(drawn)), np.nan)
    by_pool = np.ascontiguousarray(scores.T)
    for j, use in enumerate(drawn):
        at = np.flatnonzero(use)
        if not len(at) or not x[at[-1]] > x[at[0]]:
            continue
        xn = (x[at] - x[at[0]]) / (x[at[-1]] - x[at[0]])
        run = np.cumsum(by_pool[at], axis=0)
        low = run.min(0)
        span = run.max(0) - low
        ok = (span > 0) & np.isfinite(span)
        run -= low
        run /= np.where(span > 0, span, 1.0)
        run -= xn[:, None]
        out[:, j] = np.where(ok, x[at[np.ascontiguousarray(run.T).argmax(1)]], np.nan)
    return out


def polynomial_knees(x: np.ndarray, scores: np.ndarray, drawn: np.ndarray, grids: dict) -> np.ndarray:
    """The same with the knee of a polynomial fit: one projection a draw for all items."""
    out = np.full((len(scores), len(drawn)), np.nan)
    by_pool = np.ascontiguousarray(scores.T)
    for j, use in enumerate(drawn):
        if use.any():
            out[:, j] = _fitted_knees(x[use], np.cumsum(by_pool[use], axis=0), grids)
    return out


TILE = 32              # items that are dated at once, in all models


def _draw_errors(method: str, sizes: Sequence[int]):
    """Errors of every draw, summed over tiles of items; an item comes with its scores in all models, the first one
    of a task with the draw table."""
    def run(batches):
        grids, drawing = {}, None
        for batch in batches:
            if drawing is None and batch.num_rows:
                drawing = drawn_rows(*[batch.column(c)[0].as_py() for c in ("_pool", "_pool_year", "_ranks")])
            for k in range(0, batch.num_rows, TILE):
                yield from tile(batch.slice(k, TILE), *drawing, grids)

    def drawn_rows(ids, years, ranks):
        ids, years = np.array(ids, np.int64), np.array(years, np.float64)
        rank = np.frombuffer(ranks, ">i4").reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))   # pool x iterations
        draws = np.array([(n, it) for it in range(rank.shape[1]) for n in sizes], np.int32)
        return ids, years, draws, np.array([rank[:, it] <= n for n, it in draws])

    def tile(r, ids, years, draws, drawn, grids):
        if not len(ids):
            return
        # a curve is an item in a model
        models, curves = r.column("_models").value_lengths().to_numpy(), r.column("_models").flatten()
        starts, owner = np.cumsum(models) - models, np.repeat(np.arange(len(models)), models)
        points, n_curves = curves.field("_points"), len(curves)
        lens, flat = points.value_lengths().to_numpy(), points.flatten()
        mine, value = flat.field("i").to_numpy(), flat.field("v").to_numpy()
        order = np.argsort(ids, kind="stable")
        at = order[np.minimum(np.searchsorted(ids[order], mine), len(ids) - 1)]
        known = ids[at] == mine
        row, at = np.repeat(np.arange(n_curves), lens)[known], at[known]
        score, here = np.zeros((n_curves, len(ids))), np.zeros((n_curves, len(ids)), bool)
        score[row, at], here[row, at] = value[known], True
        # curves that have a score for the same rows of the pool go together
        same: dict[bytes, list[int]] = {}
        for i in range(n_curves):
            same.setdefault(here[i].tobytes(), []).append(i)
        cut = curves.field("_th").to_numpy(zero_copy_only=False).astype(np.float64)
        truth = r.column("item_year").to_numpy(zero_copy_only=False).astype(np.float64)[owner, None]
        names: dict[str, list[int]] = {}
        for i, name in enumerate(curves.field("model").to_pylist()):
            names.setdefault(name, []).append(i)
        for kind, value, asked in (("raw", score, np.ones(n_curves, bool)),
                                   ("threshold", (score > cut[:, None]) * 1.0, ~np.isnan(cut))):
            knee, has = np.full((n_curves, len(draws)), np.nan), np.zeros((n_curves, len(draws)), bool)
            for group in same.values():
                group = [i for i in group if asked[i]]
                if group:
                    use = drawn & here[group[0]]
                    knee[group] = (chord_knees(years, value[group], use) if method == "chord"
                                   else polynomial_knees(years, value[group], use, grids))
                    has[group] = use.any(1)
            missing = has & np.isnan(knee)
            ok = ~np.logical_or.reduceat(missing, starts, axis=0)[owner] & has
            error = np.where(ok, abs(knee - truth), np.nan)
            for name, of in names.items():
                some = np.flatnonzero(has[of].any(0))
                told = error[of][:, some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(draws[some, 0]), pa.array(draws[some, 1]), pa.array([kind] * len(some), pa.string()),
                     pa.array([name] * len(some), pa.string()), pa.array(np.nansum(told, axis=0)),
                     *[pa.array(c.sum(0)) for c in (~np.isnan(told), ok[of][:, some], missing[of][:, some])]],
                    names=["n", "iteration", "kind", "model", "error", "n_errors", "n_items", "n_missing"])
    return run


def draw_table(bg: DataFrame, sizes: Sequence[int], iterations: int, span: int, seed, bg_id: str,
               bg_year: str) -> DataFrame:
    """One row: the pool by year, and the rank of each of its rows within its span in every iteration (a
    draw of n is the ranks up to n).  It has pool x iterations numbers, and the pool a fixed number
    of rows a time bin."""
    its = bg.sparkSession.range(iterations).select(F.col("id").cast("int").alias("iteration"))
    b = bg.select(F.col(bg_id).alias("_i"), F.col(bg_year).alias("_y"), year_bin(bg_year, span).alias("_bin")) \
        .crossJoin(F.broadcast(its))
    w = Window.partitionBy("iteration", "_bin").orderBy(rkey(seed, "iteration", "_i"), "_i")
    rank = b.withColumn("_r", F.row_number().over(w)).groupBy("_y", "_i").agg(F.array_sort(F.collect_list(
        F.struct("iteration", "_r"))).alias("_r"))
    ranks = F.transform("_r", lambda x: F.to_binary(F.lpad(F.hex(x["_r"]), 8, "0"), F.lit("hex")))
    table = rank.select("_y", "_i", F.concat(*[F.get(ranks, F.lit(k)) for k in range(iterations)]).alias("_r")) \
        .agg(F.array_sort(F.collect_list(F.struct("_y", "_i", "_r"))).alias("_t"))
    return table.select(
        F.transform("_t", lambda t: t["_i"].cast("bigint")).alias("_pool"),
        F.transform("_t", lambda t: t["_y"].cast("double")).alias("_pool_year"),
        F.aggregate("_t", F.lit(b""), lambda a, t: F.concat(a, t["_r"])).alias("_ranks"))


def background_curve(scores: DataFrame, bg: DataFrame, sizes: Sequence[int], iterations: int,
                     span: int = 50, bg_id: str = "bg_id", bg_year: str = "bg_year",
                     seed="bgcurve", thresholds: DataFrame | None = None,
                     method: str = "polynomial") -> DataFrame:
    """Learning curve of the dating error against background size: for each (n, iteration),
    n background rows per span (nested draws, one ranking per iteration) -> knees -> MAE of every
    model over the items that have a knee in all models.

    ``scores`` has a model column.  With ``thresholds`` (model, threshold) the knees of the
    thresholded counts follow with kind 'threshold'; kind 'raw' are those of the scores.

    The score table is shuffled once: an item's scores are one array a model, as long as the bounded pool.
    Items meet the one-row draw table (``draw_table``, broadcast), and a draw's curves are summed for a tile of items
    at once.  A tile holds its items in all models, so what leaves it are sums of errors a draw.
    """
    from lexispark.operators.pairs import spread
    cuts = scores.select("model").distinct().withColumn("_th", F.lit(None).cast("double")) \
        if thresholds is None else thresholds.select("model", F.col("threshold").cast("double").alias("_th"))
    item = ["item_id", "item_year"]
    arrays = spread(scores, "item_id").groupBy(*item, "model").agg(F.collect_list(F.struct(
        F.col(bg_id).cast("bigint").alias("i"), F.col("score").cast("double").alias("v"))).alias("_points"))
    # dealt by the item already: no second shuffle
    items = arrays.join(F.broadcast(cuts), "model", "left").groupBy(*item).agg(
        F.collect_list(F.struct("model", "_th", "_points")).alias("_models"))
    # the draw table goes to a task once, with its first row
    draws = draw_table(bg, sizes, iterations, span, seed, bg_id, bg_year)
    begins = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    told = items.select("item_year", "_models", begins.alias("_first")).crossJoin(F.broadcast(draws)).select(
        "item_year", "_models", *[F.when(F.col("_first"), F.col(c)).alias(c) for c in draws.columns])
    sums = told.mapInArrow(_draw_errors(method, list(sizes)), (
        "n int, iteration int, kind string, model string, error double, n_errors long, n_items long, n_missing long"))
    return sums.groupBy("n", "iteration", "kind", "model").agg(
        F.try_divide(F.sum("error"), F.sum("n_errors")).alias("mae"), F.sum("n_items").alias("n_items"),
        F.sum("n_missing").alias("n_missing"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "model",
         value: str = "mae") -> DataFrame:
    return df.unpivot(list(ids), list(values), var, value)


def summarize_attributions(tokens: DataFrame, pair: str = "pair", attr: str = "attr",
                           token_no: str = "token_no") -> DataFrame:
    """Per token: sum over dims / Frobenius norm of the sentence's attribution matrix;
    the sentence total is the sum of the token values."""
    t = tokens.withColumn("_s", F.aggregate(F.col(attr).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)) \
        .withColumn("_q", F.aggregate(F.col(attr).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    norms = t.groupBy(pair).agg(F.sqrt(F.sum("_q")).alias("_norm"))
    j = t.join(norms, pair).withColumn("token_attr", F.col("_s") / F.col("_norm"))
    tot = j.groupBy(pair).agg(F.sum("token_attr").alias("total"))
    return j.select(pair, token_no, "token_attr").join(tot, pair)


def attention_pool(tokens: DataFrame, keys=("sent",), vec: str = "vec", logit: str = "logit",
                   mask: str = "mask") -> DataFrame:
    """Softmax over unmasked tokens of the given logits (max-shifted), then the weighted
    sum of their vectors, per sentence (rows per sentence = its tokens).  Logits are one number a
    token, or an array of one for each feature of the vector."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    keys = _list(keys)
    t = tokens.where(F.col(mask))
    if dict(tokens.dtypes)[logit].startswith("array"):
        numbers = lambda c: F.col(c).cast("array<double>")
        top = t.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
            vector_to_array(Summarizer.max(array_to_vector(numbers(logit)))).alias("_m"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        e = t.join(top, same).withColumn("_e", F.zip_with(numbers(logit), "_m", lambda x, m: F.exp(x - m)))
        agg = e.groupBy(*keys).agg(
            vector_to_array(Summarizer.sum(array_to_vector(F.zip_with("_e", numbers(vec), lambda x, v: x * v))))
            .alias("_p"), vector_to_array(Summarizer.sum(array_to_vector("_e"))).alias("_n"))
        return agg.select(*keys, F.zip_with("_p", "_n", lambda p, n: p / n).alias("pooled"))
    w = Window.partitionBy(*keys)
    t = t.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    t = t.withColumn("_w", F.col("_e") / F.sum("_e").over(w))
    t = t.withColumn("_v", array_to_vector(F.transform(F.col(vec).cast("array<double>"),
                                                       lambda x: x * F.col("_w"))))
    agg = t.groupBy(*keys).agg(Summarizer.sum(F.col("_v")).alias("_p"))
    return agg.select(*keys, vector_to_array("_p").alias("pooled"))


__all__ = ["unpivot_pairs", "ordinal_ids", "dating_scores", "ordinal_loss", "cumulative_curve",
           "knee", "knees", "date_items", "date_sentences", "mae", "background_curve", "melt", "summarize_attributions",
           "attention_pool", "threshold_hits"]
