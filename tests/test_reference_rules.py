"""Rules of the evaluation, each stated apart from the code that implements it."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.operators import dating as D
from lexispark.operators import knn as K
from lexispark.operators import pairs as J
from lexispark.operators import sampling as S
from lexispark.operators import senses as C
from lexispark.operators import tagging as T
from tests.conftest import SF001, SF01


def test_short_group_is_an_error_when_asked_for(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id long, g string")
    assert S.sample_per_group(df, "g", 2, short="error").count() == 2
    with pytest.raises(Exception, match="group smaller"):
        S.sample_per_group(df, "g", 5, short="error").collect()


def test_sense_weight_counts_inside_a_lemma(spark):
    df = spark.createDataFrame([(1, "a", "1"), (2, "b", "1"), (3, "b", "1"), (4, "b", "2")],
                               "id long, lemma string, sense string")
    got = {r.id: r.weight for r in S.sense_weight(df, ["lemma", "sense"]).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.5, 4: 1.0}


@pytest.mark.parametrize("size", [10, 44, 45, 100])
def test_dated_pairs_are_distinct_and_complete(spark, size):
    df = spark.createDataFrame([(i, f"l{i % 10}") for i in range(73)], "id long, lemma string")
    got = J.dated_pairs(df, size).collect()
    pairs = {tuple(sorted((r.lemma_1, r.lemma_2))) for r in got}
    assert len(got) == len(pairs) == min(size, 45) and all(a != b for a, b in pairs)
    assert all(r.lemma_1 == f"l{r.q1 % 10}" and r.lemma_2 == f"l{r.q2 % 10}" for r in got)


def test_backward_swaps_the_sentences(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    bg = spark.createDataFrame([(8,), (9,)], "bg_id long")
    f, b = (J.cross_with_background(items, bg, d) for d in ("forward", "backward"))
    assert f.columns == b.columns
    assert {(r.s2_id, r.s1_id) for r in b.collect()} == {(r.s1_id, r.s2_id) for r in f.collect()}


def test_halves_of_all_spans_meet(spark):
    df = spark.createDataFrame([(i, 1500 + 50 * (i % 3)) for i in range(30)], "id long, year int")
    got = J.span_product(df, "year", 50, 7).collect()
    left, right = {r.a_id for r in got}, {r.b_id for r in got}
    assert len(left) == 9 and len(right) == 12 and not left & right and len(got) == 9 * 12
    assert {(r.a_span, r.b_span) for r in got} == set(itertools.product((1500, 1550, 1600), repeat=2))


def test_one_pass_over_tiles_scores_both_directions(spark):
    from lexispark.operators import scorers as P
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, 1500 + i, rng.normal(size=4).tolist()) for i in range(70)],
                                  "item_id long, item_year int, vec array<double>").coalesce(1)
    bg = spark.createDataFrame([(900 + i, rng.normal(size=4).tolist()) for i in range(9)],
                               "bg_id long, bvec array<double>")
    seen = P.order_scorer("vec", "bvec")
    out = P.score_background(items, bg, seen, ["item_year", "vec"], ["bvec"], tile=16)
    assert out.columns == ["item_id", "item_year", "bg_id", "direction", "score"]
    assert out.rdd.getNumPartitions() > 1                      # one file, many tasks
    got = {(r.item_id, r.bg_id, r.direction): r.score for r in out.collect()}
    assert len(got) == 70 * 9 * 2
    v = {r.item_id: np.array(r.vec) for r in items.collect()} | {r.bg_id: np.array(r.bvec) for r in bg.collect()}
    for (i, b, way), s in got.items():
        x, y = (v[i], v[b]) if way == "forward" else (v[b], v[i])
        assert s == pytest.approx(1 / (1 + np.exp(-8 * (x[:2] @ y[2:] - x[2:] @ y[:2]))))
    assert P.score_background(items, bg.limit(0), seen, ["vec"], ["bvec"]).count() == 0
    assert P.score_background(items.limit(0), bg, seen, ["vec"], ["bvec"]).count() == 0


def test_running_centroids_by_hand(spark):
    """Means of the first rows of each sense in seeded order, for every size; a row without a vector holds
    its place in that order."""
    import hashlib
    rng = np.random.default_rng(2)
    rows = [(i, f"l{i % 3}", f"s{i % 5 % 3}", rng.normal(size=3).tolist() if i % 11 else None) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, lemma string, sense string, embedding array<double>").repartition(4)
    sizes = [1, 2, 5, 10, None]
    got = {(r.lemma, r.sense, r.n_items): (r.centroid, r.n_train)
           for r in C.running_centroids(df, ["lemma"], sizes).collect()}
    by = collections.defaultdict(list)
    for i, lemma, sense, v in rows:
        by[lemma, sense].append((hashlib.md5(f"ladder:{i}".encode()).hexdigest(), i, v))
    for key, mine in by.items():
        for n in sizes:
            v = [x for *_, x in sorted(mine)[:n] if x is not None]
            name = (*key, "all" if n is None else str(n))
            if v:
                centroid, k = got.pop(name)
                assert k == len(v) and np.allclose(centroid, np.mean(v, axis=0))
    assert not got


def test_all_sizes_cost_one_scan(spark, tmp_path):
    from lexispark.operators import fewshot as W
    df = spark.createDataFrame([(i, f"l{i % 2}", f"s{i % 4}", [float(i % 4), 1.0]) for i in range(80)],
                               "quote_id long, lemma string, sense string, embedding array<double>")
    df.write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    plans = []
    for sizes in ([3], [1, 2, 5, 10, 20, None]):
        out = W.evaluate_zero_ladder(df, sizes)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        one = {n: {(r.quote_id, r.true, r.pred) for r in W.evaluate_zero(df, max_support=n).collect()} for n in sizes}
        for n in sizes:
            name = "all" if n is None else str(n)
            assert {(r.quote_id, r.true, r.pred) for r in out.where(F.col("max_support") == name).collect()} == one[n]
    assert plans[0] == plans[1]


def test_score_table_is_written_by_model(spark, tmp_path):
    from lexispark.sources import io as IO
    path = str(tmp_path / "scores")
    schema = "item_id long, bg_id long, item_year int, bg_year int, score double, model string, direction string"
    rows = [(i, b, 1500, 1600, i + b / 10, m, d) for i in range(3) for b in range(2) for m in ("a", "b") for d in ("f", "w")]
    none = spark.createDataFrame([], schema)
    IO.write_scores(none, path)
    assert IO.read_scores(spark, path).count() == 0 and IO.read_scores(spark, path, "a").schema == IO.SCORE_SCHEMA
    df = spark.createDataFrame(rows, schema)
    IO.write_scores(df, path)
    assert sorted(map(tuple, IO.read_scores(spark, path).collect())) == sorted(rows)
    # one model again: its partitions are replaced, the others stay
    IO.write_scores(df.where("model = 'a' and direction = 'f' and item_id = 1").withColumn("score", F.lit(9.0)), path)
    got = IO.read_scores(spark, path)
    assert [tuple(r)[:2] for r in got.where("model = 'a' and direction = 'f'").orderBy("bg_id").collect()] == [(1, 0), (1, 1)]
    assert got.count() == len(rows) - 6 + 2
    IO.write_scores(none, path)                                # nothing is no model: all stay
    assert IO.read_scores(spark, path).count() == len(rows) - 4
    plan = IO.read_scores(spark, path, "b", "w")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*model[^\]]*direction", plan)


def test_violations_are_told(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "a", "t"), (3, "b", "s")], "id long, lemma string, sense string")
    got = C.query_not_covered(df.where("id = 1"), df, ["lemma"]).select("id").collect()
    assert sorted(r.id for r in got) == [2, 3]


def test_keywords_in_any_script(spark):
    cases = [("naïve na x", "na", 6), ("þe e", "e", 3), ("line\nend word", "word", 9), ("a\\E.b c", "c", 6),
             ("x \\E y", "\\E", 2), ("a  b c", "b  c", None), ("été  là", "été là", 0), ("cafés café", "café", 6),
             ("c++ c", "c", 0), ("under_score score", "score", 12)]
    df = spark.createDataFrame([(q, k) for q, k, _ in cases], "q string, k string")
    got = [r[0] for r in df.select(X.keyword_span("q", "k")).collect()]
    for (q, k, start), r in zip(cases, got):
        words = [re.escape(w) for w in k.split()]
        m = re.search(r"(?<!\w)" + r"\s+".join(words) + r"(?!\w)", q)
        assert (r and (r.start, r.end)) == (m and m.span()), (q, k)
        assert start is None or r.start == start


def test_expected_hits_stay_inside_the_pool(spark):
    df = spark.createDataFrame([(i, f"w{i % 2}", f"l{i % 3}") for i in range(12)],
                               "id long, w string, l string")
    got = K.random_baseline_expected(df, "l", 50, within="w").collect()
    assert {(r.nNeighbors, r.exp_retrieved) for r in got} == {(2, 2.0)}


@pytest.mark.parametrize("within", [None, "w"])
def test_sampled_baseline_has_the_expected_mean(spark, within):
    df = spark.range(4000).select("id", F.concat(F.lit("w"), F.col("id") % 4).alias("w"),
                                  F.concat(F.lit("l"), F.col("id") % 10).alias("l"))
    want = {r.id: r.exp_retrieved for r in K.random_baseline_expected(df, "l", 20, within).collect()}
    got = K.random_baseline(df, "l", 20, within).toPandas()
    assert len(got) == 4000 and got.ap.between(0, 1).all()
    mean = np.mean([want[i] for i in got.id])
    assert abs(got.retrieved.mean() - mean) < 4 * got.retrieved.std() / 4000 ** 0.5
    again = K.random_baseline(df.repartition(5), "l", 20, within).toPandas()
    assert got.sort_values("id").retrieved.tolist() == again.sort_values("id").retrieved.tolist()


def test_sampled_baseline_of_a_pool_of_billions():
    import pandas as pd
    run = K._baseline_sampler(10, 3)
    pdf = pd.DataFrame({"id": range(2000), "_N": [5 * 10 ** 9] * 2000, "_tn": [10 ** 9] * 2000})
    got = pd.concat(run([pdf]))
    assert abs(got.retrieved.mean() - 2.0) < 4 * (10 * 0.2 * 0.8 / 2000) ** 0.5


def test_tokens_with_unseen_tags_are_skipped(spark):
    test = spark.createDataFrame([(1, ["a", "b", "c", "a"], ["N", "V", "Z", "N"], ["N", "N", "Z", "V"])],
                                 "id long, tokens array<string>, tags array<string>, preds array<string>")
    vocab = spark.createDataFrame([("a",)], "token string")
    labels = spark.createDataFrame([("N", 0), ("V", 1)], "tag string, label_id int")
    counts = T.oov_counts(test, vocab, "id", labels)
    assert sorted((r.tag, r.known, r.total, r.correct) for r in counts.collect()) == [
        ("N", True, 2, 1), ("V", False, 1, 0)]
    m = T.oov_maps(counts, "id").first()
    assert (m.known_total, m.unknown_total, m.known, m.unknown) == ({"N": 2}, {"V": 1}, {"N": 1}, {"V": 0})
    total = {(r.tag, r.known): (r.total, r.correct) for r in T.oov_report(test, vocab, labels).collect()}
    assert total[None, None] == (3, 1) and ("Z", None) not in total


def test_word_vector_by_mean_or_first_subtoken(spark):
    groups = spark.createDataFrame([(1, 0, "The", [1]), (1, 1, "actuallye", [2, 3, 4]), (1, 2, "actuallye", [5]),
                                    (2, 0, "x", [1])], "id long, word_no int, word string, idx array<int>")
    vecs = spark.createDataFrame([(1, p, [float(p), 1.0]) for p in range(1, 6)] + [(2, 1, [9.0, 9.0])],
                                 "id long, pos int, vec array<double>")
    kw = spark.createDataFrame([(1, "Actuallye"), (2, "absent")], "id long, keyword string")
    for mode, want in (("mean", ([3.0, 1.0], 3)), ("first", ([2.0, 1.0], 1))):
        got = T.pool_word_vector(groups, vecs, kw, "id", mode).collect()
        assert [(r.id, list(r.vector), r.n_subtokens) for r in got] == [(1, *want)]


def chunks_by_hand(tags):
    out, start, kind = [], None, None
    for i, t in enumerate([*tags, "O"]):
        now = t[2:] if t is not None and t[:2] in ("B-", "I-") else None
        if kind is not None and (now is None or t[:2] == "B-" or now != kind):
            out.append((start, i, kind))
            kind = None
        if now is not None and kind is None:
            start, kind = i, now
    return out


def test_chunks_of_random_tags(spark):
    rng = np.random.default_rng(4)
    pool = ["B-P", "I-P", "B-L", "I-L", "O", "x", "I-", None]
    rows = [(i, [pool[j] for j in rng.integers(0, 8, rng.integers(0, 12))]) for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "id long, tags array<string>")
    got = {r.id: [tuple(c) for c in r.c] for r in df.select("id", T.bio_chunks("tags").alias("c")).collect()}
    for i, tags in rows:
        assert got[i] == chunks_by_hand(tags or []), tags


def test_entity_counts_move_no_tokens(spark):
    df = spark.createDataFrame([(1, ["B-P"], ["B-P"])], "id long, tags array<string>, preds array<string>")
    plan = T.entity_metrics(df)[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange", plan.split("== Initial Plan ==")[0])) == 1 and "Window" not in plan


def test_entities_are_whole_chunks(spark):
    df = spark.createDataFrame([
        (1, ["B-P", "I-P", "O", "B-L", "I-P"], ["B-P", "I-P", "O", "B-L", "O"]),      # I-P after B-L is a chunk
        (2, ["I-L", "I-L", "O", "x"], ["B-L", "B-L", "B-P", "x"]),                    # one chunk, read as two
        (3, ["O"], ["O"])], "id long, tags array<string>, preds array<string>")
    per, overall = T.entity_metrics(df, "id")
    got = {r.tag: (r.precision, r.recall, r.support) for r in per.collect()}
    assert got == {"P": (0.5, 0.5, 2), "L": (pytest.approx(1 / 3), 0.5, 2)}
    r = overall.first()
    assert (r.precision, r.recall, r.support) == (0.4, 0.5, 4) and r.f1 == pytest.approx(4 / 9)
    nothing = T.entity_metrics(df.where("id = 3"), "id")
    assert nothing[0].count() == 0 and tuple(nothing[1].first()) == (0.0, 0.0, 0.0, 0)


def test_attention_weights_by_feature(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 3 or None, rng.normal(size=4).tolist(), (300 * rng.normal(size=4)).tolist(), i % 5 > 0)
            for i in range(40)]
    df = spark.createDataFrame(rows, "sent long, vec array<double>, logit array<double>, mask boolean")
    got = {r.sent: r.pooled for r in D.attention_pool(df).collect()}
    assert set(got) == {1, 2, None}
    for s in got:
        v, x = (np.array([r[k] for r in rows if r[0] == s and r[3]]) for k in (1, 2))
        e = np.exp(x - x.max(0))
        assert np.allclose(got[s], (e / e.sum(0) * v).sum(0))


def test_two_models_have_two_curves(spark):
    years = list(range(1450, 1950, 10))
    rows = [(1, 1600, j, y, "a", 0.9 if y < 1600 else 0.1) for j, y in enumerate(years)]
    rows += [(1, 1600, j, y, "b", 0.9 if y < 1700 else 0.1) for j, y in enumerate(years)]
    rows += [(2, 1500, j, y, m, 0.9 if y < 1500 else 0.1) for j, y in enumerate(years) for m in "a"]
    rows += [(2, 1500, j, y, "b", 0.0) for j, y in enumerate(years)]        # no knee in model b
    s = spark.createDataFrame(rows, "item_id long, item_year int, bg_id long, bg_year int, model string, "
                                    "score double")
    bg = s.select("bg_id", "bg_year").distinct()
    th = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "model string, threshold double")
    got = {(r.n, r.kind, r.model): r for r in D.background_curve(s, bg, [5], 1, thresholds=th).collect()}
    assert set(got) == {(5, k, m) for k in ("raw", "threshold") for m in "ab"}
    for k in ("raw", "threshold"):
        assert got[5, k, "a"].n_items == got[5, k, "b"].n_items == 1     # both models need a knee
        assert got[5, k, "a"].mae < 30 < 70 < got[5, k, "b"].mae < 130


def test_every_size_of_the_curve_draws_its_own_rows(spark, tmp_path):
    """Where a decade of the background part has 20 vectors, ten spans of 50 years hold 100 each."""
    from lexispark.plans.q_dating import _SIZES
    from lexispark.sources import fixtures as fx
    spark.range(8000).select(F.col("id").alias("vec_id")).write.parquet(str(tmp_path / "embeddings.parquet"))
    pool = fx.background_pool(spark, str(tmp_path)).withColumn("span", F.floor(F.col("bg_year") / 50)).cache()
    drawn = {n: S.sample_per_group(pool, "span", n, id_col="bg_id").count() for n in _SIZES}
    assert drawn == {n: 10 * n for n in _SIZES}
    items = fx.dating_items(spark, str(tmp_path))
    assert items.join(pool, items.item_id == pool.bg_id).count() == 0 and 5800 < items.count() < 6200


def test_items_are_left_at_every_size(spark):
    from lexispark.sources import fixtures as fx
    for sf in (SF001, SF01):
        assert fx.dating_items(spark, sf).count() > 100 and fx.background_pool(spark, sf).count() > 50


def test_scores_have_every_vector(spark, tmp_path):
    """Every vector is an item, and the pool is drawn from all vectors, 20 a decade."""
    from lexispark.plans import registry
    from lexispark.sources import fixtures as fx
    registry.load_all()
    spark.range(1500).select(F.col("id").alias("vec_id")).write.parquet(str(tmp_path / "embeddings.parquet"))
    sf = str(tmp_path)
    assert registry.QUERIES["background_pool"](spark, sf).count() == 50 * 20
    for name in ("cross_backward", "cross_with_background", "cumulative_curve"):
        rows = registry.QUERIES[name](spark, sf)
        assert rows.count() == 1500 * 1000 and rows.select("item_id").distinct().count() == 1500
    assert registry.QUERIES["knee_raw"](spark, sf).count() == fx.scored_items(spark, sf).count() == 1500


def test_dating_queries_and_their_sql_have_every_vector(spark, tmp_path):
    """Neither code nor SQL of a query over the scores sets vectors aside."""
    from lexispark.plans import registry
    registry.load_all()
    for name in ("cross_backward", "background_product", "dating_best_threshold", "background_pool",
                 "cumulative_curve", "knee_raw", "date_sentences", "dating_mae", "dating_mae_long",
                 "dating_model_thresholds", "background_curve"):
        assert "bgpart" not in registry.ORACLES[name], name
    spark.range(120).select(F.col("id").alias("vec_id")).write.parquet(str(tmp_path / "embeddings.parquet"))
    sf = str(tmp_path)
    dated = registry.QUERIES["date_sentences"](spark, sf)
    assert dated.select("item_id").distinct().count() == 120 and dated.count() == 240
    told = registry.QUERIES["dating_mae"](spark, sf).collect()
    assert {r.n_items + r.n_missing for r in told} == {120}
    # five a span of 50 years, of ten spans, with each other
    assert registry.QUERIES["background_product"](spark, sf).count() == 50 * 50


@pytest.mark.parametrize("method", ["chord", "polynomial"])
def test_learning_curve_by_hand(spark, method):
    """Every draw of every item dated on its own; an item lacks some of the scores."""
    rng = np.random.default_rng(8)
    pool = [(int(i), 1450 + 10 * (int(i) % 30)) for i in rng.permutation(1000)[:90]]
    rows = []
    for item in range(12):
        year = 1450 + 25 * item
        for model in "ab":
            for k, (i, y) in enumerate(pool):
                if not (item == 3 and k % 4 == 0) and not (item == 5 and model == "b"):
                    rows.append((item, year, i, y, model, float((0.8 if y < year else 0.2) + 0.2 * rng.random())))
    s = spark.createDataFrame(rows, "item_id long, item_year int, bg_id long, bg_year int, model string, score double")
    bg = spark.createDataFrame(pool, "bg_id long, bg_year int")
    th = spark.createDataFrame([("a", 0.5), ("b", 0.6)], "model string, threshold double")
    got = {(r.n, r.iteration, r.kind, r.model): r for r in D.background_curve(
        s.repartition(3), bg, [3, 7], 2, thresholds=th, method=method).collect()}
    import hashlib
    want = collections.defaultdict(dict)
    for it in range(2):
        spans = collections.defaultdict(list)
        for i, y in pool:
            spans[y // 50].append((hashlib.md5(f"bgcurve:{it}:{i}".encode()).hexdigest(), i))
        for n in (3, 7):
            drawn = {i for v in spans.values() for _, i in sorted(v)[:n]}
            for item, model in {(r[0], r[4]) for r in rows}:
                mine = sorted((r[3], r[2], r[5]) for r in rows if (r[0], r[4]) == (item, model) and r[2] in drawn)
                x = np.array([m[0] for m in mine], float)
                for kind in ("raw", "threshold"):
                    v = np.array([m[2] if kind == "raw" else float(m[2] > {"a": .5, "b": .6}[model]) for m in mine])
                    c = np.cumsum(v)
                    if method == "polynomial":
                        k = D.find_knee(x, c[None])[0]
                    else:
                        d = (c - c.min()) / np.ptp(c) - (x - x.min()) / np.ptp(x) if np.ptp(c) else None
                        k = np.nan if d is None else x[d.argmax()]
                    want[n, it, kind][item, model] = k
    for (n, it, kind), found in want.items():
        ok = {i for i, _ in found if all(not np.isnan(k) for (j, _), k in found.items() if j == i)}
        for model in "ab":
            r = got.pop((n, it, kind, model))
            mine = {i: k for (i, m), k in found.items() if m == model}
            assert r.n_items == len(ok & set(mine)) and r.n_missing == sum(np.isnan(k) for k in mine.values())
            assert r.mae == pytest.approx(np.mean([abs(mine[i] - 1450 - 25 * i) for i in ok & set(mine)]))
    assert not got


def knee_by_steps(x, y, degree=7):
    """Kneedle walked step by step."""
    v = np.polyval(np.polyfit(x, y, degree), x)
    if np.ptp(v) < 1e-9:
        return None
    xn = (x - x.min()) / np.ptp(x)
    d = (v - v.min()) / np.ptp(v) - xn
    n = len(d)
    peaks = [i for i in range(n) if d[i] >= d[max(i - 1, 0)] and d[i] >= d[min(i + 1, n - 1)]]
    dips = [i for i in range(n) if d[i] <= d[max(i - 1, 0)] and d[i] <= d[min(i + 1, n - 1)]]
    bound = knee = None
    for i in range(n - 1):
        if not peaks or i < peaks[0]:
            continue
        if i in peaks:
            bound, knee = d[i] - np.abs(np.diff(xn).mean()), x[i]
        if i in dips:
            bound = 0.0
        if d[i + 1] < bound:
            return knee
    return None


@pytest.mark.filterwarnings("ignore")
def test_polynomial_knee(spark):
    rng = np.random.default_rng(0)
    x = np.sort(np.repeat(np.arange(1450.0, 1950.0, 10), 2))
    curves = []
    for k in range(30):
        step = np.cumsum(np.where(x < 1500 + 13 * k, 0.9, 0.1) + 0.2 * rng.random(len(x)))
        curves.append(step)
    curves += [np.zeros(len(x)), np.cumsum(rng.random(len(x))), np.cumsum(x > 1800)]
    got = [None if np.isnan(g) else g for g in D.find_knee(x, np.array(curves))]
    want = [knee_by_steps(x, c) for c in curves]
    # the solver on powers of the year may decide two maxima of about equal height the other way
    assert sum(g == w for g, w in zip(got, want)) >= len(want) - 1
    near = [abs(g - (1500 + 13 * k)) for k, g in enumerate(got[:25]) if k > 3]
    assert np.median(near) < 70 and got[30] is None
    rows = [(k, j, int(x[j]), float(v)) for k, c in enumerate(curves[:6]) for j, v in enumerate(np.diff(c, prepend=0))]
    df = spark.createDataFrame(rows, "item_id long, bg_id long, bg_year int, score double").repartition(4)
    found = {r.item_id: r.knee for r in D.date_items(df, method="polynomial").collect()}
    assert found == {k: None if got[k] is None else int(got[k]) for k in range(6)}


@pytest.mark.filterwarnings("ignore")
def test_projection_drops_what_the_solver_on_powers_drops():
    """Eight years in a row: the eighth power adds nothing that the evaluation's fit would keep."""
    years, n = np.arange(1900.0, 1908), np.array([1.0, 2, 1, 3, 1, 1, 2, 1])
    x = np.repeat(years, n.astype(int))
    y = np.random.default_rng(1).integers(0, 9, len(x)).astype(float)
    basis = D.polynomial_basis(years, n)
    assert basis.shape[1] < 8
    got = basis @ (basis.T @ np.add.reduceat(y, np.flatnonzero(np.diff(x, prepend=0))))
    assert np.allclose(got, np.polyval(np.polyfit(x, y, 7), years), rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("years", [np.arange(1450.0, 1950, 10), np.array([1500.0, 1510, 1800])])
def test_projection_is_the_exact_least_squares_fit(years):
    """Against exact fractions: the normal equations of the polynomial solved without rounding."""
    from fractions import Fraction as Q
    rng = np.random.default_rng(2)
    n = rng.integers(1, 5, len(years))
    y = [rng.integers(0, 50, k) for k in n]
    basis = D.polynomial_basis(years, n.astype(float))
    got = basis @ (basis.T @ np.array([v.sum() for v in y], float))
    deg = min(7, len(years) - 1)
    t = [Q(int(v)) - 1700 for v in years]
    a = [[sum(int(k) * v ** (i + j) for k, v in zip(n, t)) for j in range(deg + 1)]
         + [sum(int(s.sum()) * v ** i for s, v in zip(y, t))] for i in range(deg + 1)]
    for i in range(deg + 1):
        a[i] = [v / a[i][i] for v in a[i]]
        for j in range(deg + 1):
            if j != i:
                a[j] = [u - a[j][i] * v for u, v in zip(a[j], a[i])]
    want = [float(sum(a[i][-1] * v ** i for i in range(deg + 1))) for v in t]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_one_pass_dates_like_two(spark):
    """Raw and thresholded knees of the whole run against each on its own."""
    rng = np.random.default_rng(3)
    rows = [(i, 1500 + 10 * i, j, 1450 + 5 * j, m, float(rng.random() * 0.5 + (0.5 if 1450 + 5 * j < 1500 + 10 * i else 0)))
            for i in range(20) for j in range(60) for m in "ab"]
    rows += [(99, 1500, j, 1450 + 5 * j, "a", 0.0) for j in range(60)]
    s = spark.createDataFrame(rows, "item_id long, item_year int, bg_id long, bg_year int, model string, score double")
    got = {(r.model, r.kind, r.item_id): r.knee for r in D.date_sentences(s).collect()}
    cuts = {r.model: r.threshold for r in C.best_threshold(s.withColumn("y", (F.col("item_year") > F.col(
        "bg_year")).cast("int")), "score", "y", n=50, strict=True, by=["model"]).collect()}
    for m in "ab":
        one = s.where(F.col("model") == m)
        for kind, t in (("raw", None), ("threshold", cuts[m])):
            for r in D.date_items(one, t).collect():
                assert got.pop((m, kind, r.item_id)) == r.knee
    assert not got


def test_cut_offs_run_from_0_to_1_for_each_model(spark):
    rows = [("a", 0.3, 0), ("a", 0.4, 1), ("b", 0.7, 0), ("b", 0.8, 1)]
    df = spark.createDataFrame(rows, "model string, score double, label int")
    got = {r.model: r for r in C.best_threshold(df, n=50, strict=True, by=["model"]).collect()}
    grid = np.linspace(0, 1, 50)
    for m, lo in (("a", 0.3), ("b", 0.7)):
        assert abs(got[m].threshold - grid[grid >= lo][0]) < 1e-9 and got[m].accuracy == 1.0


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("lo,hi,n", [(0.0, 1.0, 50), (0.0, 1.0, 25), (-0.3, 0.7, 7), (None, None, 11), (0.5, 0.5, 4)])
def test_a_score_on_a_cut_off_is_counted_right(spark, strict, lo, hi, n):
    """Scores on, just below and just above every cut-off, nulls, NaN, infinities and far outside."""
    a, b = (-1.25, 2.5) if lo is None else (lo, hi)
    cuts = np.linspace(a, b, n)
    s = [v for c in cuts for v in (c, np.nextafter(c, -9), np.nextafter(c, 9)) if a <= v <= b]
    s += [] if lo is None else [-1e300, 1e300, float("inf"), float("-inf"), float("nan")]
    rows = [(float(v), i % 2) for i, v in enumerate(s)] + [(None, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    hist = {r["_k"]: (r["_pos"], r["_cnt"]) for r in C.score_histogram(df, n=n, lo=lo, hi=hi, strict=strict).collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for v, y in rows:
        k = 0 if v is None else n if np.isnan(v) else sum(v > c if strict else v >= c for c in cuts)
        want[k][0] += y
        want[k][1] += 1
    assert hist == {k: tuple(v) for k, v in want.items()}


def test_a_score_is_computed_once_for_its_bucket(spark):
    """A costly score is not pasted into the search of its bucket."""
    score = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0 ** 32
    df = spark.range(1000).select(score.alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    plan = C.score_histogram(df, n=50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_episodes_draw_independent_supports(spark):
    df = spark.createDataFrame([(i, "a", f"s{i % 2}") for i in range(120)],
                               "id long, lemma string, sense string")
    ep = S.sample_episodes(df, 60, max_support=8, max_query=5).collect()
    by = collections.defaultdict(list)
    for r in ep:
        by[r.episode, r.role].append(r)
    for e in range(60):
        sup, qry = by[e, "support"], by[e, "query"]
        assert len(sup) == 8 and len(qry) == 5
        assert {r.sense for r in qry} <= {r.sense for r in sup}
        assert not {r.id for r in sup} & {r.id for r in qry}
    used = collections.Counter(r.id for r in ep if r.role == "support")
    # 480 uses of 120 rows: near a Poisson law with mean 4, not one run of neighbours
    assert len(used) > 100 and max(used.values()) < 14
    sets = {frozenset(r.id for r in by[e, "support"]) for e in range(60)}
    assert len(sets) > 55


def test_rank_of_a_hot_group_and_of_null_groups(spark):
    from lexispark.functions.keys import rkey
    df = spark.range(900).select("id", F.when(F.col("id") < 300, "hot").when(F.col("id") < 310, None)
                                 .otherwise(F.concat(F.lit("g"), F.col("id") % 60)).alias("g"))
    for n in (1, 7, 64):
        got = S.exact_rank(df.repartition(n), ["g"], rkey("x", "id"), "id", out="r", size="n").collect()
        assert len(got) == 900
        by = collections.defaultdict(list)
        for r in got:
            by[r.g].append(r)
        for rows in by.values():
            assert sorted(r.r for r in rows) == list(range(1, len(rows) + 1))
            assert {r.n for r in rows} == {len(rows)}


def test_stratified_split_moves_rows_in_few_exchanges(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"))
    out = S.stratified_split(df, ["g"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|Single)", plan)) <= 4


def test_targets_are_sent_once_a_block_in_knn(spark, monkeypatch):
    """Forty tiles are two blocks a core, and the tiles that are dealt do not grow with their square; groups of
    equal vectors end in their smallest ids."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (640, 6)).astype(float)
    x[100:400] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "id long, embedding array<double>").repartition(1)
    got, sims = K.knn(df, 9, tile_rows=16).toPandas(), x @ x.T
    for q in range(640):
        rows = got[got.qid == q].sort_values("rank")
        assert rows.nid.tolist() == sorted(range(640), key=lambda j: (-sims[q, j], j))[:9]

    def counted(k, carry, by=None):
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_pydict({"qid": [n], "rank": pa.array([1], pa.int32()), "nid": [n], "sim": [0.0]})
        return run
    monkeypatch.setattr(K, "_cells", counted)
    blocks = 2 * spark.sparkContext.defaultParallelism
    assert sum(r.nid for r in K.knn(df, 9, tile_rows=16).collect()) <= 40 * (blocks + 1)


def test_many_tiles_and_ties_in_knn(spark):
    rng = np.random.default_rng(0)
    m = rng.integers(-2, 3, (400, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), f"c{i}") for i, v in enumerate(m)],
                               "id long, embedding array<double>, c string")
    got = K.knn(df.repartition(5), 9, tile_rows=13, stripes=3, carry=["c"]).toPandas()
    sims = m @ m.T
    for q in range(400):
        rows = got[got.qid == q].sort_values("rank")
        assert rows.nid.tolist() == sorted(range(400), key=lambda j: (-sims[q, j], j))[:9]
        assert rows.n_c.tolist() == [f"c{j}" for j in rows.nid] and set(rows.q_c) == {f"c{q}"}


def test_sets_share_one_grid(spark):
    rng = np.random.default_rng(7)
    m = {name: rng.integers(-2, 3, (n, 4)).astype(float) for name, n in (("a", 90), ("b", 41), ("c", 1))}
    df = spark.createDataFrame([(i, name, v.tolist()) for name, x in m.items() for i, v in enumerate(x)] + [
        (500, None, [1.0] * 4)], "id long, s string, embedding array<double>")
    out = K.knn(df.repartition(4), 6, tile_rows=13, stripes=2, by="s")
    got = out.toPandas()
    assert set(got.s) == {"a", "b", "c"} and out.columns[0] == "s"
    for name, x in m.items():
        sims = x @ x.T
        for q in range(len(x)):
            rows = got[(got.s == name) & (got.qid == q)].sort_values("rank")
            assert rows.nid.tolist() == sorted(range(len(x)), key=lambda j: (-sims[q, j], j))[:6]


@pytest.mark.parametrize("metric", ["ip", "cosine"])
def test_floats_travel_as_floats(spark, metric):
    rng = np.random.default_rng(12)
    m = rng.normal(size=(600, 32)).astype(np.float32)
    m[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>")
    wide = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    a, b = (K.knn(x.repartition(4), 5, metric=metric, tile_rows=64, stripes=1) for x in (df, wide))
    rows = [sorted((r.qid, r.rank, r.nid, r.sim) for r in x.collect()) for x in (a, b)]
    assert rows[0] == rows[1] and len(rows[0]) == 5 * (600 if metric == "ip" else 599)
    # 10 tiles meet 10 blocks: 128 bytes a vector where doubles are 256
    assert shuffled_bytes(a) < 0.7 * shuffled_bytes(b)


def recall_of(spark, df, k=10, **options):
    from lexispark.operators import ivf
    found = K.knn_approx(df, k, **options).cache()
    assert found.groupBy("qid").count().where(f"count > {k}").count() == 0
    assert found.select("qid", "nid").distinct().count() == found.count()
    return found, ivf.recall(found, K.knn(df, k, metric="cosine"))


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    m = centres[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, 24))
    m[:500] = centres[0] + 0.4 * rng.normal(size=(500, 24))        # a third of all rows in one group
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    found, told = recall_of(spark, df.repartition(5), probes=8, most=100)
    r = told.agg(F.avg("recall").alias("m"), F.count("*").alias("n")).first()
    assert r.n == 1500 and r.m >= 0.9
    exact = {(x.qid, x.nid): x.sim for x in K.knn(df, 1500, metric="cosine").collect()}
    assert all(abs(exact[x.qid, x.nid] - x.sim) < 1e-9 for x in found.collect())


def test_approximate_neighbours_in_a_dense_group_and_among_copies(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(3600, 24))
    m[:3000] = m[0] + 0.001 * rng.normal(size=(3000, 24))      # near-equal vectors
    m[3000:3400] = m[3000]                                     # equal ones
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    found, told = recall_of(spark, df)
    assert told.where("qid < 3000").agg(F.avg("recall")).first()[0] >= 0.9
    assert told.where("qid >= 3000").agg(F.avg("recall")).first()[0] >= 0.9
    for r in found.where("qid between 3000 and 3399").collect():
        assert r.nid == 2999 + r.rank and abs(r.sim - 1) < 1e-12


def test_lists_of_the_index_are_split_and_lose_nothing(spark):
    from lexispark.operators import ivf
    rng = np.random.default_rng(9)
    m = rng.normal(size=(2000, 8))
    m[:900] = m[0] + 1e-4 * rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>").cache()
    book = ivf.fit_lists(df, 2000, 100)
    held = ivf._coded(df, spark.sparkContext.broadcast(book)).collect()
    sizes = [len(r.ids) // 8 for r in held]
    assert sum(sizes) == 2000 and max(sizes) <= 100
    ids = np.concatenate([np.frombuffer(r.ids, "<i8") for r in held])
    assert sorted(ids) == list(range(2000))


def test_approximate_neighbours_edges(spark):
    schema = "id long, embedding array<double>"
    assert K.knn_approx(spark.createDataFrame([], schema), 3).count() == 0
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0])], schema)
    got = [(r.qid, r.rank, r.nid) for r in K.knn_approx(odd, 2).orderBy("qid", "rank").collect()]
    assert got == [(3, 1, 3), (3, 2, 4), (4, 1, 3), (4, 2, 4), (5, 1, 5), (5, 2, 3)]


def shuffled_bytes(df):
    """Bytes that the shuffles of a query write, without what was settled before."""
    df.collect()

    def walk(node):
        name, held = node.nodeName(), node.metrics().get("shuffleBytesWritten")
        inner = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in name else None
        kids = [node.children().apply(i) for i in range(node.children().size())] + ([inner] if inner is not None else [])
        return (held.get().value() if held.isDefined() else 0) + sum(map(walk, kids))
    return walk(df._jdf.queryExecution().executedPlan())


def test_approximate_neighbours_shuffle_lists_and_not_candidates(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>")
    # 2,219 bytes a vector while candidates left the tasks; a list goes to a block once, 4 blocks on 4 cores
    assert shuffled_bytes(K.knn_approx(df.repartition(4), 10, most=100)) < 3000 * 1000


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_lists_and_all_candidates_are_the_exact_search(spark, kind):
    """Also where vectors are equal, of other lengths, or in lists of several parts."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(900, 6)).astype(np.float32)
    m[rng.permutation(900)[:60]] = m[7]
    m[300:400] = 2 * m[200:300]
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(m)], f"id long, embedding array<{kind}>")
    packed = K.knn_approx(df.repartition(3), 12, probes=900, most=50, refine=75, packed=True)
    got = {r.qid: [(x.nid, x.sim) for x in r.near] for r in packed.collect()}
    unit = m.astype(float) / np.sqrt((m.astype(float) ** 2).sum(1))[:, None]
    sims = unit @ unit.T
    assert sorted(got) == list(range(0, 2700, 3))
    for q in range(900):
        want = sorted(range(900), key=lambda j: (-round(sims[q, j], 9), j))[:12]
        assert [x[0] for x in got[q * 3]] == [j * 3 for j in want]
        assert np.allclose([x[1] for x in got[q * 3]], sims[q, want], atol=1e-12)
    from lexispark.operators import ivf
    exact = K.knn(df, 12, metric="cosine")
    told = ivf.recall(packed, exact)
    assert told.where("recall = 1 and hits = 12 and size(near) = 12").count() == 900
    rows = ivf.unpacked(told, "recall")
    assert rows.columns == ["qid", "rank", "nid", "sim", "recall"] and rows.count() == 900 * 12
    assert ivf.recall(rows.drop("recall"), exact).where("recall = 1").count() == 900


def test_blocks_hold_every_part_of_every_list_once():
    from lexispark.operators import ivf
    rng = np.random.default_rng(8)
    c, sizes = rng.normal(size=(90, 4)), rng.integers(0, 700, 90)
    sizes[[3, 50]] = 0, 9000                # nothing nearest to it; a list that could not be split
    home = ivf.blocks(c, sizes, 7)
    assert sorted(home["block"].unique()) == list(range(7)) and not home.duplicated(["list", "part"]).any()
    assert set(home["list"]) == set(np.flatnonzero(sizes)) and (home["list"] == 50).sum() == 5
    n = (sizes / ivf._parts(sizes))[home["list"]]
    assert np.bincount(home["block"], n).max() <= sizes.sum() / 7 + ivf.QUERY_TILE
    assert sorted(ivf.in_order(np.zeros((40, 3)))) == list(range(40))


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    from types import SimpleNamespace
    from lexispark.session import checkpoint_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(
        getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)


def test_scorers_see_batches_of_one_length(spark):
    from lexispark.operators import scorers as P
    df = spark.createDataFrame([(i, "ab" * (i % 7), "b" * (i % 3)) for i in range(50)],
                               "pair_id long, s1 string, s2 string").coalesce(1)

    def spy(a, b):
        sizes = [len(x) + len(y) for x, y in zip(a, b)]
        assert sizes == sorted(sizes) and len(sizes) <= 16
        return P.overlap_scorer(a, b)
    got = {(r.pair_id, r.model): r.score for r in P.score_pairs(
        df, {"spy": spy, "one": lambda a, b: [1.0] * len(a)}, batch=16).collect()}
    assert len(got) == 100 and got[1, "spy"] == 0.5 and got[0, "spy"] == 0.0
    back = {r.pair_id: r.score for r in P.score_pairs(df, {"o": P.overlap_scorer}, backward=True).collect()}
    assert back[1] == 1.0

    quotes = spark.createDataFrame([(1, "a cat sat", "cat"), (2, "the dog", "cow")],
                                   "quote_id long, quote string, keyword string")
    m = {r.quote_id: r for r in P.score_masks(quotes, {"len": P.length_scorer(["cat", "o", "to"])}).collect()}
    assert (m[1].rank, m[1].score) == (3, 0.25) and (m[2].rank, m[2].score) == (-1, None)


def test_subtoken_spans(spark):
    offsets = [(0, 0), (0, 3), (3, 5), (6, 9), (0, 0)]
    df = spark.createDataFrame([(0, 5), (3, 9), (0, 4), (6, 9)], "s int, e int").withColumn(
        "o", F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in offsets]))
    got = [r[0] and tuple(r[0]) for r in df.select(X.subtoken_span("o", "s", "e")).collect()]
    assert got == [(1, 3), (2, 4), None, (3, 4)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_tagged_corpus_over_several_splits(spark, tmp_path, end):
    from lexispark.sources.io import read_tagged_corpus
    n = 4000
    text = "".join(f"<P>{end}tok{i}/N{end}{{x}}{end}bad{end}two{i}/V{end}F,{i}/ID{end}{end}" for i in range(n))
    (tmp_path / "a.pos").write_bytes((text + f"tail/N{end}").encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = read_tagged_corpus(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5 or end != "\n"
        rows = {r.id: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n
    for i in range(0, n, 97):
        r = rows[f"F,{i}"]
        assert r.tokens == [f"tok{i}", f"two{i}"] and r.pos_tags == ["N", "V"] and r.rejects == ["bad"]


def test_csv_sentences_have_arrays(spark, tmp_path):
    from lexispark.sources.io import read_sentences
    (tmp_path / "s.csv").write_text("id,tokens,pos_tags,source\nx,a b  c,N V N,f\n")
    df, text, label = read_sentences(spark, str(tmp_path / "s.csv"))
    assert df.first()[text] == ["a", "b", "c"] and df.first()[label] == ["N", "V", "N"]


def test_violations_are_found_in_long_sentences_fast(spark):
    """Arrays that are expressions are computed once a sentence, not once a sub-token."""
    import time
    d = spark.range(64).select(F.col("id").alias("s"), F.concat_ws(" ", F.sequence(F.lit(1), F.lit(400))).alias("t")) \
        .withColumn("tokens", F.split("t", " "))
    d = d.withColumn("tags", F.transform("tokens", lambda x: F.concat(F.lit("T"), F.substring(F.md5(x), 1, 1)))) \
        .withColumn("given", F.transform("tags", lambda x: F.when((F.col("s") == 3) & (x == "T0"), "T1").otherwise(x))) \
        .withColumn("m", F.map_from_arrays(F.array(*[F.lit(f"T{k:x}") for k in range(16)]),
                                           F.array(*[F.lit(k) for k in range(16)])))
    d = d.withColumn("w", T.word_ids("tokens")).withColumn("al", T.align_labels("w", "given", "m"))
    got = lambda: [r.s for r in T.alignment_violations(d, "s", "al", "w", "tags", "m").collect()]
    got()
    start = time.time()
    assert got() == [3] and time.time() - start < 5


def test_token_metrics_read_the_tokens_once(spark):
    d = spark.createDataFrame([(["a", "b", "a"], ["a", "a", "c"]), (["b"], ["b"])], "tags array<string>, preds array<string>")
    per, acc = T.token_metrics(d)
    got = {r.tag: (round(r.precision, 4), round(r.recall, 4), r.support) for r in per.collect()}
    assert got == {"a": (0.5, 0.5, 2), "b": (1.0, 0.5, 2), "c": (0.0, 0.0, 0)} and acc.first()[0] == 0.5
    assert per._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") \
        + per._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_dealing_grows_with_the_table(spark, tmp_path, monkeypatch):
    from lexispark.sources import tables
    spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("t")).coalesce(1).write.parquet(
        str(tmp_path / "t.parquet"))
    t = spark.read.parquet(str(tmp_path / "t.parquet"))
    cores = spark.sparkContext.defaultParallelism
    parts = lambda: tables.dealt(t, "id").rdd.getNumPartitions()
    assert parts() == 2 * cores
    monkeypatch.setattr(tables, "PIECE", 10_000)
    assert parts() > 2 * cores + 20


def test_tagged_files_are_written_by_many_tasks(spark, monkeypatch):
    """One source is no single task."""
    from lexispark.plans import q_vectors as V
    from lexispark.sources import fixtures as fx
    from lexispark.sources import io as IO
    one = fx.tagged(spark, SF001).withColumn("source", F.lit("only")).repartition(6, "sent_id").localCheckpoint()
    monkeypatch.setattr(V.fx, "tagged", lambda *a: one)
    paths, read = [], IO.read_tagged_corpus
    monkeypatch.setattr(V.IO, "read_tagged_corpus", lambda s, p: (paths.append(p), read(s, p))[1])
    assert V.io_tagged_corpus(spark, SF001).count() == one.count()
    assert len(spark.read.text(paths[0]).inputFiles()) > 1


def test_keyword_search_runs_once_a_row(spark):
    """The search is a regular expression a row: no use of its result repeats it."""
    from lexispark.plans import registry
    registry.load_all()
    for name in ("text_subtoken_span", "lex_find_keyword"):
        plan = registry.QUERIES[name](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"(?U)(?<!\w)") == 1, name


def test_fewshot_rows_are_told_without_a_sort(spark):
    from lexispark.operators import fewshot as W
    # two senses with the same vectors (a tie: the larger is told) and a lemma of one far sense and one near
    rows = [(i, "l", f"s{i % 2}", 1500 + i, "n", [1.0, 1.0]) for i in range(8)]
    rows += [(10 + i, "m", f"s{i % 2}", 1600, "v", [1.0, 1.0 * (i % 2)]) for i in range(8)]
    df = spark.createDataFrame(rows, "quote_id long, lemma string, sense string, year int, pos string, e array<double>")
    vectors = df.select(F.lit("a").alias("model"), "quote_id", F.col("e").alias("embedding"), F.lit(2).alias("n_subtokens"))
    out = W.fewshot_results(df.drop("e"), vectors, iterations=3, sizes=(1, 2))
    # neither similarities nor predictions are sorted for an aggregate
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    runs = {(n, it) for n in ("1", "2") for it in range(3)} | {("full", 0)}
    told = collections.Counter((r.model, r.quote_id) for r in got)
    assert set(told.values()) == {len(runs)} and len(told) == 3 * 8       # half of 16 rows, three models
    assert {(r.n_items, r.iteration) for r in got} == runs
    assert {r.pred for r in got if r.model == "a" and r.lemma == "l"} == {"s1"}
    assert all(r.pred == r.true for r in got if r.model == "a" and r.lemma == "m")
    assert {r.pred for r in got if r.model == "majority"} == {"s0"}
    assert {r.pred for r in got if r.model == "random"} == {"s0", "s1"}
    assert {r.n_subtokens for r in got if r.model == "a"} == {2}


@pytest.mark.parametrize("method", ["chord", "polynomial"])
def test_learning_curve_shuffles_no_knees(spark, method):
    """Errors are summed where the curves are made: behind the knees there is one exchange, by draw and model."""
    pool = [(i, 1450 + 10 * (i % 30)) for i in range(90)]
    rows = [(item, 1450 + 25 * item, i, y, m, 0.8 if y < 1450 + 25 * item else 0.1 + 0.001 * i) for item in range(70)
            for i, y in pool for m in "ab"]
    s = spark.createDataFrame(rows, "item_id long, item_year int, bg_id long, bg_year int, model string, score double")
    out = D.background_curve(s, spark.createDataFrame(pool, "bg_id long, bg_year int"), [3, 7], 2, method=method)
    plan = out._jdf.queryExecution().executedPlan().toString()
    above = re.sub(r"#\d+", "", plan.split("MapInArrow")[0])
    assert re.findall(r"hashpartitioning\((.*), \d+\)", above) == ["n, iteration, kind, model"]
    got = out.collect()
    assert {(r.n, r.iteration, r.kind, r.model, r.n_items + r.n_missing) for r in got} == {
        (n, it, "raw", m, 70) for n in (3, 7) for it in range(2) for m in "ab"}
    # a model that only few items have does not keep its draws from the others
    few = D.background_curve(s.where("model = 'a' or item_id < 5"), spark.createDataFrame(
        pool, "bg_id long, bg_year int"), [3], 1, method=method).collect()
    assert {r.model: r.n_items + r.n_missing for r in few} == {"a": 70, "b": 5}


def test_repeated_years_give_the_knee_of_all_points():
    """Kneedle's steps over every point, where a year has one to six of them."""
    rng = np.random.default_rng(3)
    years = np.repeat(1450.0 + 10 * np.arange(40), rng.integers(1, 7, 40))
    curves = np.cumsum(rng.random((60, len(years))) * (rng.integers(1500, 1800, 60)[:, None] > years), axis=1)
    at = np.unique(years, return_inverse=True)[1]
    xn = (years - years[0]) / (years[-1] - years[0])
    got = D.find_knee(years, curves)
    for c, k in zip(curves, got):
        u, n = np.unique(years, return_counts=True)
        basis = D.polynomial_basis(u, n.astype(float))
        v = (basis @ (basis.T @ np.bincount(at, c)))[at]
        d = (v - v.min()) / np.ptp(v) - xn
        before, after = np.r_[d[0], d[:-1]], np.r_[d[1:], d[-1]]
        want, bound, top = None, None, None
        for i in range(len(d) - 1):
            if d[i] >= before[i] and d[i] >= after[i]:
                bound, top = d[i] - np.diff(xn).mean(), i
            if d[i] <= before[i] and d[i] <= after[i]:
                bound = 0.0
            if top is not None and d[i + 1] < bound:
                want = years[top]
                break
        assert want == (None if np.isnan(k) else k)
    assert np.isfinite(got).any()


def test_entity_counts_of_random_sentences(spark):
    """Chunks are found and compared for a batch of sentences at once, not tag by tag in the row."""
    rng = np.random.default_rng(11)
    pool = ["B-P", "I-P", "B-L", "I-L", "O", "x", "I-", None]
    draw = lambda n: [pool[j] for j in rng.integers(0, 8, n)]
    rows = []
    for i in range(500):
        tags = draw(rng.integers(0, 12))
        preds = [t if rng.random() < 0.7 else draw(1)[0] for t in tags]
        rows.append((i, tags, preds if i % 9 else preds[:-2] + draw(3)))       # some of another length
    rows += [(500, None, ["B-P"]), (501, ["I-L"], None), (502, None, None), (503, [], [])]
    df = spark.createDataFrame(rows, "id long, tags array<string>, preds array<string>")
    want = collections.defaultdict(lambda: [0, 0, 0])
    for _, tags, preds in rows:
        g, p = chunks_by_hand(tags or []), chunks_by_hand(preds or [])
        for k, some in enumerate((g, p, set(g) & set(p))):
            for *_, kind in some:
                want[kind][k] += 1
    for parts in (1, 7):
        per, overall = T.entity_metrics(df.repartition(parts), "id")
        assert "transform(" not in per._jdf.queryExecution().optimizedPlan().toString()
        got = {r.tag: (r.precision, r.recall, r.support) for r in per.collect()}
        assert got == {k: (pytest.approx(h / p), pytest.approx(h / g), g) for k, (g, p, h) in want.items()}
        g, p, h = np.sum(list(want.values()), axis=0)
        assert tuple(overall.first())[:2] == (pytest.approx(h / p), pytest.approx(h / g))
