"""Hand-made edge cases (the reference has no tests; these follow its inline checks)."""

import numpy as np
from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.operators import dating as D
from lexispark.operators import knn as K
from lexispark.operators import tagging as T


def test_first_pos_edge_cases(spark):
    cases = [("set, n.1", "n"), ("set, v. and adj.", "v"), ("run, (and) n.", "n"), ("x,adj.", "adj"),
             ("nohead", None), ("x, ", ""), ("x, n. (1)", "n"), ("x,  and v.2, n", "v"),
             ("x, land n.", "l"), ("x,\tn.3", "n"), ("a, n\tq r.", "n")]
    df = spark.createDataFrame([(w,) for w, _ in cases], "word string")
    got = [r[0] for r in df.select(X.first_pos("word")).collect()]
    assert got == [e for _, e in cases]


def test_sense_depth_and_keys(spark):
    cases = [("1", 1, ["1"]), ("1.a", 2, ["1", "1-a"]), ("I.1.b", 3, ["I", "I-1", "I-1-b"]),
             ("2..", 1, ["2"]), ("", 1, [""]), ("..", 1, [""])]
    df = spark.createDataFrame([(n,) for n, _, _ in cases], "numbering string")
    rows = df.select(X.sense_depth("numbering").alias("d"),
                     *[X.depth_key("numbering", i, "-").alias(f"k{i}") for i in (1, 2, 3)]).collect()
    for (n, d, keys), r in zip(cases, rows):
        assert r["d"] == d, n
        for i, k in enumerate(keys, 1):
            assert r[f"k{i}"] == k, (n, i)


def test_tagged_corpus_reader(spark, tmp_path):
    from lexispark.sources.io import read_tagged_corpus
    p = tmp_path / "a.pos"
    p.write_text("{C}\n<P_1>\nThe/D\nman/N\nX,1.1/ID\n\nHe/PRO\nbad/line/x\nY,1.2/ID\ntail/N\n")
    rows = {r["id"]: r for r in read_tagged_corpus(spark, str(p)).collect()}
    assert set(rows) == {"X,1.1", "Y,1.2"}
    assert rows["X,1.1"]["tokens"] == ["The", "man"] and rows["X,1.1"]["pos_tags"] == ["D", "N"]
    assert rows["Y,1.2"]["tokens"] == ["He"] and rows["Y,1.2"]["rejects"] == ["bad/line/x"]


def test_label_alignment(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, 2, 2, None], ["A", "B", "Z"], {"A": 0, "B": 1})],
                               "w array<int>, l array<string>, m map<string,int>")
    got = df.select(T.align_labels("w", "l", "m")).first()[0]
    assert got == [-100, 0, -100, 1, -101, -100, -100]


def test_subwords(spark):
    toks = "[CLS] act ##ual ##lye in dede act ##ual ##lye [SEP]".split()
    df = spark.createDataFrame([(1, toks)], "id int, p array<string>")
    got = [(r["word"], r["idx"]) for r in T.group_subwords(df, "id", "p").orderBy("word_no").collect()]
    assert got == [("actuallye", [1, 2, 3]), ("in", [4]), ("dede", [5]), ("actuallye", [6, 7, 8])]


def test_knee_chord(spark):
    rows = []
    for i in range(4):
        for j, year in enumerate(range(1450, 1950, 10)):
            rows.append((i, j, year, 1.0 if year < 1500 + 50 * i else 0.0))
    rows += [(9, j, y, 0.0) for j, y in enumerate(range(1450, 1950, 10))]  # flat curve
    df = spark.createDataFrame(rows, "item_id int, bg_id int, bg_year int, score double")
    got = {r["item_id"]: r["knee"] for r in D.date_items(df).collect()}
    assert got == {0: 1490, 1: 1540, 2: 1590, 3: 1640, 9: None}


def test_mask_and_mark(spark):
    df = spark.createDataFrame([("a cat and a cat", "cat"), ("no match", "dog")], "q string, k string")
    r = df.select(X.mask_first("q", "k").alias("m"), X.mark_keyword("q", "k").alias("t")).collect()
    assert r[0]["m"] == "a [MASK] and a cat" and r[1]["m"] == "no match"
    assert r[0]["t"] == "a [TGT] cat [TGT] and a cat" and r[1]["t"] is None


def test_retrieval_perfect_neighbours(spark):
    # label a: 3 items, all neighbours perfect; n <= k -> accuracy (n-1)/n, ap 1
    nb = spark.createDataFrame([(q, r, n, 1.0) for q in (1, 2, 3) for r, n in
                                enumerate([q] + [x for x in (1, 2, 3) if x != q] + [4, 5], 1)],
                               "qid long, rank int, nid long, sim double")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b")], "id long, l string")
    s = {r["qid"]: r for r in K.retrieval_scores(nb, labels, 5, "l").collect()}
    for q in (1, 2, 3):
        assert s[q]["ap"] == 1.0 and abs(s[q]["accuracy"] - 2 / 3) < 1e-12


def test_knn_grid_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<float>")
    got = K.knn(df.repartition(3), 7, tile_rows=16).orderBy("qid", "rank").toPandas()
    m = vecs.astype(np.float64)
    sims = m @ m.T
    for q in (0, 17, 299):
        order = sorted(range(300), key=lambda j: (-sims[q, j], j))[:7]
        assert got[got.qid == q].nid.tolist() == order


def test_best_threshold_brute_force(spark):
    from lexispark.operators.senses import best_threshold
    rng = np.random.default_rng(5)
    s = rng.random(400)
    y = (s + rng.normal(scale=0.3, size=400) > 0.6).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    got = best_threshold(df, n=25).first()
    ths = np.linspace(0, 1, 25)
    accs = [((s >= t).astype(int) == y).mean() for t in ths]
    best = int(np.argmax(accs))
    assert abs(got["threshold"] - ths[best]) < 1e-9 and abs(got["accuracy"] - accs[best]) < 1e-12


def test_subwords_of_odd_sentences(spark):
    """Nulls, the mark between words, empty words and pieces that continue nothing: as piece by piece."""
    rows = [["abcdefghi", "x", ""], ["ab\u0001cdefg", "h"], [None, "abcde"], [None, "a\u0001b"], [], ["\U0001d504bcde", "$1##"]]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t array<string>")
    got = {r.id: r.p for r in df.select("id", T.subword_pieces("t").alias("p")).collect()}
    assert got[0] == ["abcd", "##efgh", "##i", "x", ""] and got[1] == ["ab\u0001c", "##defg", "h"]
    assert got[4] == [] and got[5] == ["\U0001d504bcd", "##e", "$1##"]
    pieces = [["##z", "[CLS]", "##y", "ab", "##cd", "E", "[PAD]", "##q", "", "##f", "aBcd"],
              ["ab", None, "##c\u0001d", "AB", "[SEP]"], ["##z"], []]
    df = spark.createDataFrame([(i, p, "ABCD") for i, p in enumerate(pieces)], "id int, p array<string>, k string")
    words = lambda **o: [tuple(r) for r in T.group_subwords(df, "id", "p", **o).orderBy("id", "word_no").collect()]
    assert words() == [(0, 0, "abcd", [3, 4]), (0, 1, "E", [5]), (0, 2, "f", [8, 9]), (0, 3, "aBcd", [10]),
                       (1, 0, "abc\u0001d", [0, 1, 2]), (1, 1, "AB", [3])]
    assert words(only="k") == [(0, 0, "abcd", [3, 4]), (0, 3, "aBcd", [10])]


def test_only_the_keywords_words_are_shuffled(spark):
    """tag_pool_word_vector: the rows that meet the keywords are the keyword's own words."""
    from lexispark.plans import q_tagging, registry
    registry.load_all()
    seen, was = [], T.pool_word_vector
    T.pool_word_vector = lambda g, *a: seen.append(g) or was(g, *a)
    try:
        registry.QUERIES["tag_pool_word_vector"](spark, "/root/testdata/sf0.001")
    finally:
        T.pool_word_vector = was
    tokens = q_tagging.fx.tagged(spark, "/root/testdata/sf0.001").selectExpr("sum(size(tokens)) as n").first().n
    assert seen[0].count() < tokens / 10


def test_words_are_lowered_once_in_the_bigram_model(spark):
    df = spark.createDataFrame([(["A", "b", "a", "B"],), (["x"],), ([],), (None,), (["a", None, "b"],)], "tokens array<string>")
    model = T.bigram_model(df)
    got = {(r.prev, r.word, r.rank): r.score for r in model.collect()}
    assert got == {("a", "b", 1): 2 / 3, ("a", None, 2): 1 / 3, ("b", "a", 1): 1.0}
    plan = model._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == plan.count("Generate explode")


def test_nothing_is_cut_before_the_rows_are_dealt(spark):
    """tag_pool_word_vector: no array is built below the exchange that deals the documents over the cores."""
    from lexispark.plans import registry
    registry.load_all()
    plan = registry.QUERIES["tag_pool_word_vector"](spark, "/root/testdata/sf0.001")._jdf.queryExecution() \
        .optimizedPlan().toString().split("\n")
    dealt = [i for i, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert dealt and not any("split(" in plan[i + k] for i in dealt for k in (1, 2))


def test_running_top_k_of_tiles_of_many_rows():
    """Tiles of more rows than are multiplied at once, in which half of all similarities are equal."""
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (900, 3)).astype(float)
    ids = rng.permutation(900).astype("<i8")

    class Part:
        def __init__(self, a, b):
            self.ids, self.mat, self.carry = ids[a:b], x[a:b], [np.array([f"c{i}" for i in ids[a:b]], object)]
    best = K._Best(Part(0, 700), 1)
    for a, b in ((0, 5), (5, 300), (300, 890), (890, 900)):
        best.meet(Part(a, b), 20)
    for q in range(700):
        want = ids[np.lexsort((ids, -(x @ x[q])))[:20]]
        assert best.i[q].tolist() == want.tolist() and best.x[0][q].tolist() == [f"c{i}" for i in want]
