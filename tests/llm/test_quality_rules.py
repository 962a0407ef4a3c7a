import collections
import re

from pyspark.sql import functions as F

from lexispark.llm import quality_rules as Q
from lexispark.sources.tables import table


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines),
            len(lines) - len(set(lines)), len(hit))


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force(spark, odd_docs):
    texts = [r.text for r in odd_docs.collect()] + [
        "a a a a a", "a b a b a b", "a b c x a b c", "x\nx\n \nx", "# * $ %", "🙂 é\x1cb c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in Q.measured(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_interleaved_windows_of_one_key(spark):
    """Two windows whose hashes share the 40 bits of the key, in the order A B A (and more)."""
    a, b = "a b 1311577", "a b 2863090"
    keys = spark.range(1).select(*[F.shiftright(F.xxhash64(*[F.lit(x) for x in t.split()]), 24)
                                   for t in (a, b)]).first()
    assert keys[0] == keys[1]
    texts = [" ".join(x) for x in ((a, b, a), (a, b), (a, b, a, b), (b, a, a, b), (a, "x", b, a, "y", a))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in Q.measured(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)} and got[0][-1] == 6


def test_whole_table_counts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = dict(docs.select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in Q.measured(docs).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


def test_sketches_merge_and_bound_the_error(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"),
        F.concat(F.repeat(F.lit("word "), 60), F.repeat(F.lit("# "), (F.col("id") % 50).cast("int")))
        .alias("text"))
    m = Q.measured(docs)
    whole = Q.quartiles(Q.sketches(m)).filter("measure = 'symbol_ratio'").first()
    exact = sorted(r[0] / r[1] for r in m.select("n_symbols", "n_words").collect())
    assert abs(whole.q3 - exact[2999]) <= Q.RELATIVE * exact[2999] + 1e-12
    parts = None
    for s in ("s0", "s1", "s2"):
        one = Q.sketches(m.filter(F.col("source") == s))
        parts = one if parts is None else parts.union(one)
    assert Q.quartiles(parts).filter("measure = 'symbol_ratio'").first() == whole


def test_outliers_go_and_ordinary_documents_stay(spark):
    rng = __import__("random").Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
                            for _ in range(120))
    rows = [(i, text(), "en", "a") for i in range(300)] + [
        (1000, " ".join(w + "***" for w in text().split()), "en", "a"),
        (1001, "same line here now\n" * 40 + text(), "en", "a"), (1002, text(), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in Q.adaptive_quality(df).filter("kept").collect()}
    assert kept == {i for i, *_ in rows} - {1000, 1001}
    assert {r.doc_id for r in Q.keep_good(df).collect()} == kept


def test_edges(no_docs, odd_docs, clash):
    assert Q.adaptive_quality(no_docs).count() == 0
    assert Q.adaptive_quality(odd_docs).count() == odd_docs.count()
    assert Q.adaptive_quality(clash(odd_docs)).filter("kept").count() == Q.keep_good(
        clash(odd_docs)).count()
    assert Q.keep_good(clash(odd_docs)).columns == clash(odd_docs).columns
    failed = {r.doc_id for r in Q.adaptive_quality(odd_docs).filter("base_failed").collect()}
    assert failed == {1, 2, 3, None, 4, 5, 6, 7, 8}


def test_names_of_the_inside_are_free(odd_docs):
    from pyspark.sql import functions as F
    docs = odd_docs
    for n in ("__w", "__l", "__lang", "__source"):
        docs = docs.withColumn(n, F.lit(n))
    for got in (Q.measured(docs), Q.keep_good(docs)):
        assert {"__w", "__l", "__lang", "__source"} <= set(got.columns)
        assert all(r[n] == n for r in got.collect() for n in ("__w", "__l", "__lang", "__source"))
