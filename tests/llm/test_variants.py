import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lexispark.llm import variants as V
from lexispark.llm.queries import op12_spelling_variants


def words_by_hand(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
            yield w[:i] + c + w[i + 1:]
        yield w[:i] + w[i + 1:]


def by_hand(rows):
    words = words_by_hand(rows)
    letters = sorted({c for w in words for c in w})
    near = {w: {e for e in edits(w, letters) if e in words and e != w} for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op12_spelling_variants(spark, sf)
    assert dict(got.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint",
                                "form": "string", "form_n": "bigint", "root": "string"}
    got = got.collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == by_hand(rows)
    assert any(r.form for r in got)


def test_planted_variants(spark):
    """Runs of one letter, ties, chains, letters of two bytes, edits at either end."""
    rng = random.Random(4)
    base = ["ballooon", "mississippi", "réglerÿ", "aaaaaa", "widgets", "Éclairs"]
    words = set(base)
    for w in base * 3:
        words |= {rng.choice([w[1:], w + "s", w[:3] + w[4:], w[:2] + "x" + w[3:], w[:4] + w[3:],
                              w[:3] + "é" + w[3:], w[0] + w, w + w[-1]]) for _ in range(4)}
    rows = [(i, " ".join(w for w in sorted(words) for _ in range(rng.choice([0, 1, 1, 9]))) + " -")
            for i in range(40)]
    rows += [(None, " ".join(["WIDGETS widgetz"] * 200)), (99, "widgetz_widget1 " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (1, 5):
        got = V.spelling_variants(docs.repartition(p)).collect()
        assert set(map(tuple, (r[:6] for r in got))) == by_hand(rows)


def test_a_chain_is_followed_to_its_end(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {(r.word, r.root) for r in V.roots(links).collect()} == {(f"w{i}", "w9") for i in range(9)}
    assert V.roots(links.limit(0)).count() == 0
    star = spark.createDataFrame([(f"x{i}", "y") for i in range(500)] + [("y", "z")], links.schema)
    assert {r.root for r in V.roots(star).collect()} == {"z"}


def test_ranges_stay_small(spark):
    """A word with very many near words gives rows by rotation, not by pair."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xE0, 0x100))]
    words = {"abcdefgh"[:i] + c + "abcdefgh"[i + 1:] for i in range(8) for c in letters}
    df = spark.createDataFrame([(w, 5 + len(w)) for w in words], "word string, n long")
    rows = V.rotations(df)
    assert rows.count() == sum(2 * len(w) + 1 for w in words)
    assert rows.groupBy("range").count().agg(F.max("count")).first()[0] <= len(letters) + 1
    got = {r.word: r.n_near for r in V.near_words(df).collect()}
    assert got["abcdefgh"] == len(words) - 1


def test_edges(no_docs, odd_docs, clash):
    assert V.spelling_variants(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs = clash(odd_docs).withColumn("word", F.lit("x")).withColumn("n", F.lit("y"))
    assert set(map(tuple, V.spelling_variants(docs).collect())) == by_hand(rows)
