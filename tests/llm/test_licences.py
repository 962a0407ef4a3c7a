import re

from lexispark.llm import licences as L

PAD = "some words here "


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words(text)
    hits = [(i, t) for t in L.TEMPLATES if not t.keys for i in range(len(w))
            if w[i:i + len(t.words)] == t.words]
    base = [(i, t) for i, t in hits if t.base]
    return (len(w), len(base), min((i for i, _ in base), default=None),
            max((i for i, _ in base), default=None), ",".join(sorted({t.label for _, t in base})),
            ",".join(sorted({t.label for _, t in hits})))


TEXTS = ["Released under the MIT License.", "cc by nc cc BY-NC cc by by nc", "mit license under the",
         "Apache License, Version 2.0 and the Apache licence version 2", "license " * 50,
         "under the mit " * 3 + "license", "GNU General Public License, version 3", "émit cc",
         "under the mit license apache license version 2 cc by nc", "the mit license"]


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.scan_licences(df).collect()}


def test_equals_a_scan_of_every_position(spark, odd_docs):
    texts = TEXTS + [r.text for r in odd_docs.collect()] + [PAD * 50 + t + " " + PAD for t in TEXTS]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(t), t
        assert 0 <= r.score <= 1


def test_part_of_a_template_is_enough_with_its_key_phrase(spark):
    whole = next(t for t in L.OWN if t.label == "bsd").text
    half = whole.replace("modification", "changes")
    got = scan(spark, [whole, half, whole.replace("binary", "any"), "redistribution and use"])
    assert [got[i].labels for i in range(4)] == ["bsd", "bsd", "", ""]
    assert got[0].score == 1 and 0.8 <= got[1].score < 1
    assert got[1].places[0].start == 0


def test_edges(no_docs, odd_docs, clash):
    assert L.scan_licences(no_docs).count() == 0
    got = {r.doc_id: r for r in L.scan_licences(clash(odd_docs)).collect()}
    assert got[7].base_labels == "cc-by-nc,mit" and got[7].n_base == 2
    assert got[2].n_words == 0 and got[2].labels == "" and got[2].first_word is None


def test_names_of_the_inside_are_free(odd_docs):
    from pyspark.sql import functions as F
    docs = odd_docs
    for n in ("__s", "__n", "__p"):
        docs = docs.withColumn(n, F.lit(n))
    assert all(r["__s"] == "__s" and r["__n"] == "__n" and r["__p"] == "__p" for r in L.scan_licences(docs).collect())


def test_sql_covers_templates_with_key_phrases(spark, tmp_path):
    """A text with the grant sentence of a licence is labelled by both engines."""
    import duckdb
    texts = TEXTS + [t.text for t in L.OWN] + [PAD + t.text.replace("this", "the") + PAD for t in L.OWN] + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = scan(spark, texts)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    found = con.execute(L.licence_sql()).fetchdf().astype(object)
    found = found.where(found.notna(), None)
    assert len(found) == len(rows) and any("bsd" in x for x in found["labels"])
    for r in found.to_dict("records"):
        assert [r[n] for n in names] == [got[r["doc_id"]][n] for n in names], texts[r["doc_id"]]
        assert abs(r["score"] - got[r["doc_id"]].score) < 1e-9


def test_plan_has_no_python_and_no_text_shuffle(odd_docs):
    plan = L.scan_licences(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
