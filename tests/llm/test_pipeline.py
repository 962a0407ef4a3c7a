import collections

import corpus_pipeline
from lexispark.llm import common, mixing, near_dups, pieces, quality_classifier, quality_rules
from lexispark.llm import queries as Q
from lexispark.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_stages_one_after_another(spark):
    """Each stage against its operator, or a brute-force rule, on all that its predecessor kept."""
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "quality rules", "near-dedup", "mixing", "encoding"]

    good = common.settle(stage["quality classifier"](spark, docs, SF), "good")
    want = {r.doc_id for r in quality_classifier.classify(docs, labels).collect() if r.score >= 0.3}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    fine = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(fine & want) > 0.99 * len(fine) and len(bad & want) < 0.2 * len(bad)

    ruled = common.settle(stage["quality rules"](spark, good, SF), "ruled")
    judged = quality_rules.adaptive_quality(good).collect()
    assert ruled.columns == docs.columns
    assert {r.doc_id for r in ruled.collect()} == {r.doc_id for r in judged if r.kept}

    single = common.settle(stage["near-dedup"](spark, ruled, SF), "single")
    from tests.llm.test_near_dups import brute
    classes = brute([tuple(r) for r in ruled.select("doc_id", "text").collect()])
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))

    mixed = common.settle(stage["mixing"](spark, single, SF), "mixed")
    from tests.llm.test_mixing import brute as copies
    n = collections.Counter(dict(copies([(r.doc_id, r.source, r.text) for r in single.collect()])))
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +n

    coded = stage["encoding"](spark, mixed, SF)
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    text = {r.doc_id: r.text for r in single.collect()}
    rows = coded.collect()
    assert len(rows) == sum(n.values())
    for r in rows[:200]:
        assert r.ids == library.encode(text[r.doc_id])

    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids) for r in again.collect()) == sorted(
        (r.doc_id, r.ids) for r in rows)
    assert mixing and near_dups


def filled(odd_docs):
    """The odd rows, with texts that pass the rules, repeated rows and null keys among them."""
    from pyspark.sql import functions as F
    prose = " ".join(f"{a}{b}" for a in ("brown ", "river ", "stone ", "quiet ", "amber ", "north ")
                     for b in ("house", "field", "garden", "window", "morning", "letter", "winter", "market"))
    more = odd_docs.limit(1).select(
        F.explode(F.array(*[F.lit(i).cast("long") for i in (50, 50, 51, None)])).alias("doc_id"),
        F.lit(prose).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("a").alias("source"),
        F.lit(1).cast("long").alias("n_chars"))
    return odd_docs.unionByName(more)


def test_edges_of_every_stage(spark, odd_docs, no_docs, clash):
    docs = clash(filled(odd_docs))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.settle(stage(spark, docs, SF), "edge")
        assert out.columns == columns, name
        assert all(r["score"] == r["kept"] == r["mix_key"] == r["block"] == "x" for r in out.collect()), name
        docs = docs if name == "quality classifier" else out     # the rules see every odd row
        if name != "quality classifier":
            assert out.where("text is null or text = ''").count() == 0
        if name == "near-dedup":
            texts = [r.text for r in out.collect()]
            assert len(texts) == len(set(texts)) > 0             # one of each group of copies
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == ["doc_id", "ids", "n_tokens"]
    whole = corpus_pipeline.STAGES[-1][1](spark, clash(odd_docs), SF).collect()
    assert len(whole) == odd_docs.count() and all(r.ids == [] for r in whole if r.doc_id in (2, 3))
    docs = clash(no_docs)
    for name, stage in corpus_pipeline.STAGES:
        out = common.settle(stage(spark, docs, SF), "none")
        assert out.count() == 0, name
        docs = out if name != "encoding" else docs


def test_thirteen_queries_are_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(Q.ORACLES) <= names
