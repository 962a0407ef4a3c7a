import random
import zlib

import numpy as np

from lexispark.llm import quality_classifier as C
from lexispark.sources.tables import table


def corpus(spark, n=900):
    """Good prose, and junk that is a known share of the unlabelled text."""
    rng, docs, labels = random.Random(7), [], []
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
                  for _ in range(400)]
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        good = i % 5 != 0
        text = " ".join(words).capitalize() + "." if good else " | ".join(w + "&&" for w in words)
        docs.append((i, text, "en", "a", len(text)))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, "
                                  "n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_ranking(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in C.classify(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    good = [got[i].score for i in held if i % 5]
    bad = [got[i].score for i in held if i % 5 == 0]
    assert min(good) > max(bad)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_given_data_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = C.classify(docs, labels).join(labels, "doc_id").select(
        "doc_id", "quality", "score").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    good, bad = (held[held.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.99
    assert (good >= 0.3).mean() > 0.99


def test_held_out_labels_have_no_say(spark):
    docs, labels = corpus(spark, 400)
    from pyspark.sql import functions as F
    from lexispark.llm.common import crc_fold
    turned = labels.withColumn("quality", F.when(crc_fold(F.col("doc_id")) == 0,
                                                 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in C.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in C.classify(docs, turned).collect()}
    assert a == b


def test_prior_estimate():
    rng = np.random.default_rng(0)
    for prior in (0.3, 0.6, 0.9):
        p = rng.normal(3, 1, 4000)
        u = np.where(rng.random(8000) < prior, rng.normal(3, 1, 8000), rng.normal(-3, 1, 8000))
        assert abs(C.estimate_prior(p, u) - prior) < 0.06


def test_risk_never_fits_negatives_that_are_positives():
    """Unlabelled text that holds positives only: its score stays high."""
    rng = np.random.default_rng(1)
    x = np.zeros((3000, C.WIDTH), np.float32)
    x[:, :C.STYLE] = np.abs(rng.normal(0, 0.3, (3000, C.STYLE)))
    model = C.fit(x[:1000], x[1000:], prior=0.98)
    assert (model.scores(x[1000:]) >= 0.3).mean() > 0.95


def test_edges(spark, no_docs, odd_docs, clash):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = C.classify(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, None),
                                    (6, 1, 0), (3, 0, 1), (7, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = C.classify(clash(odd_docs), labels)
    assert got.columns[-2:] == ["score", "predicted"] and got.count() == odd_docs.count()
    empty = {r.score for r in got.filter("text is null or text = '' or doc_id = 4").select(
        "score").collect()}
    assert all(0 <= s <= 1 for s in empty)
    assert C.classify(no_docs, labels).count() == 0


def score_by_hand(text, model):
    """The score of one text in plain Python: every feature counted byte by byte."""
    raw = (text or "").encode()
    words = [w for w in raw.translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]
    x = [300 / (300 + len(raw))] + [0.0] * (15 + 512)
    if words:
        kinds = [0] * 10
        for c in raw:
            kinds[9 if c > 127 else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57
                  else 5 if c == 10 else 4 if c in (9, 11, 12, 13, 32) else 7 if c in b".!?"
                  else 6 if c in b"#*$%&|<>{}[]\\^~_=+@" else 8 if c in b",;:'\"()-/`" else 0] += 1
        x[1:11] = [(k / len(raw)) ** 0.5 for k in kinds]
        x[11] = (sum(a == b for a, b in zip(words, words[1:])) / len(words)) ** 0.5
        x[12] = 1 - len(set(words)) / len(words)
        x[13] = min(sum(map(len, words)) / len(words) / 10, 5)
        lines = [w for w in raw.split(b"\n") if w.strip(b"\t\n\v\f\r ")]
        x[14] = 1 - len(set(lines)) / len(lines)
        x[15] = sum(len(w) == 1 for w in words) / len(words)
        pairs = [0] * 512
        for a, b in zip(raw, raw[1:]):
            pairs[((a << 8 | b) * 2654435769 & 0xFFFFFFFF) >> 23] += 1
        x[16:] = [(k / max(1, len(raw) - 1)) ** 0.5 for k in pairs]
    z = [(v - float(m)) / float(s) for v, m, s in zip(x, model.mean, model.scale)]
    z[16:] = [v * (1 - x[0]) for v in z[16:]]
    t = sum(v * float(w) for v, w in zip(z, model.weight)) + model.bias
    return 1 / (1 + np.exp(-min(30, max(-30, t))))


def test_scores_equal_a_count_by_hand(spark, odd_docs):
    docs, labels = corpus(spark)
    model = C.train(docs, labels)
    some = docs.filter("doc_id < 25").unionByName(odd_docs)
    for r in C.score(some, model).collect():
        if len(r.text or "") < 20_000:
            assert abs(r.score - score_by_hand(r.text, model)) < 1e-4, r.doc_id
