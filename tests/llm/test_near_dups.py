import collections
import itertools
import random

import numpy as np

from lexispark.llm import near_dups as N
from lexispark.sources.tables import table


def shingles(text):
    w = (text or "").encode().lower().split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)) if w)


def similarity(a, b):
    low, high = sum((a & b).values()), sum((a | b).values())
    return 1.0 if not high else low / high


def brute(rows):
    """Smallest id of each document's class by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {"no words": 1}:
            by[x].append(i)
    for a, b in {p for v in by.values() for p in itertools.combinations(v, 2)}:
        if similarity(sets[a], sets[b]) >= 0.8 - 1e-12:
            parent[find(b)] = find(a)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    return {rows[i][0]: min(least[find(i)]) for i in range(len(rows))}


def test_given_data_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = N.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())


def test_hot_groups(spark):
    """A third of the rows are one group of near copies, another many exact copies."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
    rows = []
    for i in range(240):
        x = list(base)
        x[rng.randrange(200)] = f"q{i}"
        rows.append((i, " ".join(x)))
    rows += [(1000 + i, "some copied text of seven words") for i in range(200)]
    rows += [(2000 + i, " ".join(f"u{rng.randint(0, 10 ** 6)}" for _ in range(80)))
             for i in range(150)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert got == want and len(set(got.values())) == 152
    assert N.keep_one(df).count() == 152


def test_group_around_the_threshold(spark, monkeypatch):
    """Copies with many edits: most pairs of a bucket are no links, and classes are chains."""
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "CHOICE", 4)
    monkeypatch.setattr(N, "PART", 32)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    rows = []
    for i in range(140):
        x = list(base)
        for k in rng.sample(range(200), rng.randint(2, 7)):
            x[k] = f"q{rng.randint(0, 10 ** 6)}"
        rows.append((i, " ".join(x)))
    want = brute(rows)
    assert 5 < len(set(want.values())) < 130
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()} == want


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    item = N.mix64(np.arange(60))
    for scale in (0.01, 1.0, 500.0):       # real weights; long and short documents
        a, b = rng.random(60) * scale, rng.random(60) * scale
        s = N.dart_signatures(np.repeat([0, 1], 60), np.tile(item, 2), np.r_[a, b], 2, 4096)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4096)


def test_band_recall_at_the_threshold():
    """Pairs at a similarity of 0.8 share a bucket but for 1 in 1,000."""
    assert (1 - 0.8 ** N.ROWS) ** N.BANDS < 1e-3
    rng, missed = random.Random(5), 0
    for _ in range(100):
        base = [str(rng.random()) for _ in range(225)]
        other = base[:200] + [str(rng.random()) for _ in range(25)]   # 196 of 246 shingles
        d, h, c = N.shingle_sets([[w.encode() for w in x] for x in (base, other)])
        k = N.band_keys(N.dart_signatures(d, h, c.astype(float), 2))
        missed += not (k[0] == k[1]).any()
    assert missed <= 2


def test_edges(spark, no_docs, odd_docs, clash):
    assert N.near_duplicates(no_docs).count() == 0 and N.keep_one(no_docs).count() == 0
    got = N.near_duplicates(clash(odd_docs))
    rows = [(r.doc_id, r.class_id, r.kept) for r in got.collect()]
    assert len(rows) == odd_docs.count()
    assert sorted(r for r in rows if r[0] == 1) == [(1, 1, False), (1, 1, True)]
    assert {r[1] for r in rows if r[0] in (2, 3, 4)} == {2}        # no words
    assert {r[1] for r in rows if r[0] in (5, 6)} == {5}
    kept = N.keep_one(clash(odd_docs))
    assert kept.columns == clash(odd_docs).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 5, 7, 8, None]


def test_result_does_not_depend_on_partitions(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    one, many = (sorted(map(tuple, N.near_duplicates(d).select("doc_id", "class_id", "kept").collect()))
                 for d in (docs.coalesce(1), docs.repartition(13)))
    assert one == many


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [
        (1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in N.components(spark.createDataFrame(
        edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
