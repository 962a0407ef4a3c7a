import collections
import math
import re
import zlib

import numpy as np

from lexispark.llm import lm_mixing as M
from lexispark.sources.tables import table


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b""]


def brute(rows):
    counts = collections.Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, len(w), sum(x in counts for x in w), n,
             sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
            for i, w in ((i, tokens(t)) for i, t in rows)]


def check(got, rows):
    key = lambda r: (str(r[0]), r[1], round(r[4], 4))
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got),
                  key=key)
    for a, b in zip(have, sorted(brute(rows), key=key), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_base_columns_and_held_out_gain(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = M.score_texts(docs).collect()
    check(got, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got
                                        if zlib.crc32(str(r.doc_id).encode()) % 5 == 1}
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    assert all(r.spelled_score <= r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_small_blocks_change_no_count(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(M.score_texts(odd_docs.repartition(3), block_bytes=64).collect(), rows)
    check(M.score_texts(odd_docs).collect(), rows)


def test_codes_are_a_distribution():
    """Probabilities of all codes in a context add up to 1, before and after learning."""
    rng = np.random.default_rng(0)
    mixer = M.Mixer(6, 3, 10)
    every = np.arange(64)
    context = [np.full(64, 17, np.uint32), np.full(64, 23, np.uint32)]
    for _ in range(3):
        assert math.isclose((2.0 ** mixer.log2(every, context)).sum(), 1.0, rel_tol=1e-5)
        seen = rng.integers(0, 9, 3000)
        mixer.learn(seen, [seen.astype(np.uint32) * np.uint32(5), np.full(3000, 23, np.uint32)])


def test_context_that_tells_is_learnt():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 64, 40_000)
    before = np.roll(code, 1)
    code[1::2] = (before[1::2] * 7 + 3) % 64      # every second code follows from the one before
    before = np.roll(code, 1).astype(np.uint32)
    noise = rng.integers(0, 1 << 30, len(code)).astype(np.uint32)
    mixer = M.Mixer(6, 3)
    mixer.learn(code[:30_000], [before[:30_000], noise[:30_000]])
    bits = -mixer.log2(code[30_000:], [before[30_000:], noise[30_000:]])
    assert bits[1::2].mean() < 4 < 5.9 < bits[::2].mean() < 8     # 6 bits without the context


def test_models_of_tasks_add_up():
    rng = np.random.default_rng(2)
    code, c = rng.integers(0, 256, 5000), rng.integers(0, 50, 5000).astype(np.uint32)
    a, b = M.Mixer(8, 2, 8), M.Mixer(8, 2, 8)
    a.learn(code[:2000], [c[:2000]])
    b.learn(code[2000:], [c[2000:]])
    total = collections.defaultdict(lambda: [0.0, 0.0])
    for m in (a, b):
        for kind, at, x, y in m.rows(0):
            for k, p, q in zip(at, x, y):
                total[kind, k][0] += p
                total[kind, k][1] += q
    keys = np.array(list(total))
    val = np.array(list(total.values()))
    m = M.Mixer(8, 2, 8).load(0, keys[:, 0], keys[:, 1], val[:, 0], val[:, 1])
    assert np.allclose(m.n, a.n + b.n) and np.allclose(m.seen, a.seen + b.seen)
    assert np.allclose(m.weight, (2000 * a.weight + 3000 * b.weight) / 5000, atol=1e-5)


def test_edges(spark, no_docs, odd_docs, clash):
    assert M.score_texts(no_docs).count() == 0
    got = M.score_texts(clash(odd_docs))
    assert got.count() == odd_docs.count()
    empty = [r for r in got.collect() if r.doc_id in (2, 3, 4)]
    assert {r.n_tokens for r in empty} == {1}
    held = spark.createDataFrame([(i, "a b") for i in range(200)
                                  if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    for r in M.score_texts(held).collect():          # nothing to learn from
        assert r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score)


def test_every_context_has_counters_of_its_own():
    """Log-odds along a code are those of the counts of its own context, however many there are."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 52, 60_000).astype(np.uint64)
    keys = np.concatenate([h << np.uint64(12) | rng.integers(0, 4096, 60_000).astype(np.uint64)
                           for h in (hashes, hashes, hashes)])
    distinct, count = np.unique(keys, return_counts=True)
    odds = M.path_odds(distinct, count, 12)
    seen = collections.defaultdict(lambda: [0, 0])
    for k, c in zip(distinct.tolist(), count.tolist()):
        for d in range(12):
            seen[d, k >> (12 - d)][k >> (11 - d) & 1] += c
    for i in range(0, len(distinct), 1000):
        for d in range(12):
            n = seen[d, int(distinct[i]) >> (12 - d)]
            assert abs(odds[i, d] / M.ODDS_STEP - math.log((n[1] + 0.4) / (n[0] + 0.4))) <= 0.051


def test_levels_of_merging_change_nothing(spark, monkeypatch):
    """Many parts reached level by level, a few at a time, give the counts that one deal gives."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    score = lambda: {r.doc_id: r.score for r in M.score_texts(docs, block_bytes=30_000).collect()}
    monkeypatch.setattr(M, "PART_BYTES", 20_000)
    once = score()
    monkeypatch.setattr(M, "FAN", 3)
    sent, learn = [], M._learn_words
    monkeypatch.setattr(M, "_learn_words", lambda parts: (sent.append(parts), learn(parts))[1])
    levels = score()
    assert sent == [3] and len(once) == len(levels) == docs.count()
    assert all(abs(once[i] - levels[i]) < 1e-6 for i in once)


def test_rows_grow_with_the_blocks(spark):
    """Keys of 8, 16 and 32 blocks over 64 parts with a fan of 4: rows of all levels for each block."""
    import numpy as np
    rng = np.random.default_rng(0)
    made, settle = {}, M.settle
    for n in (8, 16, 32):
        rows, want = [], collections.Counter()
        blocks = {b: np.unique(np.append(rng.integers(0, 1 << 63, 400), 7 << 60)).astype(np.uint64) for b in range(n)}
        for b, keys in blocks.items():
            want.update(keys.tolist())
            part = M.part_of(keys, 4)
            for k in np.unique(part):
                mine = keys[part == k]
                rows.append((b, int(k), M._pack(np.diff(mine, prepend=np.uint64(0))),
                             M._pack(np.ones(len(mine), np.uint32))))
        df = spark.createDataFrame(rows, "block long, place long, keys binary, n binary")
        counted = []

        def told(d, name, codec="snappy"):
            out = settle(d, name, codec)
            counted.append(out.count())
            return out
        M.settle = told
        try:
            got = M.answered(df, 4, 64, n, 4).collect()
        finally:
            M.settle = settle
        made[n] = (len(rows) + sum(counted)) / n
        every = np.array(sorted(want), np.uint64)
        odds = dict(zip(every.tolist(), M.path_odds(every, np.array([want[k] for k in every.tolist()]))))
        for r in got:
            keys = blocks[r.block][M.part_of(blocks[r.block], 4) == r.place]
            mine = np.frombuffer(r.odds, np.int8).reshape(M.BITS, -1).T
            assert (mine == np.array([odds[k] for k in keys.tolist()])).all()
        assert len(got) == len(rows)
    assert len(counted) == 2 and max(made.values()) <= 4 * 3 and made[32] <= made[8] * 1.2


def test_two_words_before_tell_the_next(spark):
    """Words with one ending that follow from the two before, and not from one."""
    rng = np.random.default_rng(4)
    names, follows = [f"{i}xx" for i in range(200)], rng.integers(0, 200, (200, 200))

    def text():
        w = rng.integers(0, 200, 2).tolist()
        for _ in range(400):
            w.append(int(follows[w[-2], w[-1]]) if rng.random() < 0.8 else int(rng.integers(200)))
        return " ".join(names[i] for i in w)
    docs = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string")
    held = [r for r in M.score_texts(docs.repartition(2), block_bytes=1 << 20).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)


def test_held_out_gain_on_more_documents(spark):
    got = M.score_texts(table(spark, "/root/testdata/sf0.1", "documents")).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_disk_of_a_run(spark, tmp_path, monkeypatch):
    """What is settled holds no keys, and keys and answers are small on their way."""
    kept, settle = {}, M.settle

    def told(d, name, codec="snappy"):
        kept[name] = settle(d, name, codec)
        return kept[name]
    monkeypatch.setattr(M, "settle", told)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    docs = docs.filter("length(text) > 0")
    text = docs.selectExpr("sum(octet_length(text))").first()[0]
    sent, answered = [], M.answered
    monkeypatch.setattr(M, "answered", lambda keyed, *a, **k: (
        sent.append(keyed), sent.append(answered(keyed, *a, **k)), sent[-1])[2])
    assert M.score_texts(docs).count() == docs.count()
    assert "keys" not in kept["learned"].columns
    keys = sent[0].selectExpr("sum(octet_length(keys) + octet_length(n))").first()[0]
    odds = sent[1].selectExpr("sum(octet_length(odds))").first()[0]
    assert keys + odds < 2.2 * text


def test_answers_tell_each_node_once():
    """Answers are whole again where the keys are known, and take about a byte a key."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 44, 30_000).astype(np.uint64)
    every = np.unique(hashes[rng.zipf(1.3, 300_000) % 30_000] << np.uint64(12)
                      | (rng.zipf(1.5, 300_000) % 4096).astype(np.uint64))
    odds = M.path_odds(every, rng.zipf(1.6, len(every)) % 1000)
    mine = np.sort(rng.choice(every, len(every) // 2, replace=False))
    want = odds[np.searchsorted(every, mine)]
    cut = len(mine) // 3
    cells = pa.array([M._odds_cell(want[a:b].T, mine[a:b], True) for a, b in ((0, cut), (cut, cut), (cut, len(mine)))],
                     pa.binary())
    assert (M._odds_of(cells, mine) == want).all()
    assert sum(len(x.as_buffer()) for x in cells) < 0.8 * len(M._packed(towards(want, mine)))


def towards(odds, keys):
    """What was sent before: the log-odds of all bits of every key, as those of the key's own bits."""
    bit = keys[:, None] >> np.arange(M.BITS - 1, -1, -1).astype(np.uint64) & np.uint64(1)
    return np.where(bit == 1, odds, -odds).tobytes()


def test_words_travel_in_cells(spark, monkeypatch):
    """No row a word is written, and counts reached level by level are those of all texts."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    kept, settle = {}, M.settle

    def told(d, name, codec="snappy"):
        kept.setdefault(name, []).append(settle(d, name, codec))
        return kept[name][-1]
    monkeypatch.setattr(M, "settle", told)
    monkeypatch.setattr(M, "PART_BYTES", 20_000)
    monkeypatch.setattr(M, "FAN", 3)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(M.score_texts(docs, block_bytes=30_000).collect(), rows)
    blocks = kept["blocks"][0].count()
    assert len(kept["merged"]) >= 4           # levels of words and of keys
    assert "word" not in kept["learned"][0].columns and kept["merged"][0].count() <= 9 * blocks
    assert kept["counts"][0].filter("block is null").selectExpr("sum(total)").first()[0] == sum(
        len(tokens(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1)


def test_packed_numbers_are_whole():
    """Numbers come back as they were; steps between keys that share contexts take less than as bytes alone."""
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 44, 20_000).astype(np.uint64)
    keys = np.unique(hashes[rng.integers(0, 20_000, 60_000)] << np.uint64(20)
                     | rng.integers(0, 4096, 60_000).astype(np.uint64))
    steps = np.diff(keys, prepend=np.uint64(0))
    for a, kind in ((steps, "u8"), (steps[:0], "u8"), (np.array([0, 4095, 4096, 2 ** 63], np.uint64), "u8"),
                    (np.arange(9), "i8"), (rng.integers(0, 2 ** 32, 77).astype(np.uint32), "u4")):
        assert (M._unpack(M._pack(a), kind) == a).all() and len(M._unpack(M._pack(a), kind)) == len(a)
    plain = np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T).tobytes()
    assert len(M._pack(steps)) < 0.95 * len(M._packed(plain))


def test_blocks_do_not_travel(spark, monkeypatch):
    """What is settled and shuffled of a block is its number; its texts are in a file."""
    kept, settle = {}, M.settle
    monkeypatch.setattr(M, "settle", lambda d, name, codec="snappy": kept.setdefault(name, settle(d, name, codec)))
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = M.score_texts(docs, block_bytes=100_000)
    assert got.count() == docs.count()
    assert kept["blocks"].columns == ["block", "uri", "n_bytes"] and kept["blocks"].count() > 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapCoGroupsInArrow" not in plan
