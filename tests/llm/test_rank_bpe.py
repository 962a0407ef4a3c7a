import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexispark.llm import rank_bpe as B
from lexispark.llm.queries import op11_rank_bpe

LIBRARY = Tokenizer.from_file(B.default_tokenizer())
MODEL = B.Model.load(B.default_tokenizer())


def odd_texts():
    rng = random.Random(5)
    letters = "abcDEÉé'sSt.,!?0 1\n\t\x1c\x85\xa0　日本Ⅳ´̈Å🙂İKΣς͸"
    return ["", " ", None, "<|endoftext|>", "a<|ENDOFTEXT|>b A<|endoftext|>C<|startoftext|><|",
            "don't DON'T we'll x'sy ''s", "x ", "Ω" * 300 + "abc" * 200 + " !" + "?" * 5000,
            "ΑΣ ΟΔΟΣ", "a" * 128, "a" * 129] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]


def coded(coder, texts):
    ids, n = coder.batch(texts)
    return np.split(ids, np.cumsum(n)[:-1]) if len(texts) else []


def library(texts):
    return [x.ids for x in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_and_texts_equal_the_library():
    got = [x.tolist() for x in coded(B.Encoder(MODEL), odd_texts())]
    assert got == library(odd_texts())
    back = B.Decoder(MODEL).batch(np.array([i for x in got for i in x], np.int64),
                                  np.array([len(x) for x in got]))
    assert back.to_pylist() == LIBRARY.decode_batch(got, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, categories=("L", "N", "P", "Z", "M", "S"))),
                max_size=8))
def test_any_text_equals_the_library(texts):
    assert [x.tolist() for x in coded(B.Encoder(MODEL), texts)] == library(texts)


def by_hand(word: bytes) -> list[int]:
    """The merge of the lowest rank, the leftmost first, until there is none."""
    rank = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r)
            for k, r in zip(MODEL.pairs, MODEL.pair_rank)}
    parts = [int(MODEL.inner[b]) for b in word[:-1]] + [int(MODEL.final[word[-1]])]
    while True:
        best = min(((rank[p], j) for j, p in enumerate(zip(parts, parts[1:])) if p in rank),
                   default=None)
        if best is None:
            return parts
        parts[best[1]:best[1] + 2] = [int(MODEL.merged[best[0]])]


def test_scan_and_heap_give_the_merges_in_order():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"aeinorst\xc3\xa9") for _ in range(rng.randint(1, 128)))
             for _ in range(60)]
    scanned = MODEL.scan(words, 128)
    for w, row in zip(words, scanned):
        assert row[row >= 0].tolist() == by_hand(w) == MODEL.long_word(w).tolist()


def test_batches_and_forgetting_change_nothing(monkeypatch):
    whole = [x.tolist() for x in coded(B.Encoder(MODEL), odd_texts())]
    monkeypatch.setattr(B, "KNOWN_CHUNKS", 50)
    monkeypatch.setattr(B, "CELLS", 64)
    coder, got = B.Encoder(MODEL), []
    for a in range(0, len(odd_texts()), 40):
        got += [x.tolist() for x in coded(coder, odd_texts()[a:a + 40])]
    assert got == whole


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in op11_rank_bpe(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, text in rows.items():
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert got[i] == (i, len(ids), digest(" ".join(map(str, ids))),
                          digest(LIBRARY.decode(ids, skip_special_tokens=False)))


def test_edges(spark, no_docs, odd_docs, clash):
    assert B.encode(no_docs, decoded=True).count() == 0 and B.decode(B.encode(no_docs)).count() == 0
    both = B.encode(clash(odd_docs).withColumn("decoded", F.lit(1)), decoded=True)
    assert dict(both.dtypes)["ids"] == "array<int>"
    apart = B.decode(B.encode(clash(odd_docs)))
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    for r, s in zip(sorted(both.collect(), key=key), sorted(apart.collect(), key=key)):
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want == s.ids
        assert r.decoded == s.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    odd = spark.createDataFrame([(1, [320, 99_999, -1, 320]), (2, None), (3, [])],
                                "k long, ids array<int>")
    assert [r.decoded for r in B.decode(odd).orderBy("k").collect()] == ["a</w> a</w>", "", ""]


def test_other_tokenizers_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        B.Model.load(public_tokenizers.path("byte_bpe_50k.json"))
