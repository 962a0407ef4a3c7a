import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexispark.llm import token_blocks as B
from lexispark.sources.tables import table


def starts(size):
    return np.cumsum(size) - size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2 ** 32 - 1)), min_size=1, max_size=700),
       st.sampled_from([0.0, 50.0, 90.0, 100.0]))
def test_blocks_round_trip(ids, percentile):
    raw, size = B.pack(np.array(ids), percentile)
    assert B.unpack(raw, starts(size))[:len(ids)].tolist() == ids


def test_outliers_go_to_the_exception_list():
    ids = np.arange(256) % 8 + 1000
    ids[[5, 200]] = 49_000
    raw, size = B.pack(ids)
    assert size.tolist() == [B.HEAD + 16 * 3 + 5] * 2        # 3 bits, one exception each
    assert B.unpack(raw, starts(size)).tolist() == ids.tolist()


def odd_texts():
    rng = random.Random(1)
    letters = "abcDEÉé'sSt.,!?0 1\n\t\x1c\xa0日本<|endoftext|>Ⅳ´̈Å🙂İKΣς"
    return ["", " ", "<|endoftext|>", "a<|ENDOFTEXT|>b A<|endoftext|>C don't DON'T we'll",
            "x ", None] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]


def test_words_encode_as_whole_texts():
    with open(B.default_tokenizer(), encoding="utf-8") as f:
        coder = B.WordEncoder(f.read())
    assert coder.by_word
    ids, n = coder.batch(odd_texts(), 1)
    want = [x.ids + [1] for x in coder.t.encode_batch(
        [t or "" for t in odd_texts()], add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def brute(rows, path, end=1):
    t, at, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [1 << 14, 1 << 30])
def test_given_data_equals_brute_force(spark, file_bytes):
    docs = table(spark, "/root/testdata/sf0.001", "documents").repartition(5)
    files = B.write_tokens(docs, file_bytes=file_bytes)
    assert files.count() > 1 or file_bytes > 1 << 20
    got = sorted(map(tuple, B.read_tokens(files).collect()))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()],
                        B.default_tokenizer())


def test_tokenizer_that_keeps_spaces_gets_whole_texts(spark):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "two  words"), (2, " x\ny"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, B.read_tokens(B.write_tokens(docs, tokenizer=path)).collect()))
    assert got == brute(rows, path)


def test_long_texts_are_read_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(B, "CHUNK", 4)
    docs = spark.createDataFrame([(2, "a b c " * 3000), (1, "x"), (3, None)],
                                 "doc_id long, text string").coalesce(1)
    with open(B.default_tokenizer(), encoding="utf-8") as f:
        coder = B.WordEncoder(f.read())
    import pyarrow as pa
    import tempfile
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()])
    with tempfile.TemporaryDirectory() as d:
        told = {}
        with open(f"{d}/x.tok", "wb") as f:
            f.writelines(B.file_parts([batch], coder, 1, 90.0, told))
        got = [(i, np.concatenate(p).tolist(), len(p)) for i, p in B.read_documents(f"{d}/x.tok")]
        with open(f"{d}/x.tok", "r+b") as f:
            f.truncate(100)
        with pytest.raises(ValueError):
            list(B.read_documents(f"{d}/x.tok"))
    assert [i for i, *_ in got] == [2, 1, 3] and max(n for *_, n in got) > 2
    assert got[0][1] == coder._encode("a b c " * 3000) + [1]


def test_edges(no_docs, odd_docs, clash):
    assert B.read_tokens(B.write_tokens(no_docs)).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in B.read_tokens(B.write_tokens(clash(odd_docs))).collect()),
                 key=lambda r: r[1])
    assert got == brute(rows, B.default_tokenizer())
