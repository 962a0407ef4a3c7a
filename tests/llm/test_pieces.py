import random

import pytest
import sentencepiece

from lexispark.llm import pieces as P
from lexispark.sources.tables import table


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces as a unigram model: a path to it."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    m = proto.ModelProto()
    with open(P.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    rng = random.Random(0)
    for p in m.pieces:
        if p.type == 1:      # scores like log probabilities, without ties
            p.score = -2.0 * rng.random() - 8.0
    path = str(tmp_path_factory.mktemp("model") / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    return path


def texts():
    rng = random.Random(3)
    letters = "abcdeeeeiiinnoorsttt  ▁\n\tñé☃日本の語🙂AB01.,aaaa"
    return ["", " ", "a", "▁", "        x   ", "a" * 50, "aaaa " * 30, "\n\n x\n", "word" * 400] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]


def encoded(model, batch):
    coder = P.Encoder(model)
    ids, n = coder.batch(batch)
    out, at = [], 0
    for k in n:
        out.append(ids[at:at + k].tolist())
        at += k
    return out


def test_merge_model_equals_the_library(library):
    model = P.Pieces.load(P.default_model())
    got = encoded(model, texts())
    assert got == library.encode(texts())
    assert [model.decode(x) for x in got] == library.decode(got)


def test_unigram_model_equals_the_library(unigram):
    model = P.Pieces.load(unigram)
    assert not model.bpe
    want = sentencepiece.SentencePieceProcessor(model_file=unigram)
    for text, ids in zip(texts(), encoded(model, texts())):
        other = want.encode(text)
        if ids != other:                # equal sums: another best path
            score = lambda x: sum(model.scores[i] for i in x)
            assert abs(score(ids) - score(other)) < 1e-3
            assert model.decode(ids) == want.decode(other)


def test_given_data_equals_the_library(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    coded = P.decode(P.encode(docs)).select("text", "ids", "n_tokens", "decoded").collect()
    assert [r.ids for r in coded] == library.encode([r.text for r in coded])
    assert all(r.decoded == r.text and r.n_tokens == len(r.ids) for r in coded)


def test_batches_and_forgetting_change_nothing(monkeypatch):
    model = P.Pieces.load(P.default_model())
    whole = encoded(model, texts())
    monkeypatch.setattr(P, "KNOWN_WORDS", 50)
    monkeypatch.setattr(P, "CELLS", 64)
    monkeypatch.setattr(P, "PAIR_SLOTS", 256)
    coder, got = P.Encoder(model), []
    for a in range(0, len(texts()), 40):
        ids, n = coder.batch(texts()[a:a + 40])
        at = 0
        for k in n:
            got.append(ids[at:at + k].tolist())
            at += k
    assert got == whole


def test_text_pieces_cover_all_rows():
    import pyarrow as pa

    from lexispark.llm.common import text_pieces
    batch = pa.RecordBatch.from_pydict({"i": range(7), "t": ["a" * 3, None, "", "b" * 50, "c", "d" * 9, "e"]})
    for most in (1, 10, 1000):
        parts = list(text_pieces(batch, "t", most))
        assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(7))
    assert len(parts) == 1 and not list(text_pieces(batch.slice(0, 0), "t", 5))


def test_words_with_the_cutting_character(library):
    model = P.Pieces.load(P.default_model())
    odd = ["a\uffffb  c", "\uffff", "plain text"]
    assert encoded(model, odd) == library.encode(odd)


def test_edges(no_docs, odd_docs, clash):
    assert P.decode(P.encode(no_docs)).count() == 0
    both = P.encode(clash(odd_docs), decoded=True).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in both) and len(both) == 10
    got = P.decode(P.encode(clash(odd_docs)))
    assert dict(got.dtypes)["ids"] == "array<int>"
    for r in got.collect():
        assert r.decoded == (r.text or "").replace("▁", " ") and r.n_tokens == len(r.ids)
