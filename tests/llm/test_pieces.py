import random

import pytest
import sentencepiece

from proofmill.llm import pieces


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


TEXTS = [None, "", " ", "   ", "hello world", " leading", "trailing ", "two  spaces   three", "tab\tnew\n\nline", "日本語 テキスト", "😀 emoji 👩‍👩‍👧", "Ünïcode façade", "nul\0byte", "a▁b", "x" * 3000, "abab" * 2000, "<s> </s> <unk> <0x41>", "1234567890 3.14159", "é", "def f(x):\n    return x"]


def test_cases(spark, model):
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS + TEXTS[4:6])], "doc_id long, text string, ids int")
    encoded = pieces.encode(frame)
    got = {r.doc_id: r for r in encoded.collect()}
    for k, t in enumerate(TEXTS):
        assert got[k].ids == (None if t is None else model.encode(t)), t
        assert got[k].round_trip == (None if t is None else "▁" not in t), t
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert all(back[k] == (t and t.replace("▁", " ")) for k, t in enumerate(TEXTS))


def test_words_of_all_lengths(model, monkeypatch):
    rng = random.Random(4)
    letters = "abcdeéß日本😀 \n_0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += ["".join(rng.choice("ab") for _ in range(k)) for k in (1, 127, 128, 129, 5000)] + ["of the " * 3000, "x" * 20_000]
    vocabulary = pieces.Vocabulary()
    monkeypatch.setattr(pieces, "BLOCK", 1000)
    monkeypatch.setattr(pieces, "TOGETHER", 500)
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    encoder = pieces.Encoder(vocabulary)
    for k in range(0, len(texts), 7):
        ids, count = encoder.encode(texts[k : k + 7])
        want = [model.encode(t) for t in texts[k : k + 7]]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_empty(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, model):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: None if r.text is None else model.encode(r.text) for r in docs.collect()}
    got = pieces.encode(docs).collect()
    assert len(got) == len(want) and all(r.ids == want[r.doc_id] for r in got)
    assert pieces.query(spark, sf).filter("not round_trip").count() == 0
