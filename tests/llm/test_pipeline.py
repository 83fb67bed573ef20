import corpus_pipeline
import sentencepiece
from proofmill.llm import language, pieces

from . import test_decontaminate, test_minhash

SF = "/root/testdata/sf0.001"


def cut(docs):
    """Brute-force removal of repeated strings of 100 bytes; wholly removed texts go."""
    seen, out = set(), []
    for d, text in sorted(docs, key=lambda r: r[0]):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(t[k : k + 100])
        if not t or not all(gone):
            out.append((d, bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore") if any(gone) else text))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in language.identify(docs, language.learn(language.training(docs))).filter("rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    kept = {r[0] for r in test_minhash.brute(rows, 5) if r[3]}
    rows = cut([r for r in rows if r[0] in kept])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in test_decontaminate.brute(rows, items) if r[5]}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {d: None if t is None else model.encode(t) for d, t in rows if d not in dirty}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) > 20


def test_stages_keep_columns_and_bear_nulls(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "the same words in a row here " * 9, None, None, 3), (2, "the same words in a row here " * 9, None, None, 3)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
