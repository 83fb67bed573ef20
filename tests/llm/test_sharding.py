import zlib
from collections import Counter

import pytest

from proofmill.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 5000])
def test_permutation_matches_its_sql_form(spark, n):
    want = [sharding.permute(i, n, 5) for i in range(n)]
    assert sorted(want) == list(range(n))
    assert [r[0] for r in spark.range(n).select(sharding.permuted("id", n, 5)).collect()] == want


def check(rows, texts, n_shards):
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min([counts.get(s, 0) for s in range(n_shards)]) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert sorted(r.row_number for r in rows) == list(range(len(texts)))
    for r in rows:
        assert sharding.place_of(r.row_number, len(rows), n_shards) == (r.shard, r.slot)


def test_cases(spark):
    texts = [(i, "é" * (i % 5)) for i in range(90)] + [(None, "a"), (None, None), (3, "x"), (3, "x"), (3, "x"), (200, "long" * 100_000)]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, shard string")
    rows = sharding.shard(df, 7).collect()
    check(rows, texts, 7)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    again = sharding.shard(df.repartition(3), 7).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows)


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = sharding.query(spark, d).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(40) for k in range(counts[s])]


def test_a_table_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 100)
    texts = [(7, "same")] * 1234 + [(8, "same")] * 100 + [(9, "same")] * 101 + [(k, "x") for k in range(10, 40)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), 11).collect()
    check(rows, texts, 11)
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts)
