import duckdb
import pytest

from proofmill.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_oracle_links_vectors():
    """The tables hold no near vectors, so the SQL is tried on some that are."""
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings AS SELECT * FROM (VALUES (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.25], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, NULL, 1), (7, [1.0, 0.0], NULL), (8, [2.0, 'nan'::FLOAT], 1)) v(vec_id, embedding, label)")
    got = sorted(con.execute(queries.ORACLES["op4_embedding_dedup"]).fetchall())
    assert got == [(1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)]
