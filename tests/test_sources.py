import pytest
from proofmill.sources import generations, jsonl


def test_jsonl(spark, tmp_path):
    path, schema = str(tmp_path / "rows"), "schema_version string, id long, note string"
    jsonl.write(spark.createDataFrame([("1", 1, None), ("1", 2, "x")], schema), path)
    jsonl.write(spark.createDataFrame([("1", 3, "y")], schema), path)
    assert sorted(r.id for r in jsonl.read(spark, path, schema).collect()) == [1, 2, 3]
    jsonl.write(spark.createDataFrame([("9", 4, "z")], schema), path)
    with pytest.raises(Exception, match="unsupported schema version 9"):
        jsonl.read(spark, path, schema).collect()
    (tmp_path / "bad").write_text('{"schema_version": "1", "id": "many"}\n')
    with pytest.raises(Exception):
        jsonl.read(spark, str(tmp_path / "bad"), schema).collect()


def test_generations(spark, tmp_path):
    root = str(tmp_path / "root")
    one, two = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id long, v string"), spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    first = generations.publish(spark, root, {"t": one})
    assert generations.publish(spark, root, {"t": one.repartition(3)}) == first
    second = generations.publish(spark, root, {"t": two})
    assert second != first and generations.current(spark, root, "t").count() == 2
    assert generations.publish(spark, root, {"t": one}) == first and generations.current(spark, root, "t").count() == 3
    assert generations.commits(spark, root).count() == 4


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, "draft"), ("a", 2, "exported"), ("b", 1, "draft")], "k string, seq long, state string")
    assert sorted((r.k, r.state) for r in generations.latest(rows, ["k"], "seq").collect()) == [("a", "exported"), ("b", "draft")]
