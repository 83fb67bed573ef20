import datetime as dt

from proofmill.streaming import ingest, timers

T = dt.datetime(2024, 1, 1)


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).drop("batch").collect())


def test_runs_repeat_nothing(spark, tmp_path):
    source, sink, at = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))
    put = lambda data: spark.createDataFrame(data, "id long, v string").coalesce(1).write.mode("append").parquet(source)
    go = lambda: ingest.run(spark, source, "id long, v string", sink, at, ["id"])
    put([(1, "a"), (2, "b"), (2, "b")])
    go()
    assert rows(spark, sink) == [(1, "a"), (2, "b")]
    go()
    assert rows(spark, sink) == [(1, "a"), (2, "b")]
    put([(2, "b"), (0, "late")])
    go()
    assert rows(spark, sink) == [(0, "late"), (1, "a"), (2, "b")]


def test_transitions():
    assert ingest.stepped("INIT", "", "start_discover") == ("SCOUT", "")
    assert ingest.stepped("COMPILE", "", "pause") == ("SUSPENDED", "COMPILE")
    assert ingest.stepped("SUSPENDED", "COMPILE", "resume") == ("COMPILE", "")
    assert ingest.stepped("SUSPENDED", "COMPILE", "cancel") == ("CANCELLED", "COMPILE")
    assert ingest.stepped("SUSPENDED", "COMPILE", "pause") is None and ingest.stepped("CANCELLED", "", "cancel") is None
    assert ingest.stepped("AUTH_STALE", "COMPILE", "authority_renewed", "EXTRACT") == ("EXTRACT", "")
    assert ingest.stepped("INIT", "", "passed") is None and ingest.stepped("DONE", "", "pause") is None


def test_tasks_as_a_stream(spark, tmp_path):
    source, sink, at = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))

    def go(data):
        spark.createDataFrame(data, "task_id long, seq long, event string").coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema("task_id long, seq long, event string").parquet(source)
        ingest.tasks(events).writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(sink).awaitTermination()
        return rows(spark, sink)

    first = go([(1, 0, "start_discover"), (1, 1, "search_done"), (2, 0, "passed"), (3, 0, "start_distill"), (3, 2, "content_granted")])
    assert first == [(1, 0, "SCOUT", "ok"), (1, 1, "SOURCE_REVIEW", "ok"), (2, 0, "INIT", "illegal"), (3, 0, "SOURCE_REVIEW", "ok"), (3, 2, "SOURCE_REVIEW", "gap")]
    second = go([(1, 1, "search_done"), (1, 2, "pause"), (1, 3, "resume"), (1, 4, "all_rejected"), (1, 5, "pause")])
    assert sorted(set(second) - set(first)) == [(1, 2, "SUSPENDED", "ok"), (1, 3, "SOURCE_REVIEW", "ok"), (1, 4, "DONE_PARTIAL", "ok"), (1, 5, "DONE_PARTIAL", "illegal")]


def test_late(spark):
    got = ingest.late(spark.createDataFrame([(1, 3), (4, 3), (3, 3)], "seq long, watermark long")).collect()
    assert [r.run for r in got] == ["now", "next", "now"]


def test_the_ledger_is_bounded(spark, tmp_path):
    root = str(tmp_path / "root")
    lines = lambda n, edit=None: [("a", k, "x" if k == edit else f"l{k}") for k in range(n)]
    snap = lambda data: spark.createDataFrame(data, "source string, seq long, line string")
    said = lambda data, k: {r.source: r.status for r in ingest.take(spark, snap(data), root, k).collect()}
    assert said(lines(3) + [("b", 0, "p")], 0) == {"a": "new", "b": "new"}
    assert said(lines(5) + [("b", 0, "p")], 1) == {"a": "appended", "b": "same"}
    assert said(lines(5) + [("b", 0, "p")], 1) == {"a": "appended", "b": "same"}  # the batch again, after a crash
    assert said(lines(7, edit=2), 2) == {"a": "edited", "b": "shortened"}
    assert said([("a", 0, "l1"), ("a", 1, "l0"), *lines(6)[2:]], 3)["a"] == "edited"  # reordered
    assert said(lines(4), 4)["a"] == "shortened"
    assert said(lines(6), 5)["a"] == "appended"
    assert sorted((r.seq, r.line) for r in ingest.taken(spark, root).filter("source = 'a'").collect()) == [(k, f"l{k}") for k in range(6)]
    for k in range(6, 12):
        said(lines(6), k)
    assert ingest._ledger(spark, root, 99).count() == 2


def test_follow(spark, tmp_path):
    source, root, at = (str(tmp_path / n) for n in ("source", "root", "checkpoint"))
    put = lambda n: spark.createDataFrame([("a", k, f"l{k}") for k in range(n)], "source string, seq long, line string").coalesce(1).write.mode("append").parquet(source)
    for n in (2, 5):
        put(n)
        ingest.follow(spark, source, "source string, seq long, line string", root, at)
    assert sorted(r.seq for r in ingest.taken(spark, root).collect()) == list(range(5))


def ms(seconds):
    return int((T + dt.timedelta(seconds=seconds)).timestamp() * 1000)


def test_timers_in_memory():
    task = timers.Task(None)
    got = [*task.take(0, "start_distill", None, ms(0)), *task.take(2, "all_snapshotted", None, ms(20)), *task.take(2, "all_snapshotted", None, ms(20)), *task.take(1, "content_granted", None, ms(10))]
    assert [(s, v) for s, _, _, v in got] == [(0, "ok"), (2, "waits"), (2, "seen"), (1, "ok"), (2, "ok")] and task.phase == "CAPABILITY_REVIEW"
    task = timers.Task(task.state())
    assert task.next() == ms(20 + timers.LEASE) and not list(task.expire(task.next() - 1))
    assert [e for _, e, _, _ in task.expire(task.next())] == ["lease_expired"] and task.phase == "CAPABILITY_REVIEW"
    assert task.next() == ms(10 + timers.GRANT)
    assert [(e, p) for _, e, p, _ in task.expire(task.next())] == [("grant_expired", "AUTH_STALE")]
    assert list(task.take(3, "authority_renewed", "INGEST", ms(90000)))[0][2] == "INGEST" and task.grant == ms(90000 + timers.GRANT)
    assert [p for _, _, p, _ in task.take(4, "cancel", None, ms(90001))] == ["CANCELLED"] and task.next() == ms(90001 + timers.RETENTION)


def test_timers_as_a_stream(spark, tmp_path):
    source, sink, at = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))
    schema, seen = "task_id long, seq long, event string, target string, ts timestamp, arrived timestamp", set()

    def go(*data):
        made = [(t, s, e, None, T + dt.timedelta(seconds=x[0]), T + dt.timedelta(seconds=x[-1])) for t, s, e, *x in data]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        out = timers.tasks(spark.readStream.schema(schema).parquet(source))
        out.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(sink).awaitTermination()
        new = set(rows(spark, sink)) - seen
        seen.update(new)
        return sorted(new)

    assert go((1, 0, "start_distill", 0), (1, 2, "all_snapshotted", 9), (2, 0, "start_distill", 0), (2, 1, "cancel", 1)) == [
        (1, 0, "start_distill", "SOURCE_REVIEW", "ok"), (1, 2, "all_snapshotted", "SOURCE_REVIEW", "waits"), (2, 0, "start_distill", "SOURCE_REVIEW", "ok"), (2, 1, "cancel", "CANCELLED", "ok")]
    assert go((1, 1, "content_granted", 5, 12)) == [(1, 1, "content_granted", "INGEST", "ok"), (1, 2, "all_snapshotted", "CAPABILITY_REVIEW", "ok")]
    # another task's events move the watermark: the lease ends, then the grant, then the evidence of both
    assert (1, 2, "lease_expired", "CAPABILITY_REVIEW", "timer") in go((3, 0, "start_distill", 2000))
    assert (1, 2, "grant_expired", "AUTH_STALE", "timer") in go((3, 1, "cancel", 100000))
    late = go((4, 0, "start_distill", 9 + timers.RETENTION), (4, 1, "cancel", 10 + timers.RETENTION))
    assert {(1, 2, "keep_expired", "AUTH_STALE", "timer"), (2, 1, "keep_expired", "CANCELLED", "timer")} <= set(late)
