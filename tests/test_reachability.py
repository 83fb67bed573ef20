import random

import pytest
from proofmill.operators import sessions
from proofmill.plans import durable, reachability


def brute(places, edges):
    """All pairs (a, b) of events where a is earlier, by search."""
    at = {}
    for e, c, p in places:
        at.setdefault(c, []).append((p, e))
    after = {e: set() for e, _, _ in places}
    for v in at.values():
        v.sort()
        for (_, a), (_, b) in zip(v, v[1:]):
            after[a].add(b)
    for a, b in edges:
        if a in after and b in after:
            after[a].add(b)
    out = set()
    for e in after:
        open_, seen = list(after[e]), set()
        while open_:
            x = open_.pop()
            if x not in seen:
                seen.add(x)
                open_ += after[x]
        out |= {(e, x) for x in seen}
    return out


@pytest.mark.parametrize("seed, jumps", [(1, 6), (2, 25), (3, 0)])
def test_labels(spark, seed, jumps):
    rng = random.Random(seed)
    places = [(c * 100 + p, c, p) for c in range(6) for p in range(rng.randint(1, 9))]
    edges = [(rng.choice(places)[0], rng.choice(places)[0]) for _ in range(jumps)] + [(0, 1), (0, 7777)]
    frame, links = spark.createDataFrame(places, "event_id long, chain long, place long"), spark.createDataFrame(edges, "src long, dst long")
    pairs = [(a, *x[1:], b, *y[1:]) for x in places for y in places for a, b in [(x[0], y[0])]]
    rows = spark.createDataFrame(pairs, "a long, a_chain long, a_place long, b long, b_chain long, b_place long")
    got = reachability.earlier(rows, reachability.labels(frame, links), "a", "b").collect()
    assert {(r.a, r.b) for r in got if r.earlier} == brute(places, edges) and len(got) == len(pairs)


def test_long_relay(spark):
    """A way over sixty chains takes a few rounds."""
    places = [(c * 10 + p, c, p) for c in range(60) for p in range(3)]
    edges = [(c * 10 + 1, c * 10 + 11) for c in range(59)]
    known = reachability.labels(spark.createDataFrame(places, "event_id long, chain long, place long"), spark.createDataFrame(edges, "src long, dst long"))
    assert known.filter("chain = 0 and to_chain = 59").first().earliest == 1 and known.count() == 59 * 60 // 2


def test_counted_pairs(spark):
    places = [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 2, 0), (6, 2, 1)]
    edges = [(1, 2), (2, 3), (3, 4), (3, 2), (5, 6)]
    got = sessions.reached(spark.createDataFrame(places, "event_id long, chain long, place long"), spark.createDataFrame(edges, "src long, dst long")).collect()
    want = {c: sum(a // 1 in e and b in e for a, b in brute(places, edges)) for c, e in {1: {1, 2, 3, 4}, 2: {5, 6}}.items()}
    assert {r.root_id: (r.n_pairs, r.cyclic) for r in got} == {1: (want[1], True), 2: (want[2], False)}


NODE = "root_id long, snapshot_id long, native_offset long, event_id long, stream_seq long, event_type string, call_id long, chunk_no long, actor_kind string, actor_id long, owner_id long, text string, loss string, marker string, is_child boolean, claim_bearing boolean"


def event(root, at, kind="message", call=None, chunk=None, child=False):
    return (root, 0, at, root * 100 + at, at, kind, call, chunk, "user", 1, 1, "t", None, None, child, False)


def family(*more):
    nodes = [event(1, k) for k in range(6)] + [event(2, k, child=True) for k in range(3)]
    return nodes, [(2, 102, 200, "spawned-by", "internal"), (2, 202, 104, "joined", "internal"), *more]


@pytest.mark.parametrize("change, reasons", [(None, 0), ((2, 202, 104, 101), 2), ((2, 202, 104, 102), 2), ((2, 202, 104, 103), 0), ((2, 202, 104, 999), 2)])
def test_a_child_returns_after_its_spawn(spark, change, reasons):
    nodes, edges = family()
    if change:
        edges[1] = (2, 202, change[3], "joined", "internal")
    got = sessions.quarantine(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "root_id long, src long, dst long, edge_type string, ref_state string")).collect()
    assert {r.root_id: r.quarantined for r in got}[2] is (reasons > 0)


def test_descendants(spark):
    """A chain of a thousand edges, a fork, a join, a cycle and a seed inside a chain."""
    edges = [(k, k + 1) for k in range(1000)] + [(1000, 2000), (1000, 2001), (2000, 2002), (2001, 2002), (2002, 2003)]
    edges += [(3000, 3001), (3001, 3002), (3002, 3000), (4000, 4001), (4001, 4002), (4002, 4001), (5000, 5001)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = durable.descendants(frame, spark.createDataFrame([(700,), (3001,), (4000,), (9999,)], "node long"))
    want = {*range(700, 1001), 2000, 2001, 2002, 2003, 3000, 3001, 3002, 4000, 4001, 4002, 9999}
    assert sorted(r.node for r in got.collect()) == sorted(want)


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    from proofmill.plans.durable import looked_up
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(400).selectExpr("id AS node", "CASE WHEN id % 100 = 1 THEN id - 1 END AS up")
        got = looked_up(rows, "up", "node", spark.range(400).selectExpr("id AS up", "id AS top"))
        assert {r.node: (r.up, r.top) for r in got.collect()} == {k: ((k - 1,) * 2 if k % 100 == 1 else (None, None)) for k in range(400)}
        shares = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) > 1 and max(shares) < 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
