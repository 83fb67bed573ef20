import hashlib
import re

import pytest

from proofmill.llm import mixing
from proofmill.llm.common import Scratch
from proofmill.llm.prefix import running


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights, most):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), sum(sizes.values())
    while free and left > 1e-9:
        total, over = sum(weight[s] for s in free), left
        for s in list(free):
            target[s] += over * weight[s] / total
        left = 0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def brute(rows, weights=(1, 2, 3), most=3, seed=0):
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target, out = brute_targets(sizes, weights, most), []
    for s in sizes:
        key = lambda r: (int(hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, words(r[2]))
        at = 0
        for d, _, t in sorted((r for r in rows if r[1] == s), key=key):
            n, budget = words(t), int(target[s] + 1e-6)
            epochs = budget // sizes[s] if sizes[s] else 0
            out.append((d, n, sizes[s], round(target[s], 3), epochs * n + min(n, max(0, budget - epochs * sizes[s] - at))))
            at += n
    return sorted(out, key=str)


ROWS = [(k, f"s{k % 7}" if k % 11 else None, " ".join(["wé"] * (k * k % 37))) for k in range(400)]
ROWS += [(1000, "tiny", "one"), (1001, "tiny", "two still two"), (1002, "", "a\tb\nc"), (1003, "none", None), (1003, "none", ""), (None, "s1", "x y"), (None, "s1", "x y")]
ROWS += [(2000, "s2", "same words again")] * 50


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, size int")


def got(out):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in out.collect()), key=str)


def test_brute(spark):
    assert got(mixing.mix(frame(spark, ROWS).repartition(5))) == brute(ROWS)


def test_rules(spark):
    rows = mixing.mix(frame(spark, ROWS)).collect()
    again = mixing.mix(frame(spark, ROWS[::-1]).repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by = {}
    for r in rows:
        assert r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(t - 1 < n <= t for t, n in by.values())
    total = sum(words(r[2]) for r in ROWS)
    assert abs(sum(t for t, _ in by.values()) - total) < 1e-6


@pytest.mark.parametrize("weights, most", [((1, 2, 3), 3), ((1,), 1), ((5, 1), 2)])
def test_targets(spark, weights, most):
    sizes = {f"x{k}": (k * 7919) % 1000 for k in range(40)} | {None: 4}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    scratch = Scratch(spark)
    found = {r.source: r.target for r in mixing.levels(scratch, scratch.keep(rows), None, weights, most).collect()}
    assert found == pytest.approx(brute_targets(sizes, weights, most))


def test_no_words(spark):
    rows = [(1, "a", ""), (2, None, None)]
    assert got(mixing.mix(frame(spark, rows))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mix(frame(spark, [])).count() == 0


def test_texts(spark):
    rows = [(k, f"s{k % 3}", f" {k} " + "w " * k) for k in range(30)]
    plan = {(r.source): [] for r in mixing.mix(frame(spark, rows)).collect()}
    for r in mixing.mix(frame(spark, rows)).collect():
        plan[r.source].append(r)
    texts = mixing.mixed_texts(frame(spark, rows)).collect()
    for s, of in plan.items():
        assert sum(words(t.text) for t in texts if t.source == s) == sum(r.taken for r in of)
    whole = {d: t for d, _, t in rows}
    assert sum(t.text != whole[t.doc_id] for t in texts) <= len(plan)


def test_running(spark):
    """One group over many tasks, rows that are alike, and groups of one row."""
    rows = [("hot", 1, k % 5) for k in range(3000)] + [(f"g{k}", 0, k) for k in range(500)] + [(None, k, 2) for k in range(100)]
    scratch = Scratch(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = scratch.keep(spark.createDataFrame(rows, "g string, o int, v long").repartition(6))
        out = running(scratch, table, ["g"], ["o"], "v", "before")
        found = [(r.g, r.o, r.v, r.before) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(rows)
    hot = sorted((b, v) for g, _, v, b in found if g == "hot")
    assert sum(v for _, v in hot) == hot[-1][0] + hot[-1][1] and all(b + v <= c for (b, v), (c, _) in zip(hot, hot[1:]))
    assert all(b == 0 for g, _, _, b in found if g and g != "hot")
    assert sorted((o, b) for g, o, _, b in found if g is None) == [(k, 2 * k) for k in range(100)]
