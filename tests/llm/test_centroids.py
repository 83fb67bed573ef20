import hashlib
import math

import numpy as np
import pytest

from proofmill.llm import centroids


def brute(rows, k, rounds, dimension):
    kept = [(v, [math.floor(256 * float(x)) if abs(x) < 2**52 else int(x) * 256 for x in e], e) for v, e in rows if e is not None and len(e) == dimension and None not in e and all(map(math.isfinite, e))]
    starts = sorted((hashlib.sha256(f"2:{v}".encode()).hexdigest(), e, q) for v, q, e in kept if v is not None)
    centers = [q for _, _, q in starts[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda q: min((far(q, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, q, _ in kept:
            groups.setdefault(best(q)[1], []).append(q)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    out, fits = [(v, *best(q)[::-1]) for v, q, _ in kept], lambda x: x if x is not None and x < 1 << 63 else None
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d if fits(d) is not None and inertia.get(j, 0) is not None else None
    total = None if None in inertia.values() else sum(inertia.values())
    return sorted(((v, j, fits(d), fits(inertia[j]), fits(total), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for v, j, d in out), key=str)


def run(spark, rows, k, rounds, dimension, kind="float"):
    frame = spark.createDataFrame([(*r, 9) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int").repartition(3)
    return sorted((tuple(r) for r in centroids.report(*centroids.cluster(frame, k, rounds, 256, dimension)).collect()), key=str)


@pytest.mark.parametrize("leaf, tree", [(2, 64), (32, 8192)])
def test_brute(spark, monkeypatch, leaf, tree):
    monkeypatch.setattr(centroids, "LEAF", leaf)
    monkeypatch.setattr(centroids, "TREE", tree)
    rng = np.random.default_rng(3)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(k, f(rng.integers(0, 4, 8) + 0.1 * rng.standard_normal(8))) for k in range(300)]
    rows += [(1000 + k, f([0.5] * 8)) for k in range(60)] + [(7, f([0.25] * 8)), (7, f([0.25] * 8)), (None, f([0.1] * 8)), (None, None)]
    rows += [(2000, [0.0] * 7), (2001, []), (2002, [float("nan")] + [0.0] * 7), (2003, [float("-inf")] + [0.0] * 7), (2004, [None] + [0.0] * 7), (2005, f([-1e-30] * 8))]
    assert run(spark, rows, 12, 5, 8) == brute(rows, 12, 5, 8)


def test_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.standard_normal(4) * 10.0 ** (k % 8 * 5)).tolist()) for k in range(120)] + [(900, [1e306, -1e306, 0.0, 1.0])]
    assert run(spark, rows, 10, 3, 4, "double") == brute(rows, 10, 3, 4)


def test_few_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [9.0, 9.0])]
    assert run(spark, rows, 40, 5, 2) == brute(rows, 40, 5, 2)
    assert run(spark, [], 40, 5, 2) == [] and run(spark, [(1, [1.0])], 40, 5, 2) == []


def test_filter_is_exact_and_prunes():
    rng = np.random.default_rng(8)
    centers = rng.integers(-1000, 1000, (20, 6)).tolist()
    points = np.repeat(np.array(centers, np.float64), 100, axis=0) + rng.integers(-30, 30, (2000, 6))
    points = points[centroids.kd_order(points)]
    label, whole = np.zeros(len(points), int), 0
    for a, b, cluster, sums in centroids.filtered(points, centers):
        label[a:b] = cluster
        if sums is not None:
            whole += b - a
            assert (sums == points[a:b].sum(axis=0)).all()
    far = ((points[:, None, :] - np.array(centers)[None]) ** 2).sum(axis=2)
    assert (label == far.argmin(axis=1)).all() and whole > 1000


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((tuple(r) for r in centroids.query(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows, 40, 5, 64)
