import numpy as np

from proofmill.llm import vectors


def brute(rows):
    good = [v is not None and l is not None and len(v) and None not in v and np.isfinite(v).all() and any(v) for _, v, l in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for g, (_, v, _) in zip(good, rows)]
    top, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                top[find(i)] = find(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, n, low.get(find(i)), d == low.get(find(i))) for i, ((d, _, _), n) in enumerate(zip(rows, links))]


key = lambda r: tuple(map(str, r))


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(64)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(1, None, 1), (2, [0.0] * 64, 1), (3, f(base), None), (4, [float("nan")] + [1.0] * 63, 1), (5, [None] + [1.0] * 63, 1), (6, [], 1), (7, [float("inf")] + [1.0] * 63, 1), (8, f(base), 2), (9, f(base), 1), (9, f(base), 1), (None, f(base), 1), (10, f(base[:8]), 1), (11, f(1e3 * base), 1)]
    rows += [(100 + k, f(base + 0.05 * rng.standard_normal(64)), 1) for k in range(60)]
    rows += [(200 + k, f(rng.standard_normal(64)), 1) for k in range(60)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = [tuple(r) for r in vectors.near_duplicates(frame).collect()]
    want = [(d, n, c, k) for d, n, c, k in brute(rows)]
    assert sorted(got, key=key) == sorted([(d, n, c, k or (d is None and c is None)) for d, n, c, k in want], key=key)


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        base = rng.standard_normal(64)
        for k in range(6):
            rows.append((len(rows), (base + 0.1 * (1 + k % 2 / 2) * rng.standard_normal(64)).tolist(), g % 3))
    got, want = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect(), brute(rows)
    got, total = {r.vec_id: r for r in got}, sum(r[1] for r in want)
    assert total > 500 and sum(r.n_links for r in got.values()) >= 0.98 * total
    assert all(got[d].n_links <= n for d, n, _, _ in want)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in vectors.query(spark, "/root/testdata/sf0.001").collect()), key=key) == sorted(brute(rows), key=key)
