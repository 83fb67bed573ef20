import random
import re

import numpy as np
import pyarrow as pa

from proofmill.llm import minhash


def brute(docs, size):
    sets = []
    for _, t in docs:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, len(s), low.get(find(i)), d == low.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))]


key = lambda r: tuple(map(str, r))


def test_cases(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (4, "One two"), (None, "one two"), (None, "alone here"), (6, "x " * 100_000), (7, "x x x x x x")]
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(120)] = f"n{rng.randrange(9)}"
        docs.append((100 + k, " ".join(words)))
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, kept string")
    for size in (4, 5):
        got = [tuple(r)[:4] for r in minhash.near_duplicates(frame, size).collect()]
        assert sorted(got, key=key) == sorted(brute(docs, size), key=key)
    kept = minhash.keep_first(frame)
    assert kept.columns == frame.columns
    want = sorted({r[0] for r in brute(docs, 5) if r[3] and r[0] is not None}) + [None]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "", "z")], "doc_id long, text string, one_row string").withColumnsRenamed({"one_row": "text_name"})
    frame = frame.selectExpr("*", "1 AS kept_id", "2 AS kept_name", "3 AS one_row", "4 AS _set", "5 AS set_id", "6 AS `odd.name`")
    kept = minhash.keep_first(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_of_structure(spark):
    """Words that polynomial hashes modulo a power of two confuse."""
    frame = spark.createDataFrame([(1, thue_morse(1024, 0)), (2, thue_morse(1024, 1))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame, 4).collect()) == [(1, 1), (2, 2)]


def test_signatures():
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 70_000, 3)]
    starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
    whole = minhash.signatures(np.concatenate(parts), starts)
    for k, part in enumerate(parts):
        low = [min((int(v) ^ int(s)) * int(f) % 2**64 for v in part[:5]) for s, f in zip(minhash._SEEDS, minhash._FACTORS)] if len(part) <= 5 else None
        assert (minhash.signatures(part, np.zeros(1, np.int64))[0] == whole[k]).all()
        if low:
            out = np.zeros(2 * minhash.SIDE, np.uint64)
            for r in range(minhash.ROWS):
                out = minhash.mix(out + np.array(low[r :: minhash.ROWS], np.uint64) + np.uint64(r + 1))
            assert (out == whole[k]).all()


def test_buckets_across_batches():
    rng = random.Random(8)
    rows = sorted((rng.randrange(30), k) for k in range(60))
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_pylist([{"key": a, "node": b, "items": 10 * b} for a, b in rows[k : k + size]]) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in minhash._buckets(iter(batches)) for r in b.to_pylist()]
        by = {}
        for a, b in rows:
            by.setdefault(a, []).append(b)
        assert got == [(a, b, 10 * b, by[a][0], 10 * by[a][0]) for a, b in rows if len(by[a]) > 1]


def test_partners_keep_every_similar_pair():
    rng = random.Random(6)
    common = list(range(100))
    sets = [set(rng.sample(common, rng.randrange(20, 100))) | {1000 * k + j for j in range(rng.randrange(12))} for k in range(60)]
    seen = {}
    for s in sets:
        for t in s:
            seen[t] = seen.get(t, 0) + 1
    by, found = {}, set()
    for k, s in enumerate(sets):
        order = sorted(s, key=lambda t: (seen[t], t))
        for place, t in enumerate(order[: len(s) - -(-80 * len(s) // 100) + 1]):
            by.setdefault(t, []).append((len(s), k, k % 50, place))
    for rows in by.values():
        items, node, root, place = (np.array(c) for c in zip(*sorted(rows)))
        for a, b in minhash.partners(node, root, items, place, 80):
            found |= set(zip(a.tolist(), b.tolist()))
    want = {(i, j) for j in range(60) for i in range(j) if i % 50 != j % 50 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want <= found and len(want) > 3 and all(i % 50 != j % 50 for i, j in found)


def test_recall_above_the_threshold(spark):
    rng = random.Random(11)
    docs, pairs = [], 300
    for k in range(pairs):  # one word replaced inside spoils four shingles: similarity 0.80 to 0.82
        words = [f"w{rng.randrange(10**9)}" for _ in range(115 + k % 8)]
        other = list(words)
        for at in (20, 50, 80):
            other[at] = f"v{rng.randrange(10**9)}"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()}
    want = {r[0]: r[2] for r in brute(docs[:8], 4)}
    assert all(want[d] == d - d % 2 for d in want)
    assert sum(got[2 * k + 1] == 2 * k for k in range(pairs)) >= 0.99 * pairs


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in minhash.query(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got, key=key) == sorted(brute(docs, 4), key=key)


def test_sets_take_their_parts_along(spark):
    """A set that is compared in several places is dealt from one row, so that sets need no shuffle by node."""
    n = minhash.SALT_ROWS + 1
    pairs = spark.range(2, n + 2).selectExpr("1L AS a", "id AS b").unionAll(spark.sql("SELECT 2L AS a, 3L AS b"))
    got = {r.node: [tuple(p) for p in r.parts] for r in minhash.parts(pairs).collect()}
    assert sorted(got) == list(range(1, n + 2)) and sorted(got[1]) == [(1, 0, None), (1, 1, None)]
    assert {p[::2] for p in got[3]} == {(1, 3), (2, 3)} and {p[::2] for p in got[2]} == {(1, 2), (2, None)}


def test_buckets_need_only_tables_of_shared_tuples(spark):
    rng, side = random.Random(4), minhash.SIDE
    often = [rng.randrange(1 << 60) for _ in range(3)]
    signs = {k: [rng.randrange(1 << 60) if rng.random() < 0.7 else rng.choice(often) for _ in range(2 * side)] for k in range(50)}
    want = {}
    for k, s in signs.items():
        for i in range(side):
            for j in range(side):
                want.setdefault((i, j, s[i], s[side + j]), []).append(k)
    frame = spark.createDataFrame([(k, np.array(s, np.uint64).tobytes(), 10 * k) for k, s in signs.items()], "node long, sign binary, items long")
    got = {}
    for r in minhash.buckets(minhash.Scratch(spark), frame).collect():
        got.setdefault(r.key, []).append((r.node, r.items, r.leader, r.na))
    want = sorted([(k, 10 * k, v[0], 10 * v[0]) for k in v] for v in want.values() if len(v) > 1)
    assert sorted(map(sorted, got.values())) == want and len(want) > 100
    # a class whose tuples nobody else has makes no table
    batch = pa.RecordBatch.from_pylist([{"node": 1, "sign": frame.first().sign, "items": 5, "shared": m} for m in (0, 1, 1 | 1 << side, 3 | 5 << side)])
    assert [b.num_rows for b in minhash._entries(iter([batch]))] == [1 + 2 * 2]


def test_likely_keeps_all_that_a_join_finds(spark):
    rows, of = spark.range(100_000).selectExpr("id AS at", "'t' AS text"), spark.range(0, 100_000, 100).selectExpr("id AS at")
    got = {r.at for r in minhash.likely(rows, "at", of.unionAll(of)).collect()}
    assert got >= set(range(0, 100_000, 100)) and len(got) < 1_100
    assert minhash.likely(rows, "at", of.limit(0)).count() == 0
