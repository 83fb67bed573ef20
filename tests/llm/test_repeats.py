import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from proofmill.llm import repeats, suffixes


def brute(docs):
    name = lambda t: hashlib.sha256(t).digest()
    rows = [(d, (t or "").encode()) for d, t in docs]
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, name(r[1])))
    seen, result = set(), {}
    for d, t in order:
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            s = hash(t[k : k + 100])
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        result[d, t] = (d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return [result[r] for r in rows]


key = lambda r: tuple(map(str, r))


def test_suffix_array():
    rng = random.Random(2)
    for letters in (1, 2, 20):
        text = bytes(0 if rng.random() < 0.02 else 1 + rng.randrange(letters) for _ in range(700)) + b"\0"
        got = [text[i : i + 100] for i in suffixes.suffix_array(np.frombuffer(text, np.uint8), 100)]
        assert len(got) == len(text)
        # order within a segment's bytes; what follows a separator does not count
        cut = [g.split(b"\0")[0] for g in got]
        assert cut == sorted(cut)


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_cases(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}é" for _ in range(n))
    passage, base = words(40), words(120)
    docs = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, base), (9, base), (5, base), (6, base[:500] + "XX" + base[500:]), (7, "ab" * 400), (8, "ab" * 49), (None, base), (None, words(30)), (10, base[:99]), (11, base[:100]), (6, passage), (12, "a" * 99 + "b"), (13, "a" * 100), (14, "a" * 5000)]
    docs += [(100 + k, words(5) + passage + words(5)) for k in range(20)]
    docs.append((50, words(30) * 2 + passage[10:]))
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_bytes string")
    got = [tuple(r) for r in repeats.find(frame).collect()]
    want = brute(docs)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = repeats.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[1] == 0 or w[2] < w[1])


def test_patterns():
    rng = random.Random(3)
    text = bytes(0 if rng.random() < 0.03 else 1 + rng.randrange(3) for _ in range(2000)) + b"\0"
    wanted = sorted({text[i : i + rng.randrange(1, 30)] for i in range(0, 1900, 7)} - {b""})
    wanted = [w for w in wanted if 0 not in w]
    patterns, keys = suffixes.Patterns(wanted), suffixes.windows(np.frombuffer(text, np.uint8))
    order = suffixes.suffix_array(np.frombuffer(text, np.uint8), patterns.depth + 1, keys)
    for w, low, high in zip(wanted, *patterns.find(keys, order)):
        assert sorted(order[low:high].tolist()) == [i for i in range(len(text)) if text.startswith(w, i)]


def test_streams_across_batches():
    rng = random.Random(7)
    bit = 1 << repeats.AGAIN
    rows = sorted({(rng.randrange(12), rng.randrange(3), rng.randrange(3), (rng.randrange(4) << repeats.START) + 1) for _ in range(80)})
    rows = sorted(rows + rows[::5] + [(99, 1, 1, 5 | bit), (99, 1, 2, 9 | bit)])
    keys = {}
    for r in set(rows):
        if not r[3] & bit:
            keys.setdefault(r[0], []).append(r)
    batch = lambda names, part: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names)
    plain = sorted(set(rows))
    for size in (1, 2, 7, 200):
        got = repeats._shared(iter([batch(["key", "seg", "short", "at"], rows[k : k + size]) for k in range(0, len(rows), size)]))
        got = sorted({tuple(r.values()) for b in got for r in b.to_pylist()})
        assert got == sorted(r for r in plain if r[3] & bit or len(keys[r[0]]) > 1)
        got = repeats._earliest(iter([batch(["key", "seg", "ord", "at"], plain[k : k + size]) for k in range(0, len(plain), size)]))
        got = [tuple(r.values()) for b in got for r in b.to_pylist()]
        first = {}
        for r in plain:
            if not r[3] & bit:
                first.setdefault(r[:2], r)
        assert sorted(r[2:] for r in got if r[0] is None) == sorted(r[2:] for r in plain if first.get(r[:2]) != r)
        assert sorted(r for r in got if r[0] is not None) == sorted(r for r in first.values() if len({k for k in first if k[0] == r[0]}) > 1)


def test_long_texts_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = line(1_300_000)
    docs = [(1, base), (2, line(700) + base[1_000_000:1_100_000] + line(700)), (3, base[300_000:] + base[:300_000])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert want[1][2] == 100_000 and want[2][2] == 1_300_000
    assert sorted(tuple(r) for r in repeats.find(frame).collect()) == want
    frame = spark.createDataFrame([(1, base[:300]), (2, base[:300]), (3, base[:300] + "x" * 50)], "doc_id long, text string")
    frame = frame.selectExpr("*", "1 AS name", "2 AS first", "3 AS found", "4 AS own", "5 AS text_name", "6 AS _cut", "7 AS `odd.name`")
    kept = repeats.deduplicated(frame)
    assert kept.columns == frame.columns and sorted((r.doc_id, len(r.text)) for r in kept.collect()) == [(1, 300), (3, 50)]


def test_empty(spark):
    assert repeats.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in repeats.query(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got, key=key) == sorted(brute(docs), key=key)
