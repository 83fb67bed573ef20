import hashlib
import random
import re

import pytest

from proofmill.llm import decontaminate as d


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = tokens(t)
        name = "" if i is None else str(i)
        for k in range(len(w) - 9) if len(w) >= 10 else range(bool(w)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, ids = tokens(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


key = lambda r: (str(r[0]), *map(str, r[1:]))
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
ITEMS = [(1, LONG), (2, "Ünïq wörds hére"), (3, "solo"), (10, LONG.upper() + " omicron"), (4, None), (5, "!!"), (None, "no name here")]
DOCS = [(1, f"x {LONG} y"), (2, LONG.rsplit(" ", 5)[0]), (3, LONG.rsplit(" ", 4)[0]), (4, "so Solo, solo"), (5, None), (6, ""), (7, "ünïq-WÖRDS... hére"), (7, "ünïq"), (8, "no name here no name here"), (1, f"x {LONG} y"), (None, "solo"), (9, "pad word " * 100_000 + LONG), (11, "alpha beta gamma"), (12, LONG[:40]), (13, LONG[40:])]


@pytest.mark.parametrize("block", [d.BLOCK_BYTES, 100])
def test_cases(spark, block):
    docs = spark.createDataFrame([(*r, "clash") for r in DOCS], "doc_id long, text string, n_hit string").coalesce(1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r)[:6] for r in d.find(docs, items, block_bytes=block).collect()]
    want = brute(DOCS, ITEMS)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = d.clean(docs, items, block_bytes=block)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in want if not r[5])


def longest(docs, items):
    """(length, item, place in the document, place in the item) by document, by extending every pair of equal words."""
    out = []
    for _, t in docs:
        w, best = tokens(t), None
        for i, u in items:
            v = tokens(u)
            for a in range(len(w)):
                for b in range(len(v)):
                    if w[a] == v[b] and (not a or not b or w[a - 1] != v[b - 1]):
                        n = 1
                        while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                            n += 1
                        if n >= min(10, len(v)):
                            rank = (-n, a, "" if i is None else str(i), b)
                            best = min(best or rank, rank)
        out.append((-best[0], best[2], best[1], best[3]) if best else (0, None, None, None))
    return out


@pytest.mark.parametrize("block", [d.BLOCK_BYTES, 100])
def test_longest_matches(spark, block):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, text(30)) for k in range(6)] + ITEMS
    docs = [(k, text(60) + " " + (rng.choice(items)[1] or "")[:40] if k % 2 else text(50)) for k in range(30)]
    docs += [(100 + k, r[1]) for k, r in enumerate(DOCS) if len(r[1] or "") < 1000]
    items = [(i, t or "") for i, t in items]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = d.find(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    got = {r.doc_id: (r.longest, r.longest_item, r.longest_at, r.longest_from) for r in found.collect()}
    assert got == dict(zip((k for k, _ in docs), longest(docs, items)))


def test_words_of_structure(spark):
    """Words that polynomial hashes modulo a power of two confuse."""
    a, b = ("".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(1024)) for flip in (0, 1))
    docs, items = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in d.find(docs, items).collect()} == {1: 1, 2: 0}


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "solo"), (2, "fine")], "doc_id long, text string").selectExpr("*", "1 AS name", "2 AS matches", "3 AS `odd.name`")
    kept = d.clean(frame, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=100)
    assert kept.columns == frame.columns and [r.doc_id for r in kept.collect()] == [2]


def test_empty(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.find(docs.limit(0), items).count() == 0
    assert d.find(docs, items.limit(0)).filter("contaminated").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r)[:6] for r in d.query(spark, sf).collect()]
    assert sum(r[5] for r in got) > 5
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_repeated_items_are_one(spark):
    """A benchmark of one item repeated past a block is a block of one item."""
    items = spark.createDataFrame([("a", "w " * 500)] * 300, "item_id string, text string")
    found = list(d.blocks(items, 10_000))
    assert len(found) == 1 and len(found[0]) == 1
