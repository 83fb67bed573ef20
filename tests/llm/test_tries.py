import hashlib
import random
import re
import zlib

import pytest

from proofmill.llm import tries


def brute(rows):
    """Nodes by plain dictionaries; rows are (conv_id, turn, role, text)."""
    turns = {}
    for c, t, r, x in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = None if c is None else c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = tuple(([] if c is None else turns.get(base, []))[:h] + own[h:])
    members, nodes = {}, []
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    low = lambda ids: min((c for c in ids if c is not None), default=None)
    children, value = {}, {}
    for p, ids in members.items():
        if p:
            children.setdefault(p[:-1], []).append(p)
        value[p] = (len(ids) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = value[p] + sum(saved[q] for q in below)
    for p, ids in members.items():
        ended = sorted((c for c in ids if paths[c] == p), key=lambda c: (c is not None, c or 0))
        text = ",".join("" if c is None else str(c) for c in ended)
        nodes.append((low(ids), len(p), low(members[p[:-1]]) if p else None, len(ids), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(nodes, key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 3, b"x") for r in rows], "conv_id long, turn long, role string, text string, depth int, key binary").repartition(3)
    return sorted((tuple(r) for r in tries.prefixes(frame, **options).collect()), key=str)


def made(seed, n, alphabet=2, longest=7):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c * 3 - 50, t, "user" if t % 2 == 0 else "assistant", f"t{rng.randint(1, alphabet)} word" * (t % 3)))
    return rows


CASES = [
    (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "a b"), (1, None, "user", "first"),
    (None, 1, "user", "no id"), (None, 0, "user", "t1"), (20, 0, "user", "a"), (20, 1, "x", "b c"), (21, 0, "user", "only"), (-7, 0, "user", "neg"), (0, 0, "user", "zero"), (0, 1, "user", "more zero"), (2**62, 0, "user", "été 中文\n x"),
]


@pytest.mark.parametrize("limit, bucket", [(2048, 8192), (3, 4), (20, 10)])
def test_brute(spark, limit, bucket):
    rows = made(1, 150) + CASES
    assert run(spark, rows, limit=limit, bucket=bucket) == brute(rows)


def test_copies_and_long_chains(spark):
    """A hot first turn, a hundred equal conversations, a long chain that many share, and a long conversation alone."""
    rows = [(20 * k, t, "user", f"same {t}") for k in range(100) for t in range(5)]
    rows += [(20 * k, t, "user", f"line {t}" if t < 60 else f"tail {k % 3} {t}") for k in range(100, 112) for t in range(64)]
    rows += [(20 * 500, t, "user", f"same {t}") for t in range(300)]
    assert run(spark, rows, limit=8, bucket=16) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_turnless(spark):
    """Conversations without a base that have no more turns than are taken from it."""
    rows = [(c, 0, "user", f"x{c}") for c in range(1, 20)]
    got = run(spark, rows)
    assert got == brute(rows) and any(r[1] == 0 and r[-1] != tries.NONE for r in got)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in tries.query(spark, path).collect()), key=str) == brute(rows)
