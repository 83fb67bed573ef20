import random

import numpy as np

from proofmill.llm import graph
from proofmill.llm.common import Scratch


def brute(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(top)}


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(200)] + [(2000 - k, 1999 - k) for k in range(60)]
    hub = [(5000, 5001 + k) for k in range(300)]
    loose = [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(250)]
    pairs = chain + hub + loose + [(7000, 7000)] + hub[:5]
    got = {r.node: r.root for r in graph.components(Scratch(spark), spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute([p for p in pairs if p[0] != p[1]])
    same = {}
    for node, root in want.items():
        same.setdefault(root, set()).add(got.pop(node))
    assert not got and all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


def test_no_links(spark):
    assert graph.components(Scratch(spark), spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_local_components():
    i, j = np.array([0, 1, 5, 7]), np.array([1, 2, 6, 5])
    assert graph.local_components(9, i, j).tolist() == [0, 0, 0, 3, 4, 5, 5, 5, 8]
