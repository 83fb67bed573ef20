"""Connected components: of distributed links by contraction, of a block's links in memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b); root is the same for nodes joined by links.

    Each round points every node at its smallest neighbour or itself and contracts the links by these
    pointers until none is left; then the pointers are followed back. From the second round on, pointers
    are first followed to their ends by doubling, so a long chain ends after as few rounds as a star.
    Minima are aggregated before the shuffle, so a hub costs no more than other nodes. Every round is
    written to the shared folder.
    """
    edges = scratch.keep(links.filter("a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.keep(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("root")))
        while steps:  # from the second round on
            jump = step.join(step.toDF("root", "top"), "root").select("node", "root", "top")
            if jump.filter("root <> top").isEmpty():
                break
            nearer, step = step, scratch.keep(jump.select("node", F.col("top").alias("root")))
            scratch.drop(nearer)
        steps.append(step)
        left, right, before = step.toDF("a", "pa"), step.toDF("b", "pb"), edges
        edges = scratch.keep(edges.join(left, "a").join(right, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        scratch.drop(before)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps.pop()
    while steps:
        step, later = steps.pop(), found
        found = scratch.keep(step.join(later.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        scratch.drop(step, later)
    return found


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of n nodes, by the links i - j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[label]
        while (new[new] != new).any():
            new = new[new]
        label = new
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label
