"""Cuts of lineage that survive the loss of executors, and iterations over them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir; to a folder of its own only in local mode."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local") or "cluster" in context.master:
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="proofmill-")
        context.setCheckpointDir(found)
    return df.checkpoint()


def reach(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """All rows of columns that step leads to from seeds, again and again until nothing is new; seeds included.

    Each round joins only the rows that the last one found.
    """
    fronts = [cut(seeds.select(*columns).distinct())]
    while not fronts[-1].isEmpty():
        found = reduce(DataFrame.unionAll, fronts)
        fronts.append(cut(step(fronts[-1]).select(*columns).distinct().join(found, columns, "left_anti")))
    return reduce(DataFrame.unionAll, fronts)


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component of links (a, b).

    Each round points every node at its smallest neighbour or itself, follows these pointers to their ends
    by doubling, and contracts the links, so a long chain takes as few rounds as a star.
    """
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("root")))
        moved = True
        while moved:
            step = cut(step.join(step.toDF("root", "top"), "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            moved = not step.filter("moved").isEmpty()
            step = step.select("node", "root")
        steps.append(step)
        edges = cut(edges.join(step.toDF("a", "pa"), "a").join(step.toDF("b", "pb"), "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps.pop()
    while steps:
        found = cut(steps.pop().join(found.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    return found


def looked_up(rows: DataFrame, key: str, own: str, above: DataFrame) -> DataFrame:
    """rows left-joined with above (key, ...); rows whose key is null are dealt by their own id, as they would all meet in one task."""
    left = rows.withColumns({"at_": F.coalesce(key, own), "no_": F.col(key).isNull()})
    return left.join(above.withColumnRenamed(key, "at_").withColumn("no_", F.lit(False)), ["at_", "no_"], "left").drop("at_", "no_")


def _trees(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, root, hit) of every node of edges (src, dst), by doubling the pointers to parents.

    A node with one way in hangs below the node that it comes from; hit says whether a seed is above it or
    is itself. A ring of such nodes has no way in from elsewhere, so it and what hangs below it need no root.
    """
    single = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up")).filter("n = 1").select(F.col("dst").alias("node"), "up")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    marked = seeds.select("node").distinct().withColumn("hit", F.lit(True))
    now = nodes.join(single, "node", "left").join(marked, "node", "left")
    now = cut(now.select("node", "up", F.coalesce("up", "node").alias("root"), F.coalesce("hit", F.lit(False)).alias("hit")))
    for _ in range(now.filter("up is not null").count().bit_length() + 1):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("root").alias("top"), F.col("hit").alias("more"))
        now = cut(looked_up(now, "up", "node", above).select("node", F.col("further").alias("up"), F.coalesce("top", "root").alias("root"), (F.col("hit") | F.coalesce("more", F.lit(False))).alias("hit")))
        if now.filter("up is not null").isEmpty():
            break
    return now.select("node", F.when(F.col("up").isNull(), F.col("root")).alias("root"), "hit")


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every node (node) that edges lead to from the seeds, seeds included.

    Nodes with one way in are contracted to trees by doubling; the search then runs over the nodes with
    several ways in. Its rounds are the merges on a way, not its length or its forks.
    """
    edges = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    trees = cut(_trees(edges, seeds))
    merges = edges.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1").select("dst")
    into = cut(edges.join(merges, "dst").join(trees.withColumnRenamed("node", "src"), "src").select("root", "hit", F.col("dst").alias("to")))
    over = into.filter("root is not null").select("root", "to").distinct()
    step = lambda front: front.join(over, "root").select(F.col("to").alias("root"))
    whole = reach(into.filter("hit").select(F.col("to").alias("root")), step, ["root"]).withColumn("all", F.lit(True))
    inside = trees.join(whole, "root", "left").filter("hit or all").select("node")
    return inside.unionAll(seeds.select("node").distinct().join(trees.select("node"), "node", "left_anti"))
