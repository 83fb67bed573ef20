"""Operator 11: centroid clustering by filtering through kd-trees.

Vectors become whole numbers, floor(scale * x). Each task orders its vectors by a kd-tree, TREE at a
time, and they are written once in that order; a tree is then given by halving its rows again and again,
whoever reads them. In every round each tree gets counts, sums and bounding boxes of its nodes from the
leaves up, and the centroids are filtered through it: at a node, the candidate nearest to the box's
middle stays, and any other that is further than it from the whole box, strictly, goes. A node with one
candidate left is assigned whole, by its count and sums; a leaf's vectors are compared with what is left.
Only sums a cluster and component leave a task, so a round shuffles no vectors; the driver gets at most
k * (dimension + 1) sums, a few numbers each.

All arithmetic is exact. Components below NARROW are handled as doubles that hold whole numbers (any sum
stays below 2**53); larger ones as Python's integers. Sums travel as digits of base 2**32.

Cases: vectors that are null, of another length, or with a null or non-finite component are not
clustered and not returned; equal distances go to the smaller number, so of equal centroids only the
first gets vectors; repeated rows count each; of start vectors with one hash (repeated ids) the smaller
in order of components comes first; a null vec_id is clustered but never a start; with fewer vectors
than k each is a start, with none the result has no rows; a distance or sum that a long cannot hold is
null; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

K, ROUNDS, SCALE, DIMENSION, SEED = 40, 5, 256, 64, "2"
TREE, LEAF, NARROW = 8192, 32, 1 << 22
_DIGIT = 32


def quantise(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return math.floor(x * scale) if abs(x) < 2**52 else int(x) * scale


def kd_order(points: np.ndarray) -> np.ndarray:
    """The rows' order in which each half, quarter and so on is one side of a cut through the widest dimension."""
    order, open_ = np.arange(len(points)), [(0, len(points))]
    while open_:
        a, b = open_.pop()
        if b - a <= LEAF:
            continue
        inside = points[order[a:b]]
        width = inside.max(axis=0) - inside.min(axis=0)
        axis = int(np.argmax(width))
        if not width[axis]:
            continue
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argsort(inside[:, axis], kind="stable") if points.dtype == object else np.argpartition(inside[:, axis], half)]
        open_ += [(a, a + half), (a + half, b)]
    return order


class Tree:
    """Nodes over rows in kd order; a node's children follow it."""

    def __init__(self, points: np.ndarray):
        self.points = points
        spans, sides, open_ = [], [], [(0, len(points), -1)]
        while open_:
            a, b, above = open_.pop()
            k = len(spans)
            spans.append((a, b))
            sides.append([])
            if above >= 0:
                sides[above].append(k)
            if b - a > LEAF:
                half = a + (b - a) // 2
                open_ += [(half, b, k), (a, half, k)]
        self.spans, self.sides = spans, sides
        leaves = [k for k, s in enumerate(sides) if not s]
        starts = [spans[k][0] for k in leaves]  # in order of rows
        size = (len(spans), points.shape[1])
        self.low, self.high, self.sums = (np.zeros(size, points.dtype) for _ in range(3))
        self.low[leaves] = np.minimum.reduceat(points, starts)
        self.high[leaves] = np.maximum.reduceat(points, starts)
        self.sums[leaves] = np.add.reduceat(points, starts)
        for k in range(len(spans) - 1, -1, -1):
            if sides[k]:
                left, right = sides[k]
                self.low[k] = np.minimum(self.low[left], self.low[right])
                self.high[k] = np.maximum(self.high[left], self.high[right])
                self.sums[k] = self.sums[left] + self.sums[right]


def undominated(low: np.ndarray, high: np.ndarray, centers: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The candidates that are not strictly further from the whole box than the one nearest to its middle."""
    c = centers[left]
    best = int(np.argmin(((2 * c - (low + high)) ** 2).sum(axis=1)))
    step = c - c[best]
    corner = np.where(step > 0, high, low)  # where the candidate gains most on the best
    return left[np.asarray((step * (c + c[best] - 2 * corner)).sum(axis=1) <= 0, bool)]


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest center, squared distance) of each point, ties to the smaller number."""
    if points.dtype == object:
        far = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    else:
        far = (points * points).sum(axis=1)[:, None] - 2 * (points @ centers.T) + (centers * centers).sum(axis=1)[None, :]
    at = np.argmin(far, axis=1)
    return at, far[np.arange(len(points)), at]


def filtered(points: np.ndarray, centers: list[list[int]]) -> Iterator[tuple[int, int, object, np.ndarray | None]]:
    """Spans of rows in kd order as (start, end, cluster or clusters, sums if the whole span has one cluster)."""
    c = np.array(centers, object)
    left = np.array(sorted({tuple(x): k for k, x in reversed(list(enumerate(centers)))}.values()))
    wide = np.array([max(map(abs, x)) >= NARROW for x in centers])
    if points.dtype != object and wide[left].any():
        ints = points.astype(np.int64).astype(object)
        left = undominated(ints.min(axis=0), ints.max(axis=0), c, left)
        if wide[left].any():
            points = ints
    if points.dtype != object:
        c = np.where(wide[:, None], 0, c).astype(np.float64)
    tree = Tree(points)
    open_ = [(0, left)]
    while open_:
        k, left = open_.pop()
        a, b = tree.spans[k]
        if len(left) > 1:
            left = undominated(tree.low[k], tree.high[k], c, left)
        if len(left) == 1:
            yield a, b, int(left[0]), tree.sums[k]
        elif not tree.sides[k]:
            yield a, b, left[nearest(points[a:b], c[left])[0]], None
        else:
            open_ += [(s, left) for s in tree.sides[k]]


def _in_order(scale: int):
    """vec_id, wide, numbers: a task's vectors as whole numbers in kd order, TREE at a time."""

    def flush(ids: list, points: np.ndarray, wide: bool) -> pa.RecordBatch:
        order = kd_order(points)
        if wide:
            numbers = [",".join(map(str, points[i])).encode() for i in order]
        else:
            raw, size = points[order].astype("<i4").tobytes(), 4 * points.shape[1]
            numbers = [raw[k : k + size] for k in range(0, len(raw), size)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pa.array(order)), pa.array([wide] * len(order)), pa.array(numbers, pa.binary())], ["vec_id", "wide", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        for whole in batches:
            for begin in range(0, whole.num_rows, TREE):
                batch = whole.slice(begin, TREE)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                narrow = (np.abs(x) * scale < NARROW - 1).all(axis=1)
                for wide in (False, True):
                    at = np.flatnonzero(narrow != wide)
                    if not len(at):
                        continue
                    ids, points = held[wide]
                    ids.append(batch.column(0).take(pa.array(at)))
                    points.append(np.array([[quantise(v, scale) for v in row] for row in x[at].tolist()], object) if wide else np.floor(x[at] * scale))
                    if sum(map(len, ids)) >= TREE:
                        yield flush(ids, np.concatenate(points), wide)
                        held[wide] = ([], [])
        for wide, (ids, points) in held.items():
            if ids:
                yield flush(ids, np.concatenate(points), wide)

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, points) of consecutive rows of one kind, TREE at most."""
    for whole in batches:
        kinds = np.asarray(whole.column(1))
        for wide in (False, True):
            some = whole.take(pa.array(np.flatnonzero(kinds == wide)))
            for begin in range(0, some.num_rows, TREE):
                batch = some.slice(begin, TREE)
                numbers = batch.column(2).to_pylist()
                if wide:
                    yield batch.column(0), np.array([[int(v) for v in x.split(b",")] for x in numbers], object)
                else:
                    yield batch.column(0), np.frombuffer(b"".join(numbers), "<i4").reshape(len(numbers), -1).astype(np.float64)


def _sums(centers: list[list[int]]):
    """cluster, component (-1: count), digit, total of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = len(centers), len(centers[0])
        count, total = np.zeros(k, np.int64), np.zeros((k, d), object)
        for _, points in _trees(batches):
            part = np.zeros((k, d), points.dtype)  # TREE vectors: no sum of doubles reaches 2**53
            for a, b, cluster, sums in filtered(points, centers):
                if sums is not None:
                    count[cluster] += b - a
                    if sums.dtype != part.dtype:
                        total[cluster] += sums
                    else:
                        part[cluster] += sums
                else:
                    count += np.bincount(cluster, minlength=k)
                    np.add.at(part, cluster, points[a:b])
            total += part if part.dtype == object else part.astype(np.int64).astype(object)
        rows = []
        for i in range(k):
            for j, x in enumerate([int(count[i]), *map(int, total[i])]):
                sign, x, digit = (-1 if x < 0 else 1), abs(x), 0
                while x:
                    rows.append((i, j - 1, digit, sign * (x & (1 << _DIGIT) - 1)))
                    x, digit = x >> _DIGIT, digit + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "component", "digit", "total"])

    return run


def _assign(centers: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(centers, object)
        narrow = np.array([max(map(abs, x)) < NARROW for x in centers])
        for ids, points in _trees(batches):
            label = np.zeros(len(points), np.int64)
            for a, b, cluster, _ in filtered(points, centers):
                label[a:b] = cluster
            if points.dtype != object and narrow[np.unique(label)].all():
                step = points - np.where(narrow[:, None], exact, 0).astype(np.float64)[label]
                far = (step * step).sum(axis=1).astype(np.int64).tolist()
            else:
                ints = points if points.dtype == object else points.astype(np.int64).astype(object)
                far = [x if x < 1 << 63 else None for x in ((ints - exact[label]) ** 2).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _moved(trees: DataFrame, centers: list[list[int]]) -> list[list[int]]:
    """The centers after one round: floored means of their vectors; those without any stay."""
    found = trees.mapInArrow(_sums(centers), "cluster int, component int, digit int, total long").groupBy("cluster", "component", "digit").agg(F.sum("total").alias("total"))
    sums: dict[tuple[int, int], int] = {}
    for r in found.collect():  # k * (dimension + 1) numbers, a few digits each
        sums[r.cluster, r.component] = sums.get((r.cluster, r.component), 0) + (r.total << _DIGIT * r.digit)
    return [[sums.get((i, j), 0) // sums[i, -1] for j in range(len(c))] if sums.get((i, -1)) else c for i, c in enumerate(centers)]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster and distance of every vector that is clustered, final centroids)."""
    scratch, kind = Scratch(vectors.sparkSession), dict(vectors.dtypes)["vec_id"]
    good = (F.size("embedding") == dimension) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(good)
    first = kept.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "embedding")
    centers = [[quantise(x, scale) for x in r.embedding] for r in first.orderBy("hash", "embedding").limit(k).collect()]
    if not centers:
        return kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    trees = scratch.keep(kept.mapInArrow(_in_order(scale), f"vec_id {kind}, wide boolean, numbers binary"))
    centers = reduce(lambda c, _: _moved(trees, c), range(rounds), centers)
    return scratch.keep(trees.mapInArrow(_assign(centers), f"vec_id {kind}, cluster int, distance long")), centers


def report(assigned: DataFrame, centers: list[list[int]]) -> DataFrame:
    """Every vector's cluster and distance with the distances' sums and the digest of its centroid."""
    spark = assigned.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("lost")).filter("cluster is not null").collect()  # k rows
    fits = lambda x, lost: None if lost or x is None or x >= 1 << 63 else int(x)
    total = fits(sum(int(r.total or 0) for r in sums), sum(r.lost for r in sums))
    rows = [(r.cluster, fits(r.total, r.lost), total, hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()) for r in sums]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # about: k rows


def query(spark, sf_dir: str) -> DataFrame:
    return report(*cluster(table(spark, sf_dir, "embeddings")))


_ROUND = """
    a{i} AS MATERIALIZED (SELECT vec_id, q, arg_min(j, (far, j)) AS j, min(far) AS far FROM (SELECT v.vec_id, v.row, v.q, c.j, list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS far FROM v CROSS JOIN c{i} c) z GROUP BY vec_id, row, q),
    m{i} AS (SELECT j, p, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT j, unnest(q) AS x, unnest(range(64)) AS p FROM a{i}) u GROUP BY j, p),
    c{k} AS MATERIALIZED (SELECT c.j, coalesce(n.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS q FROM m{i} GROUP BY j) n ON c.j = n.j),"""
ORACLE = (
    """
    WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS j, q FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 40) z),"""
    + "".join(_ROUND.format(i=i, k=i + 1) for i in range(ROUNDS))
    + """
    f AS MATERIALIZED (SELECT vec_id, arg_min(j, (far, j)) AS j, min(far) AS far FROM (SELECT v.vec_id, v.row, c.j, list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS far FROM v CROSS JOIN c5 c) z GROUP BY vec_id, row)
    SELECT f.vec_id, CAST(f.j AS INTEGER) AS cluster, CAST(f.far AS BIGINT) AS distance, CAST(sum(f.far) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(f.far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM f JOIN c5 c ON f.j = c.j"""
)
