"""Operator 4: near-duplicate vectors by random-hyperplane sign hashing.

Vectors are compared only within a label and a dimension. Equal vectors form a class; only classes are
hashed. Each of TABLES tables keys a class by its BITS signs against fixed random hyperplanes; classes
that share a bucket are compared by cosine in double precision, in blocks of at most about 2 * BLOCK
classes, and every pair is counted in the first table it shares only. A pair at a cosine of 0.98
shares a table with a probability of 0.998, closer ones with more. Buckets that hold the same classes
as one of an earlier table are dropped. A block yields a count per class and the links of its
components, never its pairs; components are then found by distributed contraction.

Cases: a null label, a null, empty or zero vector and one with null or non-finite components link with
nothing and stand alone; of equal cosines none is preferred, all links count; a null vec_id is a row like others, never the smallest id unless its component
holds nothing else; repeated rows link with each other; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, mix
from .graph import components, local_components

TABLES, BITS, COSINE, BLOCK = 20, 20, 0.98, 1024
_planes: dict[int, np.ndarray] = {}


def planes(dimension: int) -> np.ndarray:
    if dimension not in _planes:
        _planes[dimension] = np.random.default_rng(dimension).standard_normal((dimension, TABLES * BITS))
    return _planes[dimension]


def signs(unit: np.ndarray) -> np.ndarray:
    """The bucket of each vector in each table."""
    bits = (unit @ planes(unit.shape[1]) > 0).reshape(len(unit), TABLES, BITS)
    return (bits << np.arange(BITS)).sum(axis=2).astype(np.int64)


def matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one dimension, stored as floats of a kind, as rows of doubles."""
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows at length one."""
    out = rows / np.abs(rows).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _name(kind: str):
    """Adds a 128-bit name of label and vector, null if it can't link, and the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.values  # of all rows, one buffer
            gone = np.asarray(values.is_null())
            flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # -0.0 is 0.0
            bad, some = np.append(0, np.cumsum(gone | ~np.isfinite(flat))), np.append(0, np.cumsum(flat != 0))
            start, stop = (np.asarray(lists.offsets)[k : k + batch.num_rows] for k in (0, 1))
            good = (bad[stop] == bad[start]) & (some[stop] > some[start]) & np.asarray(lists.is_valid()) & np.asarray(batch.column(1).is_valid())
            raw, size = flat.tobytes(), flat.itemsize
            vectors = [raw[a * size : b * size] if g else None for a, b, g in zip(start.tolist(), stop.tolist(), good.tolist())]
            names = [v and hashlib.blake2b(repr(label).encode() + b"\0" + v, digest_size=16).digest() for label, v in zip(batch.column(1).to_pylist(), vectors)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), pa.array(names, pa.binary())], ["vec_id", "label", "vector", "node"])

    return run


def _entries(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                label = np.array([int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest()) for x in batch.column(1).to_pylist()], U64)
                vectors = batch.column(2).to_pylist()
                length = np.array([len(v) for v in vectors])
                for n in np.unique(length):
                    at = np.flatnonzero(length == n)
                    unit = units(matrix([vectors[i] for i in at], kind))
                    key = mix(mix(signs(unit).astype(U64) + np.arange(TABLES, dtype=U64) * U64(1 << BITS) + U64(unit.shape[1] << 40)) + label[at][:, None])
                    rows, table = np.repeat(at, TABLES), np.tile(np.arange(TABLES), len(at))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(table, pa.int32()), batch.column(0).take(pa.array(rows))], ["key", "table", "node"])

    return run


def _block(table: int, rows: list[tuple], i: int, j: int, cosine: float, kind: str) -> list[tuple]:
    """(node, partners, root) of a block's classes that have a link; rows are (node, n, chunk, vector)."""
    unit = units(matrix([r[3] for r in rows], kind))
    sign, chunk = signs(unit), np.array([r[2] for r in rows])
    left = np.flatnonzero(chunk == i)
    right = np.flatnonzero(chunk == j)
    a, b = np.nonzero(unit[left] @ unit[right].T >= cosine)
    a, b = left[a], right[b]
    keep = a < b if i == j else np.ones(len(a), bool)
    a, b = a[keep], b[keep]
    if table and len(a):
        seen = np.zeros(len(a), bool)
        for t in range(table):
            seen |= sign[a, t] == sign[b, t]
        a, b = a[~seen], b[~seen]
    if not len(a):
        return []
    weight = np.array([r[1] for r in rows])
    partners = np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))
    root = local_components(len(rows), a, b)
    return [(rows[k][0], int(partners[k]), rows[root[k]][0]) for k in np.flatnonzero(partners)]


def _blocks(cosine: float, kind: str):
    """Consecutive rows with the same (key, i, j) are a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def close():
            found = _block(at[3], rows, at[1], at[2], cosine, kind) if len(rows) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())], ["node", "partners", "root"])] if found else []

        for batch in batches:
            for key, i, j, table, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (key, i, j, table):
                    yield from close() if at else []
                    at, rows = (key, i, j, table), []
                rows.append(tuple(row))
        if at:
            yield from close()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    scratch, types = Scratch(vectors.sparkSession), dict(vectors.dtypes)
    kind = "<f4" if types["embedding"] == "array<float>" else "<f8"
    slim = vectors.select("vec_id", "label", "embedding")
    if kind == "<f8":
        slim = slim.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = scratch.keep(slim.mapInArrow(_name(kind), f"vec_id {types['vec_id']}, label {types['label']}, vector binary, node binary"))
    alike = rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = scratch.keep(alike)
    entries = classes.select("node", "label", "vector").mapInArrow(_entries(kind), "key long, table int, node binary")
    bucket = entries.groupBy("key").agg(F.min("table").alias("table"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    bucket = bucket.filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("table", "key")).alias("b")).select("b.key", "b.table", F.ceil(F.col("n") / BLOCK).alias("chunks"))
    members = scratch.keep(entries.drop("table").join(bucket, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")))
    dealt = members.select("key", "table", "node", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    dealt = dealt.join(classes.select("node", "n", "vector"), "node").select("key", "i", "j", "table", "node", "n", "chunk", "vector")
    found = scratch.keep(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks(cosine, kind), "node binary, partners long, root binary"))
    label = components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    named = classes.select("node", "n", "first").join(label, "node", "left").join(counts, "node", "left")
    named = named.select("node", (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), "first", F.coalesce("root", "node").alias("root"))
    named = scratch.keep(named)
    result = named.join(named.groupBy("root").agg(F.min("first").alias("component")), "root").select("node", "n_links", "component")
    out = rows.select("vec_id", "node").join(scratch.keep(result), "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
