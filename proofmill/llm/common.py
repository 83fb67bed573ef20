"""What the operators of this subpackage share: tables, Arrow text buffers, word hashes, durable cuts of lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes that a Python worker handles at a time; only a single longer text exceeds it.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; of its own only in local mode, where one machine holds all."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="proofmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def unused(columns: list[str], *names: str) -> list[str]:
    """names, made different from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors.

    A table is dropped once all that reads it has been written; what a query returns reads the tables
    that are left.
    """

    #: Seconds between two requests to let go of shuffle files that nothing reads any more.
    EVERY = 4

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{scratch_dir(spark)}/proofmill-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []  # all of them, so that no other gets the id of one
        self.freed = time.monotonic()

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{len(self.tables) + 1}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for t in tables:
            path = hadoop(self.paths[id(t)])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            del self.paths[id(t)]
        # the driver's collector decides when shuffle files go
        if time.monotonic() - self.freed > self.EVERY:
            gc.collect()
            self.spark._jvm.System.gc()
            self.freed = time.monotonic()


def map_rows(rows: DataFrame, run, names: list[str], kinds: StructType) -> DataFrame:
    """rows.mapInArrow(run) to columns of these names and kinds; any name may hold dots."""
    safe = [c if c.isidentifier() else f"column{k}_" for k, c in enumerate(rows.columns)]
    out = StructType([StructField(f"out{k}", f.dataType) for k, f in enumerate(kinds.fields)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(out.names)

    return rows.toDF(*safe).mapInArrow(numbered, out).toDF(*names)


def clean_text(name: str = "text"):
    """A text column's UTF-8 bytes; null stays null."""
    return F.col(name).cast("binary").alias("text")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, starts, ends) without a copy per row; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, stops = ends[:-1], ends[1:]
    if column.null_count:
        gone = np.asarray(column.is_null())
        if (stops[gone] > starts[gone]).any():
            return buffers(pa.array(column.to_pylist(), column.type).fill_null(b""))
    low, high = int(starts[0]), int(stops[-1])
    return raw[low:high], starts - low, stops - low


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in order, cut so that a cut holds at most limit bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts, stops = buffers(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(stops, starts[begin] + limit, "right"))
            end = max(end, begin + 1)
            yield batch.slice(begin, end - begin)
            begin = end


def spread(text: bytes, limit: int, piece: int) -> bytes:
    """A text of at most limit bytes: whole pieces that stand evenly over all of a longer one."""
    if len(text) <= limit:
        return text
    n = limit // piece
    return b"".join(text[a : a + piece] for a in (k * (len(text) - piece) // (n - 1) for k in range(n)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD**i and _ODD**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            if n > 8 * SLICE_BYTES:  # one very long text: not worth keeping
                _powers.pop(name, None)
            else:
                _powers[name] = out
            if name == "up":
                up = out
        return up[:n], out[:n]
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * _ODD**position over i <= position < j."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[stops] - prefix[starts]) * down[starts])


def word_hashes(texts: list[bytes | None], separators: bytes = b"") -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(SipHash of each word, number of words by text, words), after lower-casing A-Z.

    Words are runs of bytes other than white space and separators.
    """
    blank = bytes.maketrans(separators, b" " * len(separators)) if separators else None
    split = [t.lower().translate(blank).split() if t else [] for t in texts]
    count = np.fromiter(map(len, split), np.int64, len(split))
    words = list(chain.from_iterable(split))
    if not words:
        return np.zeros(0, U64), count, words
    flat = np.empty(len(words), object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False), count, words


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(is_word: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes inside each text: (starts, ends, text number)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a run may cross from one text into the next
    edges = np.unique(starts[(stops > starts)])
    edges = edges[(edges > 0) & (edges < len(data))]
    if len(edges):
        edges = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
        first = np.sort(np.concatenate([first, edges]))
        last = np.sort(np.concatenate([last, edges]))
    full = np.flatnonzero(stops > starts)
    owner = full[np.searchsorted(starts[full], first, "right") - 1] if len(first) else first
    return first, last, owner
