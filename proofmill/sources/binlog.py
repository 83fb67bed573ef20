"""Binary task logs: length-prefixed frames, read from bytes at offsets and verified as a chain.

A frame is a length (4 bytes, big-endian), a body of that length and the body's CRC32C (4 bytes). The
body holds the schema version (1 byte), sequence number and fencing epoch (8 bytes each), the previous
record's hash, the payload's digest (32 bytes each) and the payload. A record's hash is the SHA-256 of
its body; the first record's previous hash is zero.

A frame that the bytes end in, or a last one whose checksum is wrong, is a torn tail: the log is cut off
where the record before it ends. If a whole frame follows what looks torn, its length was corrupted, which
like any other wrong checksum, sequence number, digest or hash is permanent; so is a last length that
became smaller, which leaves bytes behind its frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checksums import crc32c, crc32c_array, crc32c_spans

VERSION, HEADER, EDGE = 1, 81, 4
FRAMES = "log {kind}, place long, byte_offset long, n_bytes long, whole boolean, checksum_ok boolean, schema_version int, seq long, fencing_epoch long, prev_hash string, payload_digest string, digest_ok boolean, record_hash string"


#: Bytes of logs that are read at once, but for one larger log.
_AT_ONCE = 1 << 20


def body(seq: int, epoch: int, prev_hash: bytes, payload: bytes) -> bytes:
    return bytes([VERSION]) + seq.to_bytes(8, "big") + epoch.to_bytes(8, "big") + prev_hash + hashlib.sha256(payload).digest() + payload


def frame(data: bytes) -> bytes:
    return len(data).to_bytes(EDGE, "big") + data + crc32c(data).to_bytes(EDGE, "big")


def _whole(raw: bytes, at: int) -> int:
    """Where the frame at an offset ends; 0 if the bytes end first or it is too short to be one."""
    if at + EDGE > len(raw):
        return 0
    n = int.from_bytes(raw[at : at + EDGE], "big")
    end = at + n + 2 * EDGE
    return end if n >= HEADER and end <= len(raw) else 0


def _resumes(raw: bytes, at: int) -> bool:
    """Does a whole frame with its checksum stand anywhere behind this offset?"""
    for k in range(at + 1, len(raw) - HEADER - 2 * EDGE + 1):
        end = _whole(raw, k)
        if end and raw[k + EDGE] == VERSION and crc32c(raw[k + EDGE : end - EDGE]) == int.from_bytes(raw[end - EDGE : end], "big"):
            return True
    return False


def scan(raw: bytes) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the frames of a log's bytes; the last one may not be whole."""
    out, at = [], 0
    while at < len(raw):
        end = _whole(raw, at)
        out.append((at, end or len(raw), bool(end)))
        if not end:
            break
        at = end
    return out


def parsed(raw: bytes) -> list[tuple]:
    """The frames of a log as rows of FRAMES, without the log's name."""
    return _parsed([raw])[0]


def _parsed(logs: list[bytes]) -> list[list[tuple]]:
    """The frames of each of some logs; the checksums of all are made at once."""
    spans = [scan(raw) for raw in logs]
    begins = np.cumsum([0, *map(len, logs)])
    whole = [(begin + a, begin + b) for begin, found in zip(begins.tolist(), spans) for a, b, ok in found if ok]
    data, edges = np.frombuffer(b"".join(logs), np.uint8), np.array(whole, np.int64).reshape(-1, 2)
    crc = iter(crc32c_spans(data, edges[:, 0] + EDGE, edges[:, 1] - EDGE).tolist() if whole else [])
    return [_rows(raw, found, crc) for raw, found in zip(logs, spans)]


def _rows(raw: bytes, spans: list[tuple[int, int, bool]], crc: Iterator[int]) -> list[tuple]:
    """The frames of a log, given their places and the checksums of the whole ones."""
    rows = []
    for k, (a, b, ok) in enumerate(spans):
        if not ok:
            rows.append((k, a, b - a, False, False if not _resumes(raw, a) else None, None, None, None, None, None, None, None))
            continue
        inner = raw[a + EDGE : b - EDGE]
        good = next(crc) == int.from_bytes(raw[b - EDGE : b], "big")
        digest = inner[49:HEADER]
        number = lambda p: int.from_bytes(inner[p : p + 8], "big", signed=True)
        rows.append((k, a, b - a, True, good, inner[0], number(1), number(9), inner[17:49].hex(), digest.hex(), hashlib.sha256(inner[HEADER:]).digest() == digest, hashlib.sha256(inner).hexdigest()))
    return rows


def frames(logs: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """The frames of every log, a row each; a log's bytes are one value."""
    kind = dict(logs.dtypes)[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raws, size = [], [], 0
            for k in range(batch.num_rows):
                names.append(batch.column(0)[k].as_py())
                raws.append(batch.column(1)[k].as_py() or b"")
                size += len(raws[-1])
                if size < _AT_ONCE and k + 1 < batch.num_rows:
                    continue
                found = [(name, *row) for name, rows in zip(names, _parsed(raws)) for row in rows]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (batch.schema.field(0).type, *_TYPES))], _NAMES)
                names, raws, size = [], [], 0

    return logs.select(F.col(name).alias("log"), F.col(content).alias("content")).mapInArrow(run, FRAMES.format(kind=kind))


_NAMES = [c.split()[0] for c in FRAMES.split(", ")]
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string())


def read(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """The frames of all log files in a folder, by path."""
    return frames(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def verified(found: DataFrame) -> DataFrame:
    """Per log: frames, how many verify from the start, the offset up to which they do, and the verdict.

    A record is sound if its frame is whole and of a known version, its checksum and digest are right, its
    sequence number is its place, its epoch is none below an earlier one, and it holds the hash of the
    record before it.
    """
    w = Window.partitionBy("log").orderBy("place")
    before = F.coalesce(F.lag("record_hash").over(w), F.lit("0" * 64))
    fence = F.max("fencing_epoch").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sound = F.col("whole") & F.col("checksum_ok") & F.col("digest_ok") & (F.col("schema_version") == VERSION) & (F.col("seq") == F.col("place")) & (F.col("fencing_epoch") == fence) & (F.col("prev_hash") == before)
    marked = found.withColumn("sound", F.coalesce(sound, F.lit(False)))
    bad = F.struct("place", "byte_offset", "whole", "checksum_ok")
    g = marked.groupBy("log").agg(F.count("*").alias("n_records"), F.min(F.when(~F.col("sound"), bad)).alias("b"), F.sum("n_bytes").alias("size"))
    torn = (F.col("b.place") == F.col("n_records") - 1) & F.coalesce(~F.col("b.checksum_ok"), F.lit(False))
    status = F.when(F.col("b").isNull(), "sound").when(torn, "truncated").otherwise("FAILED_PERMANENT")
    return g.select("log", "n_records", F.coalesce("b.place", "n_records").alias("n_verified"), F.coalesce("b.byte_offset", "size").alias("verified_bytes"), status.alias("status"))


def packed(records: DataFrame) -> DataFrame:
    """(log, content) of records (log, place, body in hex, flip, kept): a log's frames as one value.

    flip turns a bit of a record's payload after its checksum was made, kept cuts its frame; both are for
    tests of the reader.
    """
    kind = dict(records.dtypes)["log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        one = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([b"".join(parts)], pa.binary())], ["log", "content"])
        for batch in batches:
            bodies = [bytes.fromhex(x) for x in batch.column(2).to_pylist()]
            sums = crc32c_array(pa.array(bodies, pa.binary())).to_pylist()
            for log, data, checksum, flip, kept in zip(batch.column(0).to_pylist(), bodies, sums, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if parts and log != at:
                    yield one()
                    parts = []
                raw = len(data).to_bytes(EDGE, "big") + data + checksum.to_bytes(EDGE, "big")
                if flip:
                    raw = raw[: -EDGE - 1] + bytes([raw[-EDGE - 1] ^ 1]) + raw[-EDGE:]
                at = log
                parts.append(raw if kept is None else raw[:kept])
        if parts:
            yield one()

    rows = records.select("log", "place", "body", "flip", "kept")
    return rows.repartition("log").sortWithinPartitions("log", "place").mapInArrow(run, f"log {kind}, content binary")
