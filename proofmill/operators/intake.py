"""Content intake from bytes: what a file is follows from its first bytes, and a source is taken whole or not at all."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import KINDS, normalised

#: Bytes of a source, bytes that a parser may put out, and how much larger they may be than what was read.
RAW, OUTPUT, RATIO = 67_108_864, 67_108_864, 10
#: Bytes that a stream of compressed data is fed at a time.
STEP = 1 << 16
_SIGNS = {b"\x1f\x8b": 31, b"\x78\x01": 15, b"\x78\x5e": 15, b"\x78\x9c": 15, b"\x78\xda": 15}


def expanded(content: bytes, ratio: int = RATIO, output: int = OUTPUT) -> int:
    """Bytes that content unpacks to; it is unpacked no further than one byte beyond what is allowed.

    Bytes that are not compressed, or break off, count as they are. Nothing that was unpacked is kept.
    """
    if content[:2] not in _SIGNS:
        return len(content)
    most, total, state = min(ratio * len(content), output) + 1, 0, zlib.decompressobj(_SIGNS[content[:2]])
    try:
        for k in range(0, len(content), STEP):
            rest = content[k : k + STEP]
            while rest and total < most:
                total += len(state.decompress(rest, most - total))
                rest = state.unconsumed_tail
            if total >= most or state.eof:
                break
    except zlib.error:
        return max(total, len(content))
    return max(total, len(content))


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [expanded(batch.column(2)[k].as_py() or b"") for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["source_id", "rel_path", "n_expanded"])


def verdicts(files: DataFrame) -> DataFrame:
    """source_id, rel_path, n_bytes and violations of every file (source_id, rel_path, content and perhaps n_bytes), in order of name.

    n_bytes tells the size of a file whose content was not read.

    A file's extension must be a known one, and its first bytes those of that kind; a kind without such
    bytes is text and must be valid UTF-8, without NUL. Sizes hold for a source's files together.
    """
    known = files.sparkSession.createDataFrame([(e, m) for e, _, m, _ in KINDS], "ext string, want_magic string")
    size = F.coalesce(F.octet_length("content"), F.col("n_bytes") if "n_bytes" in files.columns else F.lit(0), F.lit(0)).cast("long")
    rows = files.select("source_id", "rel_path", "content", size.alias("n_bytes"), F.regexp_extract(F.lower("rel_path"), r"\.([a-z]+)$", 1).alias("ext")).join(F.broadcast(known), "ext", "left")
    head, text = F.hex(F.substring("content", 1, 16)), F.col("want_magic") == ""
    packed = F.substring("content", 1, 2).isin(*[bytearray(s) for s in _SIGNS])
    checked = rows.select(
        "source_id", "rel_path", "n_bytes", normalised(F.col("rel_path")).isNull().alias("path"), F.col("want_magic").isNull().alias("extension"), (~text & ~F.like(F.coalesce(head, F.lit("")), F.concat("want_magic", F.lit("%")))).alias("magic"),
        (text & (~F.is_valid_utf8(F.col("content").cast("string")) | (F.position(F.lit(b"\x00"), F.col("content")) > 0))).alias("utf8"), F.coalesce(packed, F.lit(False)).alias("packed"),
    )
    grown = files.filter(F.substring("content", 1, 2).isin(*[bytearray(s) for s in _SIGNS])).select("source_id", "rel_path", "content").mapInArrow(_expanded, f"source_id {dict(files.dtypes)['source_id']}, rel_path string, n_expanded long")
    whole = checked.groupBy("source_id").agg((F.sum("n_bytes") > RAW).alias("size"))
    rows = checked.join(grown.groupBy("source_id", "rel_path").agg(F.max("n_expanded").alias("n_expanded")), ["source_id", "rel_path"], "left").join(whole, "source_id", "left")
    ratio = (F.col("n_expanded") > F.col("n_bytes") * RATIO) | (F.col("n_expanded") > OUTPUT)
    wrong = {"extension": F.col("extension"), "magic": F.col("magic"), "path": F.col("path"), "ratio": ratio, "size": F.col("size"), "utf8": F.col("utf8")}
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in wrong.items()]))
    return rows.select("source_id", "rel_path", "n_bytes", F.array_join(found, ",").alias("violations"))


def accepted(files: DataFrame, found: DataFrame) -> DataFrame:
    """The files of sources of which none violates anything; one violation leaves no file of its source."""
    bad = found.filter("violations <> ''").select("source_id").distinct()
    return files.join(bad, "source_id", "left_anti")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder, the first folder below it being the source; a file above the ceiling is named but not read, and one without a byte is not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    rest = F.expr(f"substring(path, {len(root) + 2})")
    small = files.filter(F.col("length") <= RAW).select(rest.alias("p"), "content", F.col("length").alias("n_bytes"))
    large = files.filter(F.col("length") > RAW).select(rest.alias("p"), F.lit(None).cast("binary").alias("content"), F.col("length").alias("n_bytes"))
    both = small.unionByName(large)
    return both.select(F.substring_index("p", "/", 1).alias("source_id"), F.expr("substring(p, length(substring_index(p, '/', 1)) + 2)").alias("rel_path"), "content", "n_bytes")


_KNOWN = "(VALUES " + ", ".join(str((e, m)) for e, _, m, _ in KINDS) + ") k(ext, want_magic)"
_VERDICTS = f"""v AS (SELECT f.source_id, f.rel_path, f.hexed, CAST(length(f.hexed) / 2 AS BIGINT) AS n_bytes, concat_ws(',', CASE WHEN k.ext IS NULL THEN 'extension' END, CASE WHEN k.want_magic <> '' AND NOT f.hexed LIKE k.want_magic || '%' THEN 'magic' END,
  CASE WHEN sum(length(f.hexed) / 2) OVER (PARTITION BY f.source_id) > {RAW} THEN 'size' END, CASE WHEN k.want_magic = '' AND TRY(decode(unhex(f.hexed))) IS NULL THEN 'utf8' END) AS violations FROM files_in f LEFT JOIN {_KNOWN} ON k.ext = regexp_extract(f.rel_path, '[a-z]+$'))"""
_FILES = lambda t: t("files_in").select("source_id", "rel_path", F.unhex("hexed").alias("content"))
QUERIES = {
    "intake_verdicts": (lambda t: verdicts(_FILES(t)), f"WITH {_VERDICTS} SELECT source_id, rel_path, n_bytes, violations FROM v"),
    "intake_accepted": (
        lambda t: accepted(_FILES(t), verdicts(_FILES(t))).select("source_id", "rel_path", F.sha2("content", 256).alias("digest")),
        f"WITH {_VERDICTS} SELECT source_id, rel_path, sha256(unhex(hexed)) AS digest FROM v WHERE source_id NOT IN (SELECT source_id FROM v WHERE violations <> '')",
    ),
}
