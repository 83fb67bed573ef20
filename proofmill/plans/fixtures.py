"""Signed records over the canonical relations, which SQL cannot sign; keys follow from names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.signatures import public, sign, spread


def seed(name) -> bytes:
    return hashlib.sha256(f"key:{name}".encode()).digest()


def _mapped(rows: DataFrame, columns: tuple[str, ...], to: tuple[str, ...], one: Callable[..., tuple[bytes, ...]]) -> DataFrame:
    """rows with the binary columns that one makes of some of theirs."""
    at, schema = [rows.columns.index(c) for c in columns], StructType([*rows.schema.fields, *(StructField(c, BinaryType()) for c in to)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(*x) for x in zip(*(batch.column(k).to_pylist() for k in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[k] for m in made], pa.binary()) for k in range(len(to)))], names)

    return rows.mapInArrow(run, schema)


def signed(rows: DataFrame, signer: str, message: str) -> DataFrame:
    """rows with a signature of the message; signers are names."""
    return _mapped(rows, (signer, message), ("signature",), lambda w, m: (sign(seed(w), m),))


def rotations(rows: DataFrame) -> DataFrame:
    """Rotations (old_key, new_key, signed) as signed records: message, the old key's public_key, signature; unsigned ones carry the new key's."""
    message = F.concat_ws(":", F.lit("rotate"), F.col("old_key").cast("string"), F.col("new_key").cast("string")).cast("binary")
    who = F.when(F.col("signed"), F.col("old_key")).otherwise(-F.col("new_key")).cast("string")
    asked = spread(rows).select("old_key", "new_key", who.alias("who"), F.col("old_key").cast("string").alias("owner"), message.alias("message"))
    made = _mapped(asked, ("who", "owner", "message"), ("signature", "public_key"), lambda w, o, m: (sign(seed(w), m), public(seed(o))))
    return made.select("old_key", "new_key", "message", "public_key", "signature")


def receipts(rows: DataFrame) -> DataFrame:
    """Receipts as records that their keys signed; then some are altered as the relation says."""
    message = F.concat_ws("|", F.lit("receipt"), F.col("receipt").cast("string"), "digest", F.col("fencing_epoch").cast("string"), F.col("authority_epoch").cast("string"))
    made = signed(spread(rows).withColumn("message", message.cast("binary")), "key_id", "message")
    other = F.when(F.col("fault") == "altered", F.concat(F.col("message"), F.lit("!").cast("binary"))).otherwise(F.col("message"))
    cut = F.when(F.col("fault") == "cut", F.expr("substring(signature, 1, 63)")).otherwise(F.col("signature"))
    return made.select("receipt", "key_id", other.alias("message"), cut.alias("signature"), "fencing_epoch", "authority_epoch")


def evaluators(rows: DataFrame) -> DataFrame:
    """(key_id, public_key) of evaluators (key_id)."""
    return _mapped(rows.select("key_id"), ("key_id",), ("public_key",), lambda k: (public(seed(k)),))
