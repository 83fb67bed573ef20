"""Immutable generations of tables: written once, known by a digest of their rows, current by a commit log."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Log, Refused

COMMITS = "generation string, tables string, number long"


def manifest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest that does not depend on their order; repeats count."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    found = rows.agg(F.count("*").alias("n"), *[part(k).alias(f"s{k}") for k in range(5)]).first()
    return found["n"], "-".join(str(found[f"s{k}"] or 0) for k in range(5))


def prepare(spark: SparkSession, root: str, tables: dict[str, DataFrame], epoch: int = 0, txn: str | None = None) -> tuple[str, str]:
    """(transaction, generation): records the intent, then writes the tables into a folder named by what they hold.

    A generation that is there whole is not written again. One that has no commit is never current.
    """
    txn = txn or uuid.uuid4().hex
    known = [f"{name}:{n}:{digest}" for name, (n, digest) in sorted((name, manifest(df)) for name, df in tables.items())]
    generation = hashlib.sha256("\n".join(known).encode()).hexdigest()[:32]
    log = Log(spark, f"{root}/commits")

    def admit(before: list[dict]) -> dict | None:
        _fence(before, epoch)
        return next((r for r in before if r["record"] == "PREPARE" and r["txn"] == txn), None)

    found = log.append({"record": "PREPARE", "txn": txn, "generation": generation, "tables": sorted(tables), "epoch": epoch}, admit)
    if found["generation"] != generation:
        raise Refused("the transaction prepared another generation")
    if not any(r["record"] == "COMMIT" and r["generation"] == generation for r in log.records()):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/generations/{generation}/{name}")
    return txn, generation


def commit(spark: SparkSession, root: str, txn: str, epoch: int = 0) -> str:
    """Makes a prepared generation current; a second time it changes nothing. A writer of an older epoch is refused."""

    def admit(before: list[dict]) -> dict | None:
        done = next((r for r in before if r["record"] == "COMMIT" and r["txn"] == txn), None)
        if done:
            return done
        _fence(before, epoch)
        if not any(r["record"] == "PREPARE" and r["txn"] == txn for r in before):
            raise Refused("nothing was prepared")
        return None

    log = Log(spark, f"{root}/commits")
    mine = next((r for r in log.records() if r["record"] == "PREPARE" and r["txn"] == txn), {"generation": None, "tables": []})
    return log.append({"record": "COMMIT", "txn": txn, "generation": mine["generation"], "tables": mine["tables"], "epoch": epoch}, admit)["generation"]


def _fence(before: list[dict], epoch: int) -> None:
    if any(r["epoch"] > epoch for r in before):
        raise Refused("a newer epoch has begun")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], epoch: int = 0) -> str:
    """Writes tables as a generation named by what they hold, then its commit; returns the name."""
    txn, generation = prepare(spark, root, tables, epoch)
    commit(spark, root, txn, epoch)
    return generation


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The commits of all generations, in order of number."""
    rows = [(r["generation"], ",".join(r["tables"]), r["number"]) for r in Log(spark, f"{root}/commits").records() if r["record"] == "COMMIT"]
    return spark.createDataFrame(rows, COMMITS)


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the last committed generation."""
    last = [r for r in Log(spark, f"{root}/commits").records() if r["record"] == "COMMIT"]
    if not last:
        raise LookupError("no generation was committed")
    return spark.read.parquet(f"{root}/generations/{last[-1]['generation']}/{table}")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last state of each key in an append-only registry."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")
