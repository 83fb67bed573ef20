"""The evaluation store: partitions, gold and runs under a root of their own; the task's root gets digests and opaque ids of cases."""

from __future__ import annotations

import posixpath
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generations
from .commits import Log, Refused

#: Tables that never leave the evaluation root.
SEALED = ("partitions", "gold", "runs")


def apart(task_root: str, evaluation_root: str) -> None:
    """Refuses roots of which one is, or lies in, the other."""
    def parts(root: str) -> list[str]:
        u = urlsplit(root)
        return [u.scheme if u.scheme != "file" else "", u.netloc, *[p for p in posixpath.normpath("/" + u.path).split("/") if p]]

    a, b = parts(task_root), parts(evaluation_root)
    if a[: len(b)] == b or b[: len(a)] == a:
        raise Refused("the evaluation root must be apart from the task's")


def opaque(case: Column, key: str) -> Column:
    """A case's name outside the store: a keyed digest under a domain of its own."""
    return F.sha2(F.concat(F.lit(bytearray(b"case\x00" + key.encode() + b"\x00")), case.cast("string").cast("binary")), 256)


def outward(cases: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """opaque_id, n_runs and runs_sha256 of every case: what a task may know of it.

    The digest is of the case's results in order of arm, repetition, category and assertion.
    """
    result = F.struct("arm", "repetition", "category", "assertion", "status", "value")
    shown = lambda r: F.concat_ws(":", *[r[c].cast("string") for c in ("arm", "repetition", "category", "assertion", "status", "value")])
    g = runs.groupBy("case_id").agg(F.count("*").alias("n_runs"), F.array_sort(F.collect_list(result)).alias("all"))  # a rubric's size
    told = g.select("case_id", "n_runs", F.sha2(F.array_join(F.transform("all", shown), "\n"), 256).alias("runs_sha256"))
    return cases.select("case_id").distinct().join(told, "case_id", "left").select(opaque(F.col("case_id"), key).alias("opaque_id"), F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"), "runs_sha256")


def store(spark: SparkSession, task_root: str, evaluation_root: str, tables: dict[str, DataFrame], key: str, epoch: int = 0) -> tuple[str, str]:
    """Commits partitions, gold and runs to the evaluation root, then what may be known of them to the task's; names of both generations."""
    apart(task_root, evaluation_root)
    if sorted(tables) != sorted(SEALED):
        raise Refused("an evaluation is its partitions, gold and runs")
    inside = generations.publish(spark, evaluation_root, tables, epoch)
    told = outward(generations.current(spark, evaluation_root, "partitions"), generations.current(spark, evaluation_root, "runs"), key)
    return inside, generations.publish(spark, task_root, {"evaluations": told}, epoch)


def invalidate(spark: SparkSession, evaluation_root: str, reason: str, epoch: int = 0) -> None:
    """After an exposure: the current generation can't be read any more, and must be replaced by another one."""
    log = Log(spark, f"{evaluation_root}/commits")
    last = [r for r in log.records() if r["record"] == "COMMIT"]
    if not last:
        raise LookupError("no generation was committed")
    gone = last[-1]["generation"]
    log.append({"record": "INVALIDATED", "txn": "", "generation": gone, "tables": [], "epoch": epoch, "reason": reason}, lambda before: next((r for r in before if r["record"] == "INVALIDATED" and r["generation"] == gone), None))


def current(spark: SparkSession, evaluation_root: str, table: str) -> DataFrame:
    """A table of the current generation; one that was exposed is refused."""
    records = Log(spark, f"{evaluation_root}/commits").records()
    last = [r["generation"] for r in records if r["record"] == "COMMIT"]
    if last and any(r["record"] == "INVALIDATED" and r["generation"] == last[-1] for r in records):
        raise Refused("the evaluation was exposed and must be replaced")
    return generations.current(spark, evaluation_root, table)


_KEY = "evaluator"
_CASE = f"shax{{'{(b'case' + bytes(1) + _KEY.encode() + bytes(1)).hex()}' || hex(CAST(c.case_id AS STRING))}}"
QUERIES = {
    "opaque_cases": (
        lambda t: outward(t("cases"), t("results"), _KEY),
        f"""WITH r AS (SELECT case_id, count(*) AS n_runs, sha256(string_agg(concat_ws(':', arm, repetition, category, assertion, status, value), chr(10) ORDER BY arm, repetition, category, assertion)) AS runs_sha256 FROM results GROUP BY case_id)
        SELECT {_CASE} AS opaque_id, coalesce(r.n_runs, 0) AS n_runs, r.runs_sha256 FROM cases c LEFT JOIN r ON c.case_id = r.case_id""",
    ),
}
