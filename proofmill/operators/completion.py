"""Completion predicates: what must be recorded before a state of a task counts as reached. Whatever is unknown fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import cut
from ..plans.relations import Reader

#: The states that have a predicate, and how often each case must have been run.
STATES = ("SOURCE_REVIEW", "INGEST", "MAP", "CAPABILITY_REVIEW", "EXTRACT", "COMPILE", "VERSION_REVIEW", "EXPORT_REVIEW", "DONE")
REPETITIONS = 3
#: Steps of tasks that one partition holds.
STEPS = 1 << 18


def _each(items: DataFrame, ok: dict[str, Column]) -> DataFrame:
    """An item (task_id, state, ok) per row and state; null is not ok."""
    said = F.array(*[F.struct(F.lit(s).alias("state"), F.coalesce(c, F.lit(False)).alias("ok")) for s, c in ok.items()])
    return items.select("task_id", F.explode(said).alias("item")).select("task_id", "item.state", "item.ok")


def _rows(items: DataFrame, ok: Column, *states: str) -> DataFrame:
    return _each(items, dict.fromkeys(states, ok))


def _said(*columns: str) -> Column:
    return reduce(Column.__and__, [F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False)) for c in columns])


def sources(modes: DataFrame, selectors: DataFrame) -> DataFrame:
    """A search needs its grants, metadata alone and cursors that ended or were stopped by a budget; without one, sources are named by the user or have a valid snapshot."""
    searched = F.col("search_granted") & F.col("retain_granted") & F.col("metadata_only") & F.col("cursor").isin("exhausted", "budget")
    direct = F.coalesce(F.col("user_named"), F.lit(False)) | F.coalesce(F.col("snapshot") == "valid", F.lit(False))
    granted = F.col("content_granted") & F.col("attested") & F.col("principal_ok") & _said("revision")
    reviewed, known = F.when(F.col("mode") == "discover", searched).when(F.col("mode").isin("distill", "update"), direct), F.col("snapshot").isin("valid", "excluded")
    return _each(selectors.join(modes, "task_id", "left"), {"SOURCE_REVIEW": reviewed, "INGEST": granted, "MAP": known, "CAPABILITY_REVIEW": known})


def mapped(candidates: DataFrame) -> DataFrame:
    """A candidate has a trigger, an outcome, a scenario, a scorecard and links to evidence."""
    return _rows(candidates, _said("trigger", "outcome", "scenario") & F.col("total").between(0, 12) & (F.col("n_links") > 0), "MAP", "CAPABILITY_REVIEW")


def filled(fields: DataFrame) -> DataFrame:
    """A field of the model is filled or marked as unsupported, never both."""
    return _rows(fields, _said("value") != F.coalesce("unsupported", F.lit(False)), "EXTRACT")


def derived(claims: DataFrame) -> DataFrame:
    """A claim has a derivation."""
    return _rows(claims, F.col("n_derivations") > 0, "EXTRACT")


def settled(claims: DataFrame) -> DataFrame:
    """No claim of high impact is open, no invariant of low confidence."""
    opened = (F.col("impact") == "high") & (F.col("status") == "provisional") & ~F.coalesce("adjudicated", F.lit(False))
    return _rows(claims, ~opened & ~(F.col("invariant") & (F.col("confidence") == "low")), "COMPILE")


def sound(drafts: DataFrame) -> DataFrame:
    """A draft passes its four checks."""
    return _rows(drafts, (F.col("schema_errors") == 0) & (F.col("chain_gaps") == 0) & (F.col("sensitive_findings") == 0) & (F.col("executables") == 0), "COMPILE")


def evaluated(evaluations: DataFrame) -> DataFrame:
    """All partitions are isolated, all repetitions ended, nothing is contaminated and the gates are met."""
    return _rows(evaluations, F.col("isolated") & (F.col("repetitions") == REPETITIONS) & ~F.col("contaminated") & F.col("gates_met"), "VERSION_REVIEW")


def approved(approvals: DataFrame) -> DataFrame:
    return _rows(approvals, F.col("approved_subject") == F.col("subject"), "EXPORT_REVIEW")


def exported(consents: DataFrame) -> DataFrame:
    """The consent names the destination, manifest, collision policy and subject as they are, and what was written is what was meant."""
    same = [F.col(f"consented_{c}") == F.col(c) for c in ("destination", "manifest", "policy", "subject")]
    return _rows(consents, reduce(Column.__and__, same) & (F.col("found_digest") == F.col("digest")), "DONE")


def predicates(modes: DataFrame, selectors: DataFrame, candidates: DataFrame, fields: DataFrame, claims: DataFrame, drafts: DataFrame, evaluations: DataFrame, approvals: DataFrame, consents: DataFrame, parts: int = 0) -> DataFrame:
    """task_id, state, n_items, n_failed and holds of every state that a task has items for; a state without any has no row, and does not hold.

    Of the two kinds of items that mapping, extracting and compiling ask for, neither may be absent. Each kind is counted
    alone; the counts are dealt by task to so many parts, if they are given.
    """
    kinds = [sources(modes, selectors), mapped(candidates), filled(fields), derived(claims), settled(claims), sound(drafts), evaluated(evaluations), approved(approvals), exported(consents)]
    failed = F.count(F.when(~F.col("ok"), 1))
    counted = [k.groupBy("task_id", "state").agg(F.count("*").alias("n_items"), failed.alias("n_failed")).withColumn("kind", F.lit(n)) for n, k in enumerate(kinds)]
    rows = reduce(DataFrame.unionByName, counted)
    rows = rows.repartition(parts, "task_id") if parts else rows
    need = F.when(F.col("state").isin("MAP", "CAPABILITY_REVIEW", "EXTRACT", "COMPILE"), 2).otherwise(1)
    g = rows.groupBy("task_id", "state").agg(F.sum("n_items").alias("n_items"), F.sum("n_failed").alias("n_failed"), F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))
    return g.select("task_id", "state", "n_items", "n_failed", ((F.col("n_failed") == 0) & (F.bit_count("kinds") >= need)).alias("holds"))


def unmet(log: DataFrame, found: DataFrame) -> DataFrame:
    """Records by which a task reached a state whose predicate does not hold, with the items that fail (null: it has none).

    A task's states, nine at most, meet its records as one row, so what is dealt by task stays where it is.
    """
    at = log.filter(F.col("to_phase").isin(*STATES)).select("task_id", "seq", F.col("to_phase").alias("state"))
    said = found.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("n_failed", "holds")))).alias("said"))
    own = at.join(said, "task_id", "left").select("task_id", "seq", "state", F.col("said")[F.col("state")].alias("own"))
    return own.filter("not coalesce(own.holds, false)").select("task_id", "seq", "state", "own.n_failed")


def numbered(t: Reader) -> int:
    """The steps of tasks, on which all tables of items stand, are numbered once and then dealt by task; to how many parts.

    There are as many as the rows need: flags of items take so few bytes in a shuffle that partitions
    which are joined up by bytes would hold millions of rows.
    """
    events = t("events").select("event_id", "ts", "user_id")
    parts = max(t.spark.sparkContext.defaultParallelism, -(-events.count() // STEPS))
    t.known["events"] = events.repartition(parts, "user_id")
    t.known["task_steps"] = cut(t("task_steps")).repartition(parts, "task_id")
    return parts


def _predicates(t: Reader) -> DataFrame:
    parts = numbered(t)
    return predicates(*map(t, _TABLES), parts)


_TABLES = ("task_modes", "task_selectors", "task_candidates", "task_fields", "task_claims", "task_drafts", "task_evaluations", "task_approvals", "task_consents")
_ITEMS = """i AS (SELECT s.task_id, 'SOURCE_REVIEW' AS state, 0 AS kind, CASE WHEN m.mode = 'discover' THEN search_granted AND retain_granted AND metadata_only AND cursor <> 'open' ELSE user_named OR snapshot = 'valid' END AS ok FROM task_selectors s JOIN task_modes m ON s.task_id = m.task_id
  UNION ALL SELECT task_id, 'INGEST', 0, content_granted AND attested AND principal_ok AND revision IS NOT NULL FROM task_selectors UNION ALL SELECT task_id, k.state, 0, snapshot <> 'stale' FROM task_selectors CROSS JOIN (SELECT 'MAP' AS state UNION ALL SELECT 'CAPABILITY_REVIEW') k
  UNION ALL SELECT task_id, k.state, 1, trigger <> '' AND outcome <> '' AND scenario <> '' AND total <= 12 AND n_links > 0 FROM task_candidates CROSS JOIN (SELECT 'MAP' AS state UNION ALL SELECT 'CAPABILITY_REVIEW') k
  UNION ALL SELECT task_id, 'EXTRACT', 2, (value IS NULL) = unsupported FROM task_fields UNION ALL SELECT task_id, 'EXTRACT', 3, n_derivations > 0 FROM task_claims
  UNION ALL SELECT task_id, 'COMPILE', 4, NOT (impact = 'high' AND status = 'provisional' AND NOT adjudicated OR invariant AND confidence = 'low') FROM task_claims UNION ALL SELECT task_id, 'COMPILE', 5, greatest(schema_errors, chain_gaps, sensitive_findings, executables) = 0 FROM task_drafts
  UNION ALL SELECT task_id, 'VERSION_REVIEW', 6, isolated AND repetitions = 3 AND gates_met AND NOT contaminated FROM task_evaluations UNION ALL SELECT task_id, 'EXPORT_REVIEW', 7, approved_subject = subject FROM task_approvals
  UNION ALL SELECT task_id, 'DONE', 8, (consented_destination, consented_manifest, consented_policy, consented_subject, found_digest) = (destination, manifest, policy, subject, digest) FROM task_consents),
  p AS (SELECT task_id, state, count(*) AS n_items, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS n_failed, count(DISTINCT kind) >= CASE WHEN state IN ('MAP', 'CAPABILITY_REVIEW', 'EXTRACT', 'COMPILE') THEN 2 ELSE 1 END AS whole FROM i GROUP BY task_id, state)"""
QUERIES = {
    "state_predicates": (_predicates, f"WITH {_ITEMS} SELECT task_id, state, n_items, n_failed, whole AND n_failed = 0 AS holds FROM p"),
    "unmet_completions": (
        lambda t: unmet(found=_predicates(t), log=t("task_log")),
        f"WITH {_ITEMS} SELECT l.task_id, l.seq, l.to_phase AS state, p.n_failed FROM task_log l LEFT JOIN p ON p.task_id = l.task_id AND p.state = l.to_phase WHERE l.to_phase IN {STATES} AND NOT coalesce(p.whole AND p.n_failed = 0, false)",
    ),
}
