"""Policies: scorecards, impact, capabilities of principals, completion predicates, staleness, keys and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signatures import checked, receipts
from ..plans import fixtures
from ..plans.durable import cut, reach
from ..plans.states import BUDGETS
from .evidence import DETECTORS, redaction
from .lineage import reevaluated

SCORES = ("recurrence", "decision_impact", "evidence_coverage", "testability")
#: Changes whose impact is high.
HIGH = ("invariant", "prohibited_action", "authorization", "side_effect", "classification", "deliverable", "promotion", "user_label")
#: What each principal may read; kinds of events stand for kinds of principals.
CAPABILITIES = (("view", 0), ("view", 1), ("click", 0), ("purchase", 0), ("purchase", 1), ("purchase", 2), ("signup", 3), ("error", 3))
#: Negative paths that must each have a passing test.
NEGATIVE = (
    "bare_locator", "unavoidable_snippets", "unapproved_links", "expired_grant", "changed_while_read", "altered_session", "missing_causality", "unsupported_schema", "forged_attestation", "oversized_source", "prompt_injection", "secrets_in_text",
    "executable_artifact", "sealed_access", "crash_between_records", "interior_corruption", "pause_and_exhaustion", "contaminated_evaluation", "unsigned_receipt", "revoked_during_run", "widened_request", "racing_exports", "denied_export",
)


def scorecards(candidates: DataFrame) -> DataFrame:
    """Every candidate with its total of four scores from 0 to 3, whether it is valid, and its rank among the valid ones of its group."""
    total = reduce(Column.__add__, [F.col(c) for c in SCORES])
    present = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("trigger", "outcome", "scenario")]
    ranged = [F.col(c).between(0, 3) for c in SCORES]
    rows = candidates.withColumns({"total": total.cast("long"), "valid": reduce(Column.__and__, present + ranged)})
    w = Window.partitionBy("group_id", "valid").orderBy(F.desc("total"), F.desc("decision_impact"), F.desc("testability"), "candidate_id")
    return rows.select("candidate_id", "total", "valid", F.when(F.col("valid"), F.row_number().over(w)).cast("long").alias("place"))


def forbidden(accesses: DataFrame) -> DataFrame:
    """Accesses of a data class that the principal's kind may not read."""
    matrix = accesses.sparkSession.createDataFrame(CAPABILITIES, "principal_kind string, data_class long")
    return accesses.join(F.broadcast(matrix), ["principal_kind", "data_class"], "left_anti").select("access_id", "principal_kind", "data_class")


def impact(changes: DataFrame) -> DataFrame:
    return changes.select("change_id", F.when(F.col("subject").isin(*HIGH), "high").otherwise("other").alias("impact"))


def declassified(documents: DataFrame) -> DataFrame:
    """Findings of all detectors before redaction, those that a second pass over its result still has, and the digest of what that leaves.

    Both passes are of one row, so each text is read once and repeated ids stay apart.
    """
    first = redaction(documents.select("doc_id", "text"), "n_before")
    second = redaction(first, "n_after")
    return second.select("doc_id", "n_before", "n_after", F.sha2("text", 256).alias("digest"))


def by_capability(claims: DataFrame) -> DataFrame:
    return claims.groupBy("capability_id", "status", "sensitivity").agg(F.count("*").alias("n_claims"), F.count(F.when(F.col("invariant"), 1)).alias("n_invariants"))


def uncovered(results: DataFrame) -> DataFrame:
    """Negative paths without a passing test that asserts both the error and the absence of side effects."""
    items = results.sparkSession.createDataFrame([(n,) for n in NEGATIVE], "item string")
    return items.join(results.filter("passed and asserts_error and asserts_no_effect").select("item").distinct(), "item", "left_anti")


def matches(approvals: DataFrame, versions: DataFrame) -> DataFrame:
    """Does an approval bind the version as it is? All constituents must be known and equal."""
    pair = approvals.join(versions, "version_id", "left")
    same = [F.coalesce(F.col(f"approved_{c}") == F.col(c), F.lit(False)) for c in ("digest", "compiler", "eval_set")]
    return pair.select("version_id", reduce(Column.__and__, same).alias("binds"))


def parents(versions: DataFrame) -> DataFrame:
    """Updates whose named parent was never approved, or is stale or revoked without being named a repair."""
    up = versions.select(F.col("version_id").alias("parent_id"), F.col("state").alias("parent_state"))
    child = versions.filter("parent_id is not null").select("version_id", "parent_id", "repair").join(up, "parent_id", "left")
    ok = F.col("parent_state").isin("version-approved", "exported", "superseded") | F.col("parent_state").isin("stale", "revoked") & F.col("repair")
    return child.select("version_id", "parent_state", F.coalesce(ok, F.lit(False)).alias("admitted"))


def completion(claims: DataFrame, supports: DataFrame) -> DataFrame:
    """Per capability: may it leave extraction (every claim is supported) and review (no open high-impact claim, no weak invariant)?"""
    had = supports.select("claim_id", F.lit(True).alias("supported")).distinct()
    c = claims.join(had, "claim_id", "left")
    every = lambda x: F.min(F.coalesce(x, F.lit(False)))
    return c.groupBy("capability_id").agg(every(F.col("supported")).alias("extracted"), every(~((F.col("impact") == "high") & (F.col("status") == "provisional") & ~F.col("adjudicated"))).alias("decided"), every(~(F.col("invariant") & (F.col("confidence") == "low"))).alias("compilable"))


def staleness(grants: DataFrame, now: Column) -> DataFrame:
    """What each grant's task may do now: expiry of reading stops reading, expiry of processing or revocation everything."""
    expires = F.least(F.expr("issued_at + INTERVAL 24 HOUR"), "shorter_until", "task_done_at")
    state = F.when(F.coalesce(F.col("revoked_at") <= now, F.lit(False)) | (F.col("derived_processing_until") <= now), "AUTH_STALE").when(expires <= now, "reuse only").when(F.col("issued_at") > now, "not yet").otherwise("read")
    return grants.select("grant_id", state.alias("state"))


def export_states(claims: DataFrame, supports: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Per exported capability after sources were withdrawn: revoked if a high-impact claim lost its support, stale if any changed."""
    after = reevaluated(claims, supports, withdrawn).join(claims.select("claim_id", "capability_id"), "claim_id")
    has = lambda *s: F.max(F.col("status").isin(*s))
    return after.groupBy("capability_id").agg(F.when(has("revoked"), "revoked").when(has("demoted", "invalidated"), "stale").otherwise("exported").alias("state"))


def trusted(rotations: DataFrame, root: int) -> DataFrame:
    """Signing keys to which an unbroken chain of rotations leads from the root, each signed by the key that it replaces."""
    good = checked(rotations, "public_key", "message", "signature", "good").filter("good").select("old_key", "new_key")
    step = lambda front: front.join(good, F.col("key_id") == F.col("old_key")).select(F.col("new_key").alias("key_id"))
    good = cut(good)
    return reach(rotations.sparkSession.createDataFrame([(root,)], "key_id long"), step, ["key_id"])


def purges(log: DataFrame, epoch: int) -> DataFrame:
    """Every purge: done if its result follows its receipt and that its preparation, all under the current epoch, else to be resumed, redone or refused."""
    at = {k: F.min(F.when(F.col("record") == k, F.col("seq"))) for k in ("PREPARE", "RECEIPT", "RESULT")}
    g = log.groupBy("purge_id").agg(*[c.alias(k) for k, c in at.items()], F.min("epoch").alias("epoch"))
    disordered = F.coalesce(F.least("RECEIPT", "RESULT") < F.col("PREPARE"), F.lit(False)) | F.coalesce(F.col("RESULT") < F.col("RECEIPT"), F.lit(False))
    state = F.when(F.col("PREPARE").isNull() | disordered, "refuse").when(F.col("epoch") < epoch, "redo").when(F.col("RECEIPT").isNull() | F.col("RESULT").isNull(), "resume").otherwise("done")
    return g.select("purge_id", state.alias("state"))


def released_early(roots: DataFrame) -> DataFrame:
    """Cases whose content was released before they were assigned to a partition."""
    return roots.filter("released_seq < assigned_seq").select("case_id", "root_id")


def leaked_examples(examples: DataFrame, cases: DataFrame) -> DataFrame:
    """Generated examples that are validation or sealed cases."""
    return examples.join(cases.select(F.col("case_id").alias("example_id"), "kind"), "example_id").select("example_id", "kind")


def progress(log: DataFrame) -> DataFrame:
    """The compact view of a task: phase, records, last event and time, resumptions."""
    g = log.groupBy("task_id").agg(F.max_by(F.struct("to_phase", "event", "ts"), "seq").alias("s"), F.count("*").alias("n_records"), F.count(F.when(F.col("event") == "resume", 1)).alias("n_resumed"))
    return g.select("task_id", "s.to_phase", F.col("s.event").alias("last_event"), F.col("s.ts").alias("last_at"), "n_records", "n_resumed")


def over_budget(usage: DataFrame) -> DataFrame:
    """Every task with the limits it exceeds, in order of name, and the state that follows."""
    over = F.array_compact(F.array(*[F.when(F.col(c) > limit, c) for c, limit in sorted(BUDGETS.items())]))
    return usage.select("task_id", F.array_join(over, ",").alias("exceeded"), F.when(F.size(over) > 0, "SUSPENDED_EXHAUSTED").otherwise("within").alias("state"))


def scored(assertions: DataFrame) -> DataFrame:
    """Every assertion's value from 0 to 1 by its typed scorer; an unknown type or a missing observation is worth nothing."""
    e, o = F.col("expected"), F.col("observed")
    x, y = e.try_cast("double"), o.try_cast("double")
    parts, got = F.split(e, " "), F.split(o, " ")
    value = (
        F.when(F.col("scorer") == "boolean", (o == "true").cast("double")).when(F.col("scorer") == "exact", (e == o).cast("double"))
        .when(F.col("scorer") == "number", (F.abs(x - y) <= 0.5).cast("double")).when(F.col("scorer") == "contains", F.contains(o, e).cast("double"))
        .when(F.col("scorer") == "set", F.size(F.array_intersect(parts, got)) / F.size(F.array_distinct(parts)))
    )
    return assertions.select("assertion_id", F.round(F.coalesce(value, F.lit(0.0)), 6).alias("value"))


_CANDIDATES = """SELECT doc_id AS candidate_id, doc_id % 7 AS group_id, CASE WHEN doc_id % 9 <> 4 THEN 'when asked' END AS trigger, CASE WHEN doc_id % 11 = 5 THEN '' ELSE 'a decision' END AS outcome, 'a case' AS scenario,
  doc_id % 4 AS recurrence, div{doc_id, 4} % CASE WHEN doc_id % 50 = 9 THEN 6 ELSE 4 END AS decision_impact, div{doc_id, 16} % 4 AS evidence_coverage, div{doc_id, 5} % 4 AS testability FROM documents"""
_ACCESSES = "SELECT event_id AS access_id, event_type AS principal_kind, user_id % 4 AS data_class FROM events"
_SUBJECTS = "CASE user_id % 12 " + " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HIGH)) + " ELSE 'wording' END"
_CHANGES = f"SELECT event_id AS change_id, {_SUBJECTS} AS subject FROM events"
_TESTS = "SELECT CASE event_id % 25 " + " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(NEGATIVE)) + " ELSE 'other' END AS item, event_type <> 'error' AS passed, event_id % 25 <> 3 AS asserts_error, event_id % 25 <> 5 OR user_id < 0 AS asserts_no_effect FROM events"
_APPROVALS = "SELECT version_id, approved_digest, 'c' || CAST(version_id % 3 AS STRING) AS approved_compiler, CASE WHEN version_id % 17 <> 2 THEN 'e1' END AS approved_eval_set FROM versions"
_AS_IS = "SELECT version_id, digest, 'c' || CAST(version_id % 3 + CASE WHEN version_id % 19 = 4 THEN 1 ELSE 0 END AS STRING) AS compiler, 'e1' AS eval_set FROM versions"
_ROTATIONS = "SELECT s_suppkey AS old_key, s_suppkey * 2 + k.k AS new_key, s_suppkey % 7 <> 5 AS signed FROM supplier CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) k"
_PURGES = "SELECT o_orderkey AS purge_id, k.record, CASE WHEN o_orderkey % 10 = 7 THEN 2 - k.seq WHEN o_orderkey % 10 = 9 AND k.seq > 0 THEN 3 - k.seq ELSE k.seq END AS seq, CASE WHEN o_orderkey % 8 = 3 THEN 1 ELSE 2 END AS epoch FROM orders CROSS JOIN (SELECT 'PREPARE' AS record, 0 AS seq UNION ALL SELECT 'RECEIPT', 1 UNION ALL SELECT 'RESULT', 2) k WHERE NOT (o_orderkey % 6 = 1 AND k.seq = 2) AND NOT (o_orderkey % 6 = 2 AND k.seq = 0)"
_EXAMPLES = "SELECT doc_id AS example_id FROM documents WHERE doc_id % 10 = 3"
_USED = "SELECT task_id, count(*) * 5000000 AS redacted_bytes, count(*) * 9500 AS events, task_id % 15 AS questions, task_id % 5 AS retries, task_id % 4 AS passes, 2 AS iterations, task_id % 7 AS pages, task_id % 120 AS candidates, count(*) * 500 AS active_seconds FROM task_log GROUP BY task_id"
_ASSERTED = """SELECT event_id AS assertion_id, CASE event_id % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'exact' WHEN 2 THEN 'number' WHEN 3 THEN 'contains' WHEN 4 THEN 'set' ELSE 'model' END AS scorer,
  CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'click' WHEN 2 THEN '10' WHEN 3 THEN 'ic' ELSE 'a b c' END AS expected, CASE WHEN user_id % 10 = 3 THEN NULL ELSE CASE event_id % 6 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END WHEN 2 THEN CAST(user_id % 12 AS STRING) WHEN 4 THEN CASE user_id % 4 WHEN 0 THEN 'c a' WHEN 1 THEN 'x b b' WHEN 2 THEN 'c b a' ELSE '' END ELSE event_type END END AS observed FROM events"""
_WITHDRAWN = "SELECT s_suppkey % 97 AS source_id FROM supplier WHERE s_suppkey % 4 = 1 AND s_suppkey < 60 GROUP BY 1"


def _passes() -> str:
    """Two passes in DuckDB: each detector counts and redacts what those before it have left."""
    sql = "SELECT doc_id, text, 0 AS n_before, 0 AS n_after FROM documents"
    for n in ("n_before", "n_after"):
        for _, mark, pattern in DETECTORS:
            sql = f"SELECT * REPLACE (regexp_replace(text, '{pattern}', '{mark}', 'g') AS text, {n} + len(regexp_extract_all(coalesce(text, ''), '{pattern}')) AS {n}) FROM ({sql}) t"
    return f"SELECT doc_id, CAST(n_before AS BIGINT) AS n_before, CAST(n_after AS BIGINT) AS n_after, sha256(text) AS digest FROM ({sql}) t"


QUERIES = {
    "scorecards": (
        lambda t: scorecards(t.sql(_CANDIDATES)),
        f"""WITH c AS ({_CANDIDATES}), v AS (SELECT *, recurrence + decision_impact + evidence_coverage + testability AS total, coalesce(trigger, '') <> '' AND coalesce(outcome, '') <> '' AND coalesce(scenario, '') <> '' AND greatest(recurrence, decision_impact, evidence_coverage, testability) <= 3 AS valid FROM c)
        SELECT a.candidate_id, a.total, a.valid, CASE WHEN a.valid THEN (SELECT count(*) + 1 FROM v b WHERE b.valid AND b.group_id = a.group_id AND (b.total, b.decision_impact, b.testability, -b.candidate_id) > (a.total, a.decision_impact, a.testability, -a.candidate_id)) END AS place FROM v a""",
    ),
    "forbidden_accesses": (
        lambda t: forbidden(t.sql(_ACCESSES)),
        f"WITH a AS ({_ACCESSES}) SELECT * FROM a WHERE principal_kind || data_class NOT IN ({', '.join(repr(p + str(c)) for p, c in CAPABILITIES)})",
    ),
    "change_impact": (lambda t: impact(t.sql(_CHANGES)), "SELECT event_id AS change_id, CASE WHEN user_id % 12 < 8 THEN 'high' ELSE 'other' END AS impact FROM events"),
    "declassified_documents": (
        lambda t: declassified(t("documents")),
        _passes(),
    ),
    "evidence_by_capability": (
        lambda t: by_capability(t("claims")),
        "SELECT capability_id, status, sensitivity, count(*) AS n_claims, CAST(sum(CASE WHEN invariant THEN 1 ELSE 0 END) AS BIGINT) AS n_invariants FROM claims GROUP BY ALL",
    ),
    "uncovered_negative_paths": (
        lambda t: uncovered(t.sql(_TESTS)),
        f"WITH r AS ({_TESTS}) SELECT i.item FROM (SELECT unnest({list(NEGATIVE)!r}) AS item) i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.item = i.item AND passed AND asserts_error AND asserts_no_effect)",
    ),
    "approval_bindings": (
        lambda t: matches(t.sql(_APPROVALS), t.sql(_AS_IS)),
        "SELECT version_id, digest = approved_digest AND version_id % 19 <> 4 AND version_id % 17 <> 2 AS binds FROM versions",
    ),
    "update_parents": (
        lambda t: parents(t("versions")),
        "SELECT c.version_id, p.state AS parent_state, CASE WHEN p.state IN ('exported', 'superseded', 'version-approved') THEN true WHEN p.state IN ('revoked', 'stale') THEN c.repair ELSE false END AS admitted FROM versions c LEFT JOIN versions p ON c.parent_id = p.version_id WHERE c.parent_id IS NOT NULL",
    ),
    "completion_predicates": (
        lambda t: completion(t("claims").withColumn("capability_id", F.col("claim_id") % 331), t("supports")),
        """SELECT claim_id % 331 AS capability_id, count(*) FILTER (WHERE claim_id NOT IN (SELECT claim_id FROM supports)) = 0 AS extracted, count(*) FILTER (WHERE impact = 'high' AND status = 'provisional' AND NOT adjudicated) = 0 AS decided,
        count(*) FILTER (WHERE invariant AND confidence = 'low') = 0 AS compilable FROM claims GROUP BY claim_id % 331""",
    ),
    "grant_staleness": (
        lambda t: staleness(t("grants"), F.expr("TIMESTAMP_NTZ '2024-01-16 05:00:00'")),
        """WITH n AS (SELECT *, TIMESTAMP '2024-01-16 05:00:00' AS now FROM grants) SELECT grant_id, CASE WHEN coalesce(revoked_at <= now, false) OR derived_processing_until <= now THEN 'AUTH_STALE' WHEN issued_at + INTERVAL 1 DAY <= now OR coalesce(shorter_until <= now, false) OR coalesce(task_done_at <= now, false) THEN 'reuse only' WHEN issued_at > now THEN 'not yet' ELSE 'read' END AS state FROM n""",
    ),
    "export_states": (
        lambda t: export_states(t("claims").withColumn("capability_id", F.col("claim_id") % 331), t("supports"), t.sql(_WITHDRAWN)),
        f"""WITH w AS ({_WITHDRAWN}), s AS (SELECT c.claim_id % 331 AS capability_id, c.claim_id, c.impact, count(DISTINCT s.source_id) AS had, count(DISTINCT CASE WHEN w.source_id IS NULL THEN s.source_id END) AS kept FROM claims c LEFT JOIN supports s ON c.claim_id = s.claim_id LEFT JOIN w ON w.source_id = s.source_id GROUP BY ALL)
        SELECT capability_id, CASE WHEN bool_or(kept < had AND kept = 0 AND impact = 'high') THEN 'revoked' WHEN bool_or(kept < had) THEN 'stale' ELSE 'exported' END AS state FROM s GROUP BY capability_id""",
    ),
    "trusted_keys": (
        lambda t: trusted(fixtures.rotations(t.sql(_ROTATIONS)), 0),
        f"WITH RECURSIVE k AS ({_ROTATIONS}), r AS (SELECT CAST(0 AS BIGINT) AS key_id UNION SELECT k.new_key FROM r JOIN k ON k.old_key = r.key_id WHERE k.signed) SELECT key_id FROM r",
    ),
    "receipt_verdicts": (
        lambda t: receipts(fixtures.receipts(t("receipts")), fixtures.evaluators(t("evaluators")), t("epochs")),
        """SELECT receipt, CASE WHEN r.key_id NOT IN (SELECT key_id FROM evaluators) THEN 'unknown key' WHEN fault IN ('altered', 'cut') THEN 'not signed' WHEN fencing_epoch < (SELECT fencing FROM epochs) OR authority_epoch < (SELECT authority FROM epochs) THEN 'stale' ELSE 'accepted' END AS status FROM receipts r""",
    ),
    "purge_protocol": (
        lambda t: purges(t.sql(_PURGES), 2),
        f"""WITH p AS ({_PURGES}), g AS (SELECT purge_id, string_agg(record, ',' ORDER BY seq) AS s, min(epoch) AS epoch FROM p GROUP BY purge_id)
        SELECT purge_id, CASE WHEN s NOT LIKE 'PREPARE%' OR s LIKE '%RESULT,RECEIPT' THEN 'refuse' WHEN epoch < 2 THEN 'redo' WHEN s = 'PREPARE,RECEIPT,RESULT' THEN 'done' ELSE 'resume' END AS state FROM g""",
    ),
    "early_releases": (lambda t: released_early(t("roots")), "SELECT case_id, root_id FROM roots WHERE NOT released_seq >= assigned_seq"),
    "leaked_examples": (lambda t: leaked_examples(t.sql(_EXAMPLES), t("cases")), "SELECT case_id AS example_id, kind FROM cases WHERE case_id % 10 = 3"),
    "task_progress": (
        lambda t: progress(t("task_log")),
        "SELECT task_id, arg_max(to_phase, seq) AS to_phase, arg_max(event, seq) AS last_event, arg_max(ts, seq) AS last_at, count(*) AS n_records, count(*) FILTER (WHERE event = 'resume') AS n_resumed FROM task_log GROUP BY task_id",
    ),
    "task_budgets": (
        lambda t: over_budget(t.sql(_USED)),
        f"WITH u AS ({_USED}), x AS (SELECT task_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} > {n} THEN '{c}' END" for c, n in sorted(BUDGETS.items())) + ") AS exceeded FROM u) SELECT *, CASE exceeded WHEN '' THEN 'within' ELSE 'SUSPENDED_EXHAUSTED' END AS state FROM x",
    ),
    "assertion_values": (
        lambda t: scored(t.sql(_ASSERTED)),
        f"""WITH a AS ({_ASSERTED}) SELECT assertion_id, CASE WHEN observed IS NULL THEN 0.0 WHEN scorer IN ('boolean', 'exact') THEN CASE WHEN observed = expected THEN 1.0 ELSE 0.0 END WHEN scorer = 'number' THEN CASE WHEN abs(TRY_CAST(observed AS DOUBLE) - 10) <= 0.5 THEN 1.0 ELSE 0.0 END
        WHEN scorer = 'contains' THEN CASE WHEN position('ic' IN observed) > 0 THEN 1.0 ELSE 0.0 END WHEN scorer = 'set' THEN round(len(list_intersect(['a', 'b', 'c'], string_split(observed, ' '))) / 3.0, 6) ELSE 0.0 END AS value FROM a""",
    ),
}
