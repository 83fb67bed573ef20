"""The task's state machine: its log, its protocols, its budgets, and what recovery makes of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import binlog
from .durable import cut, descendants
from .relations import ANYWHERE, PHASES, REENTRIES, RESUMABLE, TERMINAL, TRANSITIONS

#: A task's limits by what is counted.
BUDGETS = {"redacted_bytes": 52_428_800, "events": 100_000, "questions": 12, "retries": 3, "passes": 3, "iterations": 3, "pages": 5, "candidates": 100, "active_seconds": 5400}


def task():
    """A task's records in order."""
    return Window.partitionBy("task_id").orderBy("seq")


def before():
    """The records before one."""
    return task().rowsBetween(Window.unboundedPreceding, -1)


def transition_table(spark) -> DataFrame:
    """All transitions; a "+" leads back to the phase that was left, a "*" stands for any phase that is not terminal."""
    rows = [*TRANSITIONS, *(("*", e, to) for e, to in ANYWHERE)]
    return spark.createDataFrame(rows, "from_phase string, event string, to_phase string")


def _prior() -> Column:
    """The phase before the suspension that a record stands in."""
    left = F.when(~F.col("from_phase").isin(*RESUMABLE), F.col("from_phase"))
    return F.last(F.when(~F.col("to_phase").isin(*RESUMABLE), F.col("to_phase")).otherwise(left), ignorenulls=True).over(before())


def _returns(prior: str) -> Column:
    """Does a return lead where it must: to the phase that was left, or after a loss of authority to the earliest invalidated one?"""
    to = F.when(F.col("event") == "authority_renewed", F.col("earliest_phase")).otherwise(F.col(prior))
    return F.coalesce(F.col("to_phase") == to, F.lit(False))


def illegal(log: DataFrame) -> DataFrame:
    """Records whose transition the table does not have.

    What any phase admits holds for active ones only, but for a cancellation, which any phase that is not
    terminal admits; a suspended task leads back where it was left.
    """
    table = transition_table(log.sparkSession)
    named = F.broadcast(table.filter("from_phase <> '*' and to_phase <> '+'").withColumn("legal", F.lit(True)))  # the table's rows
    free = F.element_at(F.create_map(*[F.lit(x) for pair in ANYWHERE for x in pair]), F.col("event"))
    barred = F.col("from_phase").isin(*TERMINAL) | (F.col("from_phase").isin(*RESUMABLE) & (F.col("event") != "cancel"))
    anywhere = ~barred & F.coalesce(free == F.col("to_phase"), F.lit(False))
    back = reduce(Column.__or__, [(F.col("from_phase") == f) & (F.col("event") == e) for f, e, to in TRANSITIONS if to == "+"])
    rows = log.withColumn("prior", _prior()).join(named, ["from_phase", "event", "to_phase"], "left")
    return rows.filter(F.col("legal").isNull() & ~anywhere & ~(back & _returns("prior"))).select("task_id", "seq", "from_phase", "event", "to_phase")


def replay(log: DataFrame) -> DataFrame:
    """Every task's phase, epochs, and whether it is over, can be resumed or is active."""
    last = log.groupBy("task_id").agg(F.max_by(F.struct("to_phase", "run_epoch"), "seq").alias("s"), F.max("fencing_epoch").alias("fencing_epoch"), F.count("*").alias("n_records"))
    phase = F.col("s.to_phase")
    kind = F.when(phase.isin(*TERMINAL), "terminal").when(phase.isin(*RESUMABLE), "resumable").otherwise("active")
    return last.select("task_id", phase.alias("phase"), F.col("s.run_epoch").alias("run_epoch"), "fencing_epoch", "n_records", kind.alias("kind"))


def breaks(log: DataFrame) -> DataFrame:
    """Records that leave another phase than the last one entered, fall behind the fencing epoch, step back in run epoch, or re-enter without a new one."""
    seen = log.withColumns({"entered": F.lag("to_phase").over(task()), "fence": F.max("fencing_epoch").over(before()), "epoch": F.lag("run_epoch").over(task())})
    no = lambda c: F.coalesce(c, F.lit(False))
    stale = F.col("event").isin(*REENTRIES) & (F.col("run_epoch") <= F.col("epoch"))
    out = seen.select("task_id", "seq", no(F.col("entered") != F.col("from_phase")).alias("jumped"), no(F.col("fencing_epoch") < F.col("fence")).alias("fenced"), no(F.col("run_epoch") < F.col("epoch")).alias("went_back"), no(stale).alias("old_epoch"))
    return out.filter("jumped or fenced or went_back or old_epoch")


def resumed(log: DataFrame) -> DataFrame:
    """Every return from a suspension: the phase that was recorded before it, and whether the task went where it must."""
    events = [e for _, e, to in TRANSITIONS if to == "+"]
    rows = log.withColumn("prior", _prior()).filter(F.col("from_phase").isin(*RESUMABLE) & F.col("event").isin(*events))
    return rows.select("task_id", "seq", "prior", _returns("prior").alias("restored"))


def logs(records: DataFrame) -> DataFrame:
    """The bytes of every task's log, written to the shared folder, as (log, content)."""
    return cut(binlog.packed(records.withColumnRenamed("task_id", "log")))


def verified(records: DataFrame) -> DataFrame:
    """Every log, read back from its bytes: frames, how many verify from the start and up to which byte, and the verdict."""
    return binlog.verified(binlog.frames(logs(records), "log")).withColumnRenamed("log", "task_id")


def frames(records: DataFrame) -> DataFrame:
    """Every frame of every log as it is read back: its place in the bytes, what it says, and whether it is whole and its checksum right."""
    found = binlog.frames(logs(records), "log")
    sound = F.col("whole") & F.coalesce("checksum_ok", F.lit(False))
    return found.select(F.col("log").alias("task_id"), "byte_offset", "n_bytes", "seq", "fencing_epoch", "record_hash", sound.alias("sound"))


def commits(records: DataFrame, epoch: int = 2) -> DataFrame:
    """Every transaction: are its records in order and its receipt of the current epoch, and what recovery does with it."""
    at = {k: F.min(F.when(F.col("kind") == k, F.col("seq"))) for k in ("PREPARE", "OUTPUT", "RECEIPT", "COMMIT", "POINTER")}
    g = records.groupBy("txn").agg(*[c.alias(k) for k, c in at.items()], F.min(F.when(F.col("kind") == "RECEIPT", F.col("epoch"))).alias("receipt_epoch"))
    current = F.coalesce(F.col("receipt_epoch") >= epoch, F.lit(False))
    whole = F.coalesce((F.col("PREPARE") < F.col("OUTPUT")) & (F.col("OUTPUT") < F.col("RECEIPT")) & (F.col("RECEIPT") < F.col("COMMIT")), F.lit(False)) & current
    action = F.when(F.col("COMMIT").isNull() & F.col("POINTER").isNotNull(), "reject pointer").when(F.col("COMMIT").isNull(), "discard").when(~whole, "quarantine").when(F.col("POINTER").isNull(), "repair pointer").otherwise("accept")
    return g.select("txn", current.alias("receipt_current"), whole.alias("in_protocol"), action.alias("action"))


def claims(attempts: DataFrame) -> DataFrame:
    """Every attempt on a consent: the first claim within an hour of issue holds it, only its transaction may come back, and use it up once.

    The first consumption by the holder after its claim ends the consent; whatever follows is refused.
    """
    w = Window.partitionBy("consent_id").orderBy("at", "attempt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timely = (F.col("action") == "claim") & (F.col("at") < F.col("issued_at") + F.expr("INTERVAL 1 HOUR"))
    first = attempts.withColumn("holder", F.first(F.when(timely, F.col("txn")), ignorenulls=True).over(w)).withColumn("nth", F.count(F.when(timely, 1)).over(w))
    mine = F.coalesce(F.col("txn") == F.col("holder"), F.lit(False))
    used = first.withColumn("uses", F.count(F.when((F.col("action") == "consume") & mine, 1)).over(w))
    ends = (F.col("action") == "consume") & mine & (F.col("uses") == 1)
    status = (
        F.when(F.col("holder").isNull(), F.when(F.col("action") == "claim", "expired").otherwise("refused")).when(ends, "consumed").when((F.col("uses") > 0) | (F.col("action") == "consume"), "refused")
        .when((F.col("nth") == 1) & timely, "claimed").when(mine, "recovers").otherwise("refused")
    )
    return used.select("consent_id", "attempt", status.alias("status"))


def overlaps(leases: DataFrame) -> DataFrame:
    """Leases that a writer took while another writer's of the same task was valid; its own it may renew.

    A sweep over starts and ends counts the leases that are open at each start, of the task and of the
    writer: if the task has more, another writer holds one. An end comes before a start of the same time.
    """
    start = leases.select("task_id", "writer", "lease_id", F.col("starts").alias("at"), F.lit(1).alias("step"))
    end = leases.filter("ends > starts").select("task_id", "writer", "lease_id", F.col("ends").alias("at"), F.lit(-1).alias("step"))
    steps = start.join(leases.filter("ends <= starts").select("lease_id"), "lease_id", "left_anti").unionByName(end).unionByName(leases.filter("ends <= starts").select("task_id", "writer", "lease_id", F.col("starts").alias("at"), F.lit(0).alias("step")))
    open_ = lambda *by: F.sum("step").over(Window.partitionBy(*by).orderBy("at", F.when(F.col("step") < 0, 0).otherwise(1), "lease_id").rowsBetween(Window.unboundedPreceding, -1))
    counted = steps.withColumns({"others": F.coalesce(open_("task_id"), F.lit(0)) - F.coalesce(open_("task_id", "writer"), F.lit(0))})
    return counted.filter("step >= 0 and others > 0").select("task_id", "lease_id", "writer")


def exports(versions: DataFrame) -> DataFrame:
    """What recovery does with an export, by what stands at the destination; and whether the approval still binds its subject."""
    action = F.when(F.col("found_digest").isNull(), "retry").when(F.col("found_digest") == F.col("digest"), "complete").otherwise("new consent")
    return versions.select("version_id", action.alias("action"), (F.col("digest") != F.col("approved_digest")).alias("approval_stale"))


#: The phase to which a task returns when a node of a kind is invalid.
ROUTES = {"evidence": "EXTRACT", "model_input": "EXTRACT", "claim": "CLAIM_REVIEW", "draft": "COMPILE", "compiler": "COMPILE", "policy": "COMPILE", "evaluation": "EVALUATE"}


def routed(nodes: DataFrame, edges: DataFrame, invalid: DataFrame, recorded: DataFrame) -> DataFrame:
    """Per task the nodes that an invalidation reaches, the earliest phase they lead back to, and whether the recorded route is accepted.

    nodes (node, task_id, kind), edges (src, dst) of derivations, invalid (node), recorded (task_id, phase,
    n_nodes). A route is refused if the descendants, computed again, are other ones or lead to another phase.
    """
    hit = nodes.join(descendants(edges, invalid), "node")
    order = F.create_map(*[F.lit(x) for kind, phase in ROUTES.items() for x in (kind, F.struct(F.lit(PHASES.index(phase)).alias("ordinal"), F.lit(phase).alias("phase")))])
    g = hit.groupBy("task_id").agg(F.min(F.element_at(order, F.col("kind"))).alias("r"), F.count("*").alias("n_invalid"))
    said = recorded.select("task_id", F.col("phase").alias("said"), "n_nodes")
    accepted = (F.col("said") == F.col("r.phase")) & (F.col("n_nodes") == F.col("n_invalid"))
    return g.join(said, "task_id", "left").select("task_id", F.col("r.phase").alias("phase"), "n_invalid", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def spent(log: DataFrame) -> DataFrame:
    """Per task and run epoch: active seconds, returns, revisions and failed attempts.

    The time up to a record counts only if the record before it left the task active; a suspension costs
    nothing, however long.
    """
    idle = F.lag("to_phase").over(task()).isin(*RESUMABLE, *TERMINAL)
    passed = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(task()).cast("timestamp"))
    rows = log.withColumn("step", F.when(idle, 0).otherwise(F.coalesce(passed, F.lit(0))))
    n = lambda c: F.count(F.when(c, 1))
    back = [e for _, e, to in TRANSITIONS if to == "+"]
    return rows.groupBy("task_id", "run_epoch").agg(F.sum("step").cast("long").alias("active_seconds"), n(F.col("event").isin(*back)).alias("n_resumed"), n(F.col("event") == "evidence_ok").alias("n_passes"), n(F.col("event").startswith("revise_")).alias("n_iterations"), F.count("*").alias("n_records"))


def exhausted(turns: DataFrame, limit: int = 4096) -> DataFrame:
    """Per session: bytes used, the turn at which they exceed the limit, and what is covered before it; nothing is cut off."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = turns.withColumn("used", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(w))
    g = used.groupBy("conv_id").agg(F.max("used").cast("long").alias("n_bytes"), F.min(F.when(F.col("used") > limit, F.col("turn"))).alias("exceeded_at"), F.count(F.when(F.col("used") <= limit, 1)).alias("n_covered"))
    return g.withColumn("state", F.when(F.col("exceeded_at").isNull(), "within").otherwise("SUSPENDED_EXHAUSTED"))


#: Days that evidence is kept by default and at most; records that are neither a user's command nor a transition that was committed for one.
KEPT_DAYS, MOST_DAYS = 30, 90
SYSTEM = ("exhaust", "authority_lost")


def activity(log: DataFrame) -> DataFrame:
    """Last time that counts as activity, a user's command or a committed transition but not a check, and the end of default retention."""
    g = log.filter(~F.col("event").isin(*SYSTEM)).groupBy("task_id").agg(F.max("ts").alias("last_active"))
    return g.withColumn("retained_until", F.expr(f"last_active + INTERVAL {KEPT_DAYS} DAY"))


def sweep(log: DataFrame, retention: DataFrame, now: DataFrame) -> DataFrame:
    """Deletion report: tasks whose evidence is past its retention, by day of last activity.

    retention (task_id, retention_days) is the user's choice; without one the default holds, and none
    goes beyond the maximum. now is a table of one row.
    """
    days = F.least(F.coalesce("retention_days", F.lit(KEPT_DAYS)), F.lit(MOST_DAYS)).cast("int")
    g = activity(log).join(retention, "task_id", "left").crossJoin(F.broadcast(now))  # now: one row
    g = g.filter(F.col("last_active") + F.make_dt_interval(days=days) <= F.col("now"))
    return g.select(F.to_date("last_active").alias("day")).groupBy("day").agg(F.count("*").alias("n_deleted"))


def ceilings(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Every source that breaks a hard ceiling, with the ceilings in order of name; such a source leaves no rows behind."""
    over = usage.join(F.broadcast(limits), "name").filter("used > ceiling")
    return over.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("broken"))


def staged(documents: DataFrame, usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Coverage by language: sources selected, snapshotted and excluded as a whole."""
    bad = ceilings(usage, limits).select(F.col("source_id").alias("doc_id"), F.lit(True).alias("bad"))
    rows = documents.select("doc_id", "lang").join(bad, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n_selected"), F.count(F.when(F.col("bad").isNull(), 1)).alias("n_snapshotted"), F.count("bad").alias("n_excluded"))


def budget_decisions(log: DataFrame) -> DataFrame:
    """Decisions on suspended epochs: only named limits may change, never thresholds or the scope of sources."""
    beyond = F.array_except(F.split("extends", ","), F.array(*map(F.lit, BUDGETS)))
    return log.filter("event = 'pause'").select("task_id", "seq", F.array_join(F.array_sort(beyond), ",").alias("beyond"), (F.size(beyond) == 0).alias("allowed"))


_NOW = "(SELECT max(ts) FROM events)"
_ANY = " OR ".join(f"(event = '{e}' AND to_phase = '{to}'" + (")" if e == "cancel" else " AND from_phase NOT IN ('" + "', '".join(RESUMABLE) + "'))") for e, to in ANYWHERE)
_OVER = "', '".join(TERMINAL)
_REST = "', '".join(RESUMABLE)
_FRAMES = """f AS MATERIALIZED (SELECT *, coalesce(lag(record) OVER w, repeat('0', 64)) AS before, max(epoch) OVER (w ROWS UNBOUNDED PRECEDING) AS fence FROM (SELECT task_id, place, body, flip, kept, coalesce(kept, CAST(length(body) / 2 AS BIGINT) + 8) AS n_bytes,
  CAST('0x' || substr(body, 3, 16) AS BIGINT) AS seq, CAST('0x' || substr(body, 19, 16) AS BIGINT) AS epoch, substr(body, 35, 64) AS prev, substr(body, 99, 64) AS digest, sha256(unhex(substr(body, 163))) AS of_payload, sha256(unhex(body)) AS record FROM log_frames) r WINDOW w AS (PARTITION BY task_id ORDER BY place))"""
QUERIES = {
    "transition_table": (lambda t: transition_table(t.spark), "SELECT * FROM (VALUES " + ", ".join(str(x) for x in [*TRANSITIONS, *(("*", e, to) for e, to in ANYWHERE)]) + ") v(from_phase, event, to_phase)"),
    "illegal_transitions": (
        lambda t: illegal(t("task_log")),
        f"SELECT task_id, seq, from_phase, event, to_phase FROM task_log l WHERE (from_phase, event, to_phase) NOT IN (SELECT (from_phase, event, to_phase) FROM transitions) AND NOT (from_phase NOT IN ('{_OVER}') AND ({_ANY})) AND NOT (from_phase || event IN ('SUSPENDEDresume', 'SUSPENDED_EXHAUSTEDbudget_extended') AND to_phase = (SELECT arg_max(b.to_phase, b.seq) FROM task_log b WHERE b.task_id = l.task_id AND b.seq < l.seq AND b.to_phase NOT IN ('{_REST}'))) AND NOT (from_phase || event = 'AUTH_STALEauthority_renewed' AND to_phase = earliest_phase)",
    ),
    "task_states": (
        lambda t: replay(t("task_log")),
        f"""SELECT a.task_id, a.to_phase AS phase, a.run_epoch, (SELECT max(b.fencing_epoch) FROM task_log b WHERE b.task_id = a.task_id) AS fencing_epoch, a.seq + 1 AS n_records, CASE WHEN a.to_phase IN ('{_OVER}') THEN 'terminal' WHEN a.to_phase IN ('{_REST}') THEN 'resumable' ELSE 'active' END AS kind
        FROM task_log a WHERE NOT EXISTS (SELECT 1 FROM task_log b WHERE b.task_id = a.task_id AND b.seq > a.seq)""",
    ),
    "log_breaks": (
        lambda t: breaks(t("task_log")),
        """WITH j AS (SELECT a.task_id, a.seq, coalesce(p.to_phase <> a.from_phase, false) AS jumped, EXISTS (SELECT 1 FROM task_log b WHERE b.task_id = a.task_id AND b.seq < a.seq AND b.fencing_epoch > a.fencing_epoch) AS fenced, coalesce(p.run_epoch > a.run_epoch, false) AS went_back, coalesce(a.event IN ('authority_renewed') AND a.run_epoch <= p.run_epoch, false) AS old_epoch
          FROM task_log a LEFT JOIN task_log p ON p.task_id = a.task_id AND p.seq = a.seq - 1) SELECT * FROM j WHERE jumped OR fenced OR went_back OR old_epoch""",
    ),
    "resumed_phases": (
        lambda t: resumed(t("task_log")),
        f"""SELECT a.task_id, a.seq, (SELECT arg_max(b.to_phase, b.seq) FROM task_log b WHERE b.task_id = a.task_id AND b.seq < a.seq AND b.to_phase NOT IN ('{_REST}')) AS prior,
          coalesce(CASE a.event WHEN 'authority_renewed' THEN a.earliest_phase ELSE (SELECT arg_max(b.to_phase, b.seq) FROM task_log b WHERE b.task_id = a.task_id AND b.seq < a.seq AND b.to_phase NOT IN ('{_REST}')) END = a.to_phase, false) AS restored FROM task_log a WHERE a.from_phase IN ('{_REST}') AND a.event IN ('resume', 'budget_extended', 'authority_renewed')""",
    ),
    "log_verification": (
        lambda t: verified(t("log_frames")),
        f"""WITH {_FRAMES}, b AS (SELECT task_id, min(place) AS bad, arg_min(flip OR kept IS NOT NULL, place) AS torn FROM f WHERE flip OR kept IS NOT NULL OR seq <> place OR fence > epoch OR prev <> before OR digest <> of_payload GROUP BY task_id)
        SELECT f.task_id, count(*) AS n_records, coalesce(any_value(b.bad), count(*)) AS n_verified, CAST(coalesce(sum(f.n_bytes) FILTER (WHERE b.bad IS NULL OR f.place < b.bad), 0) AS BIGINT) AS verified_bytes,
          CASE WHEN any_value(b.bad) IS NULL THEN 'sound' WHEN any_value(b.bad) = count(*) - 1 AND any_value(b.torn) THEN 'truncated' ELSE 'FAILED_PERMANENT' END AS status FROM f LEFT JOIN b ON f.task_id = b.task_id GROUP BY f.task_id""",
    ),
    "log_frames_read": (
        lambda t: frames(t("log_frames")),
        f"""WITH {_FRAMES} SELECT task_id, CAST(coalesce(sum(n_bytes) OVER (PARTITION BY task_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, n_bytes,
          CASE WHEN kept IS NULL THEN seq END AS seq, CASE WHEN kept IS NULL THEN epoch END AS fencing_epoch, CASE WHEN kept IS NULL THEN CASE WHEN flip THEN sha256(unhex(left(body, length(body) - 2) || lpad(hex(xor(CAST('0x' || right(body, 2) AS INT), 1)), 2, '0'))) ELSE record END END AS record_hash, NOT flip AND kept IS NULL AS sound FROM f""",
    ),
    "commit_verdicts": (
        lambda t: commits(t("protocol")),
        """WITH g AS (SELECT txn, string_agg(kind, ',' ORDER BY seq) AS s, coalesce(bool_or(kind = 'RECEIPT' AND epoch >= 2), false) AS receipt_current FROM protocol GROUP BY txn)
        SELECT txn, receipt_current, receipt_current AND s LIKE 'PREPARE,OUTPUT,RECEIPT,COMMIT%' AS in_protocol, CASE WHEN s NOT LIKE '%COMMIT%' THEN CASE WHEN s LIKE '%POINTER' THEN 'reject pointer' ELSE 'discard' END
          WHEN NOT (receipt_current AND s LIKE 'PREPARE,OUTPUT,RECEIPT,COMMIT%') THEN 'quarantine' WHEN s LIKE '%POINTER' THEN 'accept' ELSE 'repair pointer' END AS action FROM g""",
    ),
    "consent_claims": (
        lambda t: claims(t("consents")),
        """WITH f AS (SELECT consent_id, min(attempt) AS first_attempt, arg_min(txn, attempt) AS holder FROM consents c WHERE c.action = 'claim' AND c.at < c.issued_at + INTERVAL 1 HOUR GROUP BY consent_id),
        u AS (SELECT c.consent_id, min(c.attempt) AS used FROM consents c JOIN f ON c.consent_id = f.consent_id WHERE c.action = 'consume' AND c.txn = f.holder AND c.attempt > f.first_attempt GROUP BY c.consent_id)
        SELECT c.consent_id, c.attempt, CASE WHEN f.first_attempt IS NULL OR c.attempt < f.first_attempt THEN CASE c.action WHEN 'claim' THEN 'expired' ELSE 'refused' END WHEN c.attempt = u.used THEN 'consumed' WHEN c.attempt > u.used OR c.action = 'consume' THEN 'refused'
          WHEN c.attempt = f.first_attempt THEN 'claimed' WHEN c.txn = f.holder THEN 'recovers' ELSE 'refused' END AS status FROM consents c LEFT JOIN f ON c.consent_id = f.consent_id LEFT JOIN u ON u.consent_id = c.consent_id""",
    ),
    "lease_overlaps": (
        lambda t: overlaps(t("leases")),
        "SELECT a.task_id, a.lease_id, a.writer FROM leases a WHERE EXISTS (SELECT 1 FROM leases b WHERE b.task_id = a.task_id AND (b.starts < a.starts OR b.starts = a.starts AND b.lease_id < a.lease_id) AND b.ends > a.starts AND b.writer <> a.writer)",
    ),
    "export_recovery": (
        lambda t: exports(t("versions")),
        "SELECT version_id, CASE coalesce(found_digest, '') WHEN '' THEN 'retry' WHEN digest THEN 'complete' ELSE 'new consent' END AS action, digest <> approved_digest AS approval_stale FROM versions",
    ),
    "revision_routing": (
        lambda t: routed(t("derived_nodes"), t("derivations"), t("invalidated"), t("routes")),
        """WITH RECURSIVE hit AS (SELECT node FROM invalidated UNION SELECT e.dst FROM hit JOIN derivations e ON e.src = hit.node),
        n AS (SELECT d.task_id, d.kind FROM hit JOIN derived_nodes d ON d.node = hit.node), g AS (SELECT task_id, count(*) AS n_invalid, min(CASE kind WHEN 'evidence' THEN 6 WHEN 'model_input' THEN 6 WHEN 'claim' THEN 7 WHEN 'evaluation' THEN 9 ELSE 8 END) AS o FROM n GROUP BY task_id)
        SELECT g.task_id, p.phase, n_invalid, coalesce(r.phase = p.phase AND r.n_nodes = n_invalid, false) AS accepted FROM g JOIN phases p ON p.ordinal = g.o LEFT JOIN routes r ON r.task_id = g.task_id""",
    ),
    "time_spent": (
        lambda t: spent(t("task_log")),
        f"""SELECT a.task_id, a.run_epoch, CAST(sum(CASE WHEN b.to_phase IN ('{_OVER}', '{_REST}') THEN 0 ELSE coalesce(date_diff('second', b.ts, a.ts), 0) END) AS BIGINT) AS active_seconds, count(*) FILTER (WHERE a.event IN ('resume', 'budget_extended', 'authority_renewed')) AS n_resumed,
          count(*) FILTER (WHERE a.event = 'evidence_ok') AS n_passes, count(*) FILTER (WHERE a.event LIKE 'revise%') AS n_iterations, count(*) AS n_records FROM task_log a LEFT JOIN task_log b ON a.task_id = b.task_id AND b.seq = a.seq - 1 GROUP BY a.task_id, a.run_epoch""",
    ),
    "budget_exhaustion": (
        lambda t: exhausted(t("conversations"), 500),
        """WITH u AS (SELECT a.conv_id, a.turn, sum(coalesce(strlen(b.text), 0)) AS used FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY a.conv_id, a.turn)
        SELECT conv_id, CAST(max(used) AS BIGINT) AS n_bytes, min(turn) FILTER (WHERE used > 500) AS exceeded_at, count(*) FILTER (WHERE used <= 500) AS n_covered, CASE WHEN max(used) > 500 THEN 'SUSPENDED_EXHAUSTED' ELSE 'within' END AS state FROM u GROUP BY conv_id""",
    ),
    "last_activity": (
        lambda t: activity(t("task_log")),
        "SELECT task_id, max(ts) AS last_active, max(ts) + INTERVAL 30 DAY AS retained_until FROM task_log WHERE event NOT IN ('exhaust', 'authority_lost') GROUP BY task_id",
    ),
    "retention_deletions": (
        lambda t: sweep(t("task_log"), t("task_retention"), t("events").agg(F.max("ts").alias("now"))),
        f"""SELECT CAST(last AS DATE) AS day, count(*) AS n_deleted FROM (SELECT task_id, max(ts) AS last FROM task_log WHERE event NOT IN ('exhaust', 'authority_lost') GROUP BY task_id) a JOIN task_retention r ON a.task_id = r.task_id
        WHERE date_diff('microsecond', last, {_NOW}) >= 86400000000 * CASE WHEN retention_days IS NULL THEN 30 WHEN retention_days > 90 THEN 90 ELSE retention_days END GROUP BY 1""",
    ),
    "ceiling_violations": (
        lambda t: ceilings(t("usage"), t("limits")),
        "SELECT source_id, string_agg(u.name, ',' ORDER BY u.name) AS broken FROM usage u JOIN limits l ON u.name = l.name WHERE u.used > l.ceiling GROUP BY source_id",
    ),
    "ingest_coverage": (
        lambda t: staged(t("documents"), t("usage"), t("limits")),
        "WITH b AS (SELECT DISTINCT source_id FROM usage u JOIN limits l ON u.name = l.name WHERE u.used > l.ceiling) SELECT lang, count(*) AS n_selected, count(*) - count(b.source_id) AS n_snapshotted, count(b.source_id) AS n_excluded FROM documents d LEFT JOIN b ON d.doc_id = b.source_id GROUP BY lang",
    ),
    "budget_decisions": (
        lambda t: budget_decisions(t("task_log")),
        "SELECT task_id, seq, CASE WHEN extends LIKE '%threshold%' THEN 'threshold' WHEN extends LIKE '%scope%' THEN 'scope' ELSE '' END AS beyond, extends NOT LIKE '%threshold%' AND extends NOT LIKE '%scope%' AS allowed FROM task_log WHERE event = 'pause'",
    ),
}
