"""Grants, attestations and what they let pass; whatever is unknown is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import stabbed
from ..plans.sweeps import ranged

MANIFEST_ROWS, PAGE_ROWS, PAGES = 100, 20, 5
POLICY, TRUSTED = 2, "resolver"
#: Texts that read like an instruction or an approval; they are flagged and never obeyed.
INERT = r"(?i)\b(ignore (all )?previous instructions|i (hereby )?consent|approve the (export|version)|run the command)\b"


def expiry(grants: DataFrame) -> DataFrame:
    """grants and expires_at: a day after issue, or when the task is done, or sooner if the user says so."""
    return grants.withColumn("expires_at", F.least(F.expr("issued_at + INTERVAL 24 HOUR"), "shorter_until", "task_done_at"))


#: The type of grant that an operation needs.
TYPES = {"read": "content", "list": "metadata", "search": "discovery"}


def decisions(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """request_id, n_grants, read_ok and reuse_ok of every request.

    A grant covers a request with the same principal, tenant, operation, purpose, selector and revision, if
    its type is the one that the operation needs and the resource's time lies in [range_from, range_to);
    an open end bounds nothing. New reads need it unexpired and unrevoked; reuse of redacted data only its
    bound for derived processing. A sweep over the times of grants and requests counts them, so no pairs are listed.
    """
    g = expiry(grants).withColumn("until", F.least(F.coalesce("revoked_at", F.greatest("expires_at", "derived_processing_until")), F.greatest("expires_at", "derived_processing_until")))
    need = F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), F.col("operation"))
    keys = ["principal", "tenant", "operation", "selector", "revision", "purpose"]
    g = g.filter(F.col("grant_type") == need).select(*keys, "issued_at", "until", "expires_at", "derived_processing_until", "range_from", "range_to")
    # who may read or reuse: the counts of grants in force that are not expired, and that bound processing later
    g = g.withColumns({"r_to": F.least("until", "expires_at"), "u_to": F.when(F.col("derived_processing_until").isNotNull(), F.least("until", "derived_processing_until"))})
    shapes = g.select(*keys, F.col("issued_at").alias("from_"), F.col("until").alias("n_to"), "r_to", "u_to", F.col("range_from").alias("low"), F.col("range_to").alias("high"), F.lit(1).alias("w"))
    found = ranged(requests, shapes, keys, "request_id", "at", "resource_at")
    return found.select("request_id", F.col("n").alias("n_grants"), (F.col("r") > 0).alias("read_ok"), (F.col("u") > 0).alias("reuse_ok"))


#: What a request may not widen beyond the grants of its principal and operation.
BOUND = ("tenant", "selector", "revision", "purpose", "method", "endpoint", "response_type")


def widening(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Per request what no grant of its principal and operation allows; a grant allows at most max_bytes.

    Each property is joined with the distinct values that a principal's grants have of it, so rows stay as
    many as requests.
    """
    who = ["principal", "operation"]
    out = requests.select("request_id", *who, *BOUND, "bytes")
    for c in BOUND:
        known = grants.filter(F.col(c).isNotNull()).select(*who, c).distinct().withColumn(f"has_{c}", F.lit(True))
        out = out.join(known, [*who, c], "left")
    most = grants.groupBy(*who).agg(F.max("max_bytes").alias("most"))
    wide = F.coalesce(F.col("bytes") > F.col("most"), F.lit(True))
    return out.join(most, who, "left").select("request_id", *[F.col(f"has_{c}").isNull().alias(f"wrong_{c}") for c in BOUND], wide.alias("wrong_bytes"))


def attested(operations: DataFrame, attestations: DataFrame) -> DataFrame:
    """operation_id, attestation_id, allowed: the latest valid attestation at the time of the operation, at most a day old.

    Of several of one instant the one with the greatest id counts. A valid one that forbids wins over all
    others until it expires, however old it is. One pass over both, sorted by time.
    """
    good = (F.col("issuer") == TRUSTED) & (F.col("policy_version") == POLICY) & ~F.col("revoked") & ~F.col("superseded") & F.col("in_scope")
    a = attestations.filter(good).select("selector", F.col("verified_at").alias("at"), F.struct("attestation_id", "verified_at", "expires_at").alias("a"), F.when(F.col("forbids"), F.col("expires_at")).alias("no"), F.lit(None).cast("long").alias("operation_id"))
    o = operations.select("selector", "at", F.lit(None).cast(a.schema["a"].dataType).alias("a"), F.lit(None).cast("timestamp_ntz").alias("no"), "operation_id")
    before = Window.partitionBy("selector").orderBy("at", F.col("operation_id").asc_nulls_first(), "a.attestation_id").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(o).withColumn("last", F.last("a", ignorenulls=True).over(before)).withColumn("forbidden", F.max("no").over(before))
    fresh = (F.col("last.verified_at") >= F.expr("at - INTERVAL 24 HOUR")) & (F.col("at") < F.col("last.expires_at"))
    out = both.filter("operation_id is not null")
    return out.select("operation_id", F.when(fresh, F.col("last.attestation_id")).alias("attestation_id"), (F.coalesce(fresh, F.lit(False)) & ~F.coalesce(F.col("at") < F.col("forbidden"), F.lit(False))).alias("allowed"))


def due(attestations: DataFrame, now: DataFrame) -> DataFrame:
    """Selectors whose latest verification is a day old or older; now is a table of one row."""
    last = attestations.groupBy("selector").agg(F.max("verified_at").alias("verified_at"))
    return last.crossJoin(F.broadcast(now)).filter(F.col("verified_at") <= F.col("now") - F.expr("INTERVAL 24 HOUR")).drop("now")


def rules_at(operations: DataFrame, rules: DataFrame) -> DataFrame:
    """operation_id, n_rules and rule_id: the highest ranked rule in force for the subject, the smallest id of equal ones."""
    best = F.struct("rank", (-F.col("rule_id")).alias("minus"))
    found = stabbed(operations, rules, ["subject"], "operation_id", "at", "effective_from", "effective_to", best)
    return operations.select("operation_id").join(found, "operation_id", "left").select("operation_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_rules"), (-F.col("best.minus")).alias("rule_id"))


def seeds(seed: DataFrame) -> DataFrame:
    """What a seed authorises: pasted text its content, a bare locator its metadata, a named resource its pinned content."""
    return seed.select("doc_id", "seed", F.when(F.col("seed") == "locator", "metadata").otherwise("content").alias("grant_type"), F.when(F.col("seed") == "named", F.col("doc_id")).alias("selector"))


def manifest(documents: DataFrame, group: str = "lang") -> DataFrame:
    """Candidates as metadata only: their rank and page within a group, why they are there, and what is over the limit.

    Nothing is cut silently: rows over the limit stay as rows with the status overflow.
    """
    w = Window.partitionBy(group).orderBy(F.col("n_chars").desc(), "doc_id")
    ranked = documents.select("doc_id", group, "source", "n_chars").withColumn("place", F.row_number().over(w))
    page = F.floor((F.col("place") - 1) / PAGE_ROWS).cast("long")
    kept = (F.col("place") <= MANIFEST_ROWS) & (page < PAGES)
    return ranked.select("doc_id", group, "source", F.col("place").cast("long").alias("place"), page.alias("page"), F.when(kept, "candidate").otherwise("overflow").alias("status"), F.concat(F.lit("long text in "), group).alias("relevance_reason"))


def inert(said: DataFrame) -> DataFrame:
    """Turns that contain instructions or approvals; they authorise nothing."""
    return said.select("conv_id", "turn", F.col("text").rlike(INERT).alias("flagged"), F.lit(False).alias("authorises"))


def lines_allowed(lines: DataFrame, denied: DataFrame) -> DataFrame:
    """Lines whose source the deny registry does not hold."""
    return lines.withColumn("node", F.col("l_suppkey") * 10).join(denied, "node", "left_anti").select("l_orderkey", "l_linenumber")


_VALID = "issuer = 'resolver' AND policy_version = 2 AND NOT revoked AND NOT superseded AND in_scope"
QUERIES = {
    "grant_expiry": (
        lambda t: expiry(t("grants")).select("grant_id", "expires_at"),
        "SELECT grant_id, CASE WHEN coalesce(shorter_until, issued_at + INTERVAL 1 DAY) < coalesce(task_done_at, issued_at + INTERVAL 1 DAY) THEN shorter_until WHEN task_done_at IS NOT NULL THEN task_done_at ELSE issued_at + INTERVAL 1 DAY END AS expires_at FROM grants",
    ),
    "grant_decisions": (
        lambda t: decisions(t("requests"), t("grants")),
        """WITH live AS (SELECT r.request_id, r.at, g.* FROM requests r JOIN grants g ON g.principal = r.principal AND g.tenant = r.tenant AND g.operation = r.operation AND g.selector = r.selector AND g.revision = r.revision AND g.purpose = r.purpose WHERE r.at >= g.issued_at AND NOT coalesce(r.at >= g.revoked_at, false)
          AND g.operation || g.grant_type IN ('readcontent', 'listmetadata', 'searchdiscovery') AND NOT coalesce(r.resource_at < g.range_from, false) AND NOT coalesce(r.resource_at >= g.range_to, false)
          AND (r.at < g.derived_processing_until OR r.at < g.issued_at + INTERVAL 24 HOUR AND NOT coalesce(r.at >= g.shorter_until, false) AND NOT coalesce(r.at >= g.task_done_at, false)))
        SELECT request_id, (SELECT count(*) FROM live l WHERE l.request_id = r.request_id) AS n_grants,
          EXISTS (SELECT 1 FROM live l WHERE l.request_id = r.request_id AND l.at < l.issued_at + INTERVAL 24 HOUR AND NOT coalesce(l.at >= l.shorter_until, false) AND NOT coalesce(l.at >= l.task_done_at, false)) AS read_ok,
          EXISTS (SELECT 1 FROM live l WHERE l.request_id = r.request_id AND l.at < l.derived_processing_until) AS reuse_ok FROM requests r""",
    ),
    "request_widening": (
        lambda t: widening(t("requests"), t("grants")),
        "SELECT request_id, "
        + ", ".join(f"{c} NOT IN (SELECT {c} FROM grants g WHERE g.principal = r.principal AND g.operation = r.operation) AS wrong_{c}" for c in ("tenant", "selector", "revision", "purpose", "method", "endpoint", "response_type"))
        + ", coalesce(bytes > (SELECT max(max_bytes) FROM grants g WHERE g.principal = r.principal AND g.operation = r.operation), true) AS wrong_bytes FROM requests r",
    ),
    "attested_operations": (
        lambda t: attested(t("operations"), t("attestations")),
        f"""WITH good AS (SELECT * FROM attestations WHERE {_VALID}), last AS (SELECT o.*, g.attestation_id, g.verified_at, g.expires_at FROM operations o ASOF LEFT JOIN good g ON o.selector = g.selector AND o.at >= g.verified_at)
        SELECT operation_id, CASE WHEN verified_at >= last.at - INTERVAL 24 HOUR AND last.at < expires_at THEN attestation_id END AS attestation_id,
          coalesce(verified_at >= last.at - INTERVAL 24 HOUR AND last.at < expires_at, false) AND NOT EXISTS (SELECT 1 FROM good f WHERE f.forbids AND f.selector = last.selector AND f.verified_at <= last.at AND f.expires_at > last.at) AS allowed FROM last""",
    ),
    "attestations_due": (
        lambda t: due(t("attestations").filter("issuer = 'resolver' AND NOT revoked"), t("events").agg(F.max("ts").alias("now"))),
        "SELECT selector, max(verified_at) AS verified_at FROM attestations WHERE issuer = 'resolver' AND NOT revoked GROUP BY selector HAVING max(verified_at) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events)",
    ),
    "rules_in_force": (
        lambda t: rules_at(t("operations"), t("rules")),
        """SELECT o.operation_id, count(r.rule_id) AS n_rules, arg_max(r.rule_id, r.rank * 1000000 - r.rule_id) AS rule_id FROM operations o LEFT JOIN rules r
        ON r.subject = o.subject AND o.at BETWEEN r.effective_from AND coalesce(r.effective_to - INTERVAL 1 MICROSECOND, TIMESTAMP '9999-01-01 00:00:00') GROUP BY o.operation_id""",
    ),
    "seed_grants": (
        lambda t: seeds(t("seeds")),
        "SELECT doc_id, seed, CASE WHEN seed IN ('paste', 'named') THEN 'content' ELSE 'metadata' END AS grant_type, CASE seed WHEN 'named' THEN doc_id END AS selector FROM seeds",
    ),
    "candidate_manifest": (
        lambda t: manifest(t("documents")),
        """SELECT a.doc_id, a.lang, a.source, count(b.doc_id) + 1 AS place, CAST(floor(count(b.doc_id) / 20) AS BIGINT) AS page, CASE WHEN count(b.doc_id) < 100 THEN 'candidate' ELSE 'overflow' END AS status, 'long text in ' || a.lang AS relevance_reason
        FROM documents a LEFT JOIN documents b ON a.lang IS NOT DISTINCT FROM b.lang AND (b.n_chars > a.n_chars OR b.n_chars = a.n_chars AND b.doc_id < a.doc_id) GROUP BY a.doc_id, a.lang, a.source""",
    ),
    "inert_approvals": (
        lambda t: inert(t("said")),
        "SELECT conv_id, turn, regexp_matches(lower(text), 'ignore (all )?previous instructions|i (hereby )?consent|approve the (export|version)|run the command') AS flagged, false AS authorises FROM said",
    ),
    "denied_lines": (
        lambda t: lines_allowed(t("lineitem"), t("denied")),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey * 10 NOT IN (SELECT node FROM denied)",
    ),
}
