"""Evidence: pairing, digests, redaction, partitions and prefixes of the driver's own tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.streams import digests
from ..plans.relations import Reader

_VALUE = r"""[A-Za-z0-9_-]{0,40}["\x27]?[ \t]*(?:=>|:=|=|:)[ \t]*(?:"[^"\r\n]*"|\x27[^\x27\r\n]*\x27|["\x27]?[^ \t\r\n"\x27,;]+)"""
#: Detectors in the order in which they redact (FN-09): what they find, mark, pattern. Java and RE2 read the patterns alike.
DETECTORS = (
    ("private_keys", "[private key]", r"(?s)-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY[A-Z ]{0,20}-----.*?(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY[A-Z ]{0,20}-----|\z)"),
    ("cookies", "[cookie]", r"(?i)(?:set-)?cookie[ \t]*[:=][ \t]*[A-Za-z0-9_.-]+=[^\r\n]*|(?i)(?:jsessionid|phpsessid|session_?id)[ \t]*[:=][ \t]*[^ \t\r\n;,&]+"),
    ("tokens", "[token]", r"(?i:authorization[ \t]*:[ \t]*[a-z]+[ \t]+[^ \t\r\n]+|bearer[ \t]+[A-Za-z0-9._~+/=-]{8,})|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-(?:[A-Za-z]{2,8}-)?[A-Za-z0-9_]{20,}|AIza[A-Za-z0-9_-]{35}|(?i:token)" + _VALUE),
    ("credentials", "[credential]", r"(?i:password|passwd|passphrase|pwd|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?)" + _VALUE + r"|://[^/ \t\r\n:@]*:[^/ \t\r\n@]+@"),
    ("emails", "[email]", r"[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*"),
    ("ibans", "[iban]", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
    ("addresses", "[address]", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    ("cards", "[card]", r"[0-9]{13,}|[0-9]{4,}(?:[ -][0-9]{4}){2}[ -][0-9]{4,}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"),
    ("phones", "[phone]", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"),
    ("ids", "[id]", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
)


#: What a text must hold for a detector to find anything; one that most texts lack spares the pattern.
GUARDS = {
    "private_keys": r"-----BEGIN", "cookies": r"(?i)cookie|sess", "tokens": r"(?i)token|bearer|authorization|eyJ|A[KS]IA|gh[pousr]_|github_pat_|xox|sk-|AIza", "credentials": r"(?i)pass|pwd|secret|key|credential|://",
    "emails": "@", "ibans": r"[A-Z]{2}[0-9]{2}", "addresses": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "cards": r"[0-9]{4}", "phones": r"[0-9]", "ids": r"[0-9]{3}-[0-9]{2}-",
}


#: Guards that are plain texts.
PLAIN = ("private_keys", "emails")


def redaction(rows: DataFrame, total: str, counts: bool = False) -> DataFrame:
    """rows with text redacted and the number of findings, of all detectors and if wanted of each.

    Each detector reads what those before it have left. A text that lacks a detector's guard passes it
    untouched; findings are counted only where something was replaced.
    """
    names = []
    for name, mark, pattern in DETECTORS:
        guard = F.col("text").contains(GUARDS[name]) if name in PLAIN else F.col("text").rlike(GUARDS[name])
        rows = rows.withColumn("kept_", F.when(guard, F.regexp_replace("text", pattern, mark)).otherwise(F.col("text")))
        rows = rows.withColumn(f"n_{name}_", F.when(F.col("kept_") != F.col("text"), F.regexp_count("text", F.lit(pattern))).otherwise(F.when(F.col("text").isNotNull(), 0)).cast("long"))
        rows = rows.withColumn("text", F.col("kept_")).drop("kept_")
        names.append(f"n_{name}_")
    rows = rows.withColumn(total, sum((F.coalesce(n, F.lit(0)) for n in names), F.lit(0)).cast("long"))
    return rows.withColumnsRenamed({n: n[:-1] for n in names}) if counts else rows.drop(*names)


def _redaction(wanted: str) -> str:
    """The chain for DuckDB; each detector reads what those before it have left."""
    counts = wanted.startswith("doc_id, {counts}")
    duck, kept = "SELECT doc_id, text FROM documents", "doc_id"
    for name, mark, pattern in DETECTORS:
        here = f", len(regexp_extract_all(text, '{pattern}')) AS n_{name}" if counts else ""
        duck = f"SELECT {kept}{here}, regexp_replace(text, '{pattern}', '{mark}', 'g') AS text FROM ({duck}) t"
        kept += f", n_{name}" if counts else ""
    return f"SELECT {wanted.format(digest='sha256(text)', counts=', '.join(f'n_{name}' for name, _, _ in DETECTORS))} FROM ({duck}) t"


def findings(documents: DataFrame) -> DataFrame:
    """What each detector finds in every document, and the version of the detectors."""
    found = redaction(documents.select("doc_id", "text"), "total", counts=True)
    return found.select("doc_id", *[f"n_{name}" for name, _, _ in DETECTORS], F.lit("fn09-1").alias("detectors"))


def redacted(documents: DataFrame) -> DataFrame:
    """The digest of every document's redacted text."""
    return redaction(documents.select("doc_id", "text"), "total").select("doc_id", F.sha2("text", 256).alias("digest"))


def log_hash_chain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, own and link of every record: a link covers the link before it, so a change shows in every later one.

    One pass over each conversation's records in order.
    """
    logs = turns.selectExpr("conv_id", "turn", "sha2(coalesce(text, ''), 256) AS own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, link = None, ""
        for batch in batches:
            links = []
            for conv, own in zip(batch.column("conv_id").to_pylist(), batch.column("own").to_pylist()):
                link = hashlib.sha256(((link if at == (conv,) else "") + own).encode()).hexdigest()
                at = (conv,)
                links.append(link)
            yield batch.append_column("link", pa.array(links, pa.string()))

    types = dict(logs.dtypes)
    return logs.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "own").mapInArrow(run, f"conv_id {types['conv_id']}, turn {types['turn']}, own string, link string")


def pairs(turns: DataFrame) -> DataFrame:
    """User turns that the next turn answers."""
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("reply_turn"), F.col("role").alias("reply_role"))
    return turns.filter("role = 'user'").join(after.filter("reply_role = 'assistant'"), ["conv_id", "turn"]).select("conv_id", "turn", "reply_turn")


def ranked(parts: DataFrame, k: int = 10) -> DataFrame:
    """The k brands with the highest total, then the most parts, then by name; totals are aggregated before they are sorted."""
    g = parts.groupBy("p_brand").agg(F.count("*").alias("n_parts"), F.sum("p_size").cast("long").alias("total_size"))
    return g.orderBy(F.desc("total_size"), F.desc("n_parts"), "p_brand").limit(k)


def split(cases: DataFrame, salt: str = "split-1") -> DataFrame:
    """Every case's partition by a stable keyed hash of its root id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("conv_id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    return cases.select("conv_id").distinct().select("conv_id", F.when(h < 60, "extraction").when(h < 80, "validation").otherwise("sealed").alias("part"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Events and prefix digest of every conversation."""
    line = F.concat_ws(":", F.col("turn").cast("string"), "role", F.coalesce("text", F.lit("")))
    return digests(turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), line.alias("line")), "conv_id", ["turn", "role", "text"], "\n").withColumnRenamed("n", "n_events")


def set_digests(documents: DataFrame) -> DataFrame:
    """A digest over each source's ids, once each, in bytewise order."""
    ids = documents.select("source", F.col("doc_id").cast("string").alias("line")).distinct()
    return digests(ids, "source", ["line"], ",").drop("n")


def copies(documents: DataFrame) -> DataFrame:
    """Texts that several documents hold; a null is no text."""
    return documents.filter("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


_FINDINGS, _REDACTED = _redaction("doc_id, {counts}, 'fn09-1' AS detectors"), _redaction("doc_id, {digest} AS digest")
QUERIES = {
    "turn_reply_pairing": (
        lambda t: pairs(t("conversations")),
        "SELECT conv_id, turn, reply_turn FROM (SELECT conv_id, turn, role, lead(turn) OVER w AS reply_turn, lead(role) OVER w AS reply_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t WHERE role = 'user' AND reply_role = 'assistant'",
    ),
    "capability_ranking": (
        lambda t: ranked(t("part")),
        "SELECT p_brand, n_parts, total_size FROM (SELECT *, row_number() OVER (ORDER BY total_size DESC, n_parts DESC, p_brand) AS place FROM (SELECT p_brand, count(*) AS n_parts, CAST(sum(p_size) AS BIGINT) AS total_size FROM part GROUP BY p_brand) g) r WHERE place <= 10",
    ),
    "ungranted_documents": (
        lambda t: t("documents").join(t("labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source"),
        "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "content_digest_dupes": (lambda t: copies(t("documents")), "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    "redaction_findings": (lambda t: findings(t("documents")), _FINDINGS),
    "redacted_documents": (lambda t: redacted(t("documents")), _REDACTED),
    "root_partition_split": (
        lambda t: split(t("conversations")),
        "SELECT conv_id, CASE WHEN h < 60 THEN 'extraction' WHEN h < 80 THEN 'validation' ELSE 'sealed' END AS part FROM (SELECT DISTINCT conv_id, CAST('0x' || substr(sha256('split-1:' || conv_id), 1, 8) AS BIGINT) % 100 AS h FROM conversations) t",
    ),
    "event_prefix_digest": (
        lambda t: prefixes(t("conversations")),
        "SELECT conv_id, count(*) AS n_events, sha256(string_agg(turn || ':' || role || ':' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    ),
    "log_hash_chain": (
        lambda t: log_hash_chain(t("conversations")),
        "WITH RECURSIVE records AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS own, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sha256(coalesce(text, ''))) AS place FROM conversations), chain AS (SELECT conv_id, turn, own, place, sha256(own) AS link FROM records WHERE place = 1 UNION ALL SELECT r.conv_id, r.turn, r.own, r.place, sha256(c.link || r.own) FROM chain c JOIN records r ON r.conv_id = c.conv_id AND r.place = c.place + 1) SELECT conv_id, turn, own, link FROM chain",
    ),
    "set_digest_by_source": (
        lambda t: set_digests(t("documents")),
        "SELECT source, sha256(string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM documents GROUP BY source",
    ),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation: its evaluation partition and prefix digest, and whether prohibited losses quarantine it."""
    from .sessions import quarantine

    t = Reader(spark, sf_dir)
    quarantined = quarantine(t("nodes"), t("edges")).withColumnRenamed("root_id", "conv_id")
    return prefixes(t("conversations")).join(split(t("conversations")), "conv_id").join(quarantined, "conv_id")
