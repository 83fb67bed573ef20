"""Files of a compiled draft, digests over them, and the checks before anything leaves the workspace."""

from __future__ import annotations

import json
import math
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checksums import crc32c, crc32c_array  # noqa: F401
from ..functions.streams import digests

#: Kinds of files that may leave, by extension: MIME type, first bytes (empty: text; _: any digit), directory.
KINDS = (
    ("md", "text/markdown", "", "references"), ("json", "application/json", "", "references"), ("yaml", "application/yaml", "", "references"), ("yml", "application/yaml", "", "references"), ("txt", "text/plain", "", "references"),
    ("png", "image/png", "89504E470D0A1A0A", "assets"), ("jpg", "image/jpeg", "FFD8FF", "assets"), ("jpeg", "image/jpeg", "FFD8FF", "assets"), ("webp", "image/webp", "52494646________57454250", "assets"),
)
EXPORTED = r"^(SKILL\.md|references/.+|assets/.+)$"
EXECUTABLE = 0o111
#: Markup that acts.
ACTIVE = {"script": r"(?i)<script", "frame": r"(?i)<(iframe|object|embed)", "svg": r"(?i)<svg", "handler": r"(?i)\son[a-z]+\s*=", "form": r"(?i)<form"}


def normalised(path: Column) -> Column:
    """A relative path without empty and "." parts; null if it is absolute or climbs."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(~path.startswith("/") & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def digest(tag: str, payload: Column) -> Column:
    """SHA-256 of a tag, a zero byte and a payload, in hex."""
    return F.sha2(F.concat(F.encode(F.lit(tag), "UTF-8"), F.unhex(F.lit("00")), F.encode(payload, "UTF-8")), 256)


def identity(*columns: Column) -> Column:
    """A key over typed inputs; a null differs from an empty string."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v:"), c.cast("string")), F.lit("n")) for c in columns]), 256)


def violations(files: DataFrame) -> DataFrame:
    """Every file with what the closed policy finds wrong with it, in order of name.

    Names collide that are alike after case folding, not only in lower case. SKILL.md is the one file that
    stands outside the kinds' directories.
    """
    path = normalised(F.col("rel_path"))
    ext = F.regexp_extract(F.lower("rel_path"), r"\.([a-z]+)$", 1)
    known = files.sparkSession.createDataFrame(KINDS, "ext string, want_mime string, want_magic string, want_folder string")
    w = Window.partitionBy("generation", "folded")
    rows = files.withColumn("path", path).withColumn("ext", ext).join(F.broadcast(known), "ext", "left").withColumn("folded", casefold(F.col("path"))).withColumn("alike", F.count("path").over(w))
    folder = F.when(F.col("path") == "SKILL.md", F.col("want_folder")).otherwise(F.substring_index("path", "/", 1))
    wrong = {
        "case_collision": F.col("path").isNotNull() & (F.col("alike") > 1), "executable": F.col("mode_bits").bitwiseAND(EXECUTABLE) != 0, "extension": F.col("want_mime").isNull(), "folder": F.col("want_folder") != folder, "link_count": F.col("link_count") != 1,
        "magic": (F.col("want_magic") != "") & ~F.like("magic", F.concat("want_magic", F.lit("%"))), "mime": F.col("want_mime") != F.col("mime"), "nested": F.size(F.split("path", "/")) > 2, "path": F.col("path").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in wrong.items()]))
    return rows.select("artifact_id", F.array_join(found, ",").alias("violations"))


def exportable(files: DataFrame) -> DataFrame:
    """Files on the allowlist that violate nothing, with an opaque name for what they came from."""
    clean = violations(files).filter("violations = ''").select("artifact_id")
    return files.join(clean, "artifact_id").filter(F.col("rel_path").rlike(EXPORTED)).select("artifact_id", "rel_path", "digest", F.sha2(F.concat(F.lit("salt-1:"), F.col("artifact_id").cast("string")), 256).alias("evidence_ref"))


def active(files: DataFrame) -> DataFrame:
    """What in each document would act if it were opened."""
    return files.select("artifact_id", *[F.coalesce(F.col("html").rlike(p), F.lit(False)).alias(f"has_{k}") for k, p in ACTIVE.items()])


def generations(files: DataFrame) -> DataFrame:
    """Every generation's manifest: files, and a digest over their names and digests in bytewise order, in one pass over sorted rows."""
    line = F.concat_ws(" ", F.col("digest"), F.col("rel_path"), F.col("artifact_id").cast("string"))
    return digests(files.select("generation", line.alias("line")), "generation", ["line"], "\n").select("generation", F.col("n").alias("n_files"), F.col("digest").alias("manifest_digest"))


def semantic(version: Column) -> Column:
    p = F.split(version, r"\.")
    return F.struct(*[F.element_at(p, k).cast("int").alias(n) for k, n in enumerate(("major", "minor", "patch"), 1)])


def newest(versions: DataFrame) -> DataFrame:
    """Per capability the highest semantic version, numbers compared as numbers."""
    return versions.groupBy("capability_id").agg(F.max_by("version_id", F.struct(semantic(F.col("version")).alias("s"), F.col("version_id"))).alias("version_id"), F.max_by("version", F.struct(semantic(F.col("version")).alias("s"), F.col("version_id"))).alias("version"))


def subjects(versions: DataFrame) -> DataFrame:
    """Every version's approval subject: a domain-separated digest of its canonical payload, with the digest of the set of its siblings in bytewise order."""
    ids = digests(versions.select("capability_id", F.col("version_id").cast("string").alias("line")).distinct(), "capability_id", ["line"], ",").select("capability_id", F.col("digest").alias("ids"))
    payload = F.concat(F.lit('{"capability":'), F.col("capability_id").cast("string"), F.lit(',"digest":"'), F.col("digest"), F.lit('","versions":"'), F.col("ids"), F.lit('"}'))
    return versions.join(ids, "capability_id").select("version_id", digest("approval-subject/v1", payload).alias("subject"))


def ingest_keys(documents: DataFrame) -> DataFrame:
    """Documents by idempotency key over source, grant, version and content; those that repeat are one evidence."""
    key = identity(F.col("source"), F.lit(None).cast("string"), F.lit(1), F.sha2(F.coalesce("text", F.lit("")), 256))
    return documents.select("doc_id", key.alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"))


def endpoints(pages: DataFrame) -> DataFrame:
    """Every page's endpoint host, and whether the broker lets it pass: pinned hosts only."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1))
    return pages.select("page_id", host.alias("host"), (host.endswith(".example.org") & F.startswith("url", F.lit("https://"))).alias("allowed"))


def expansion(files: DataFrame) -> DataFrame:
    """How much larger a document is than its text, and whether that breaks the ratio of ten."""
    text = F.octet_length(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", ""))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    return files.select("artifact_id", size.cast("long").alias("n_bytes"), text.cast("long").alias("n_text"), F.coalesce(size > text * 10, F.lit(False)).alias("expands"))


def settings(events: DataFrame) -> DataFrame:
    """Configurations read from JSON, and a digest over their entries in order of name."""
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), k.cast("string"), F.lit("user"), F.col("user_id").cast("string"))
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value, F.lit("null"))))
    return events.select("event_id", k.alias("k"), F.sha2(F.array_join(entries, ";"), 256).alias("digest"))


def audit(requests: DataFrame) -> DataFrame:
    """The audit log: who did what how often, counts and hashes and never content."""
    return requests.groupBy("principal", "operation").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("n_bytes"), F.min("request_id").alias("first_id"))


# --- functions without a built-in ---------------------------------------------------------------


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a member is repeated")
    return out


def parsed(text: str):
    """JSON text as RFC 8785 reads it: every number is a double, and no member comes twice."""
    return json.loads(text, parse_int=float, object_pairs_hook=_unique)


def canonical(value) -> str:
    """JSON as RFC 8785 has it: members by UTF-16 code units, shortest numbers, no spaces."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(str(k))}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda kv: str(kv[0]).encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        value = float(value)
        if not math.isfinite(value):
            raise ValueError("JSON has no such number")
        return number(value)
    return json.dumps(value, ensure_ascii=False)


def number(x: float) -> str:
    """The shortest decimal of a double as ECMAScript prints it."""
    if x == 0:
        return "0"
    digits, exponent = repr(abs(x)).lower().partition("e")[::2]
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    sign, n = "-" if x < 0 else "", len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def casefolded(text: str | None) -> str | None:
    """What two names collide on: normalised, casefolded, normalised again."""
    return None if text is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def _series(function, kind: str):
    """function over a column, in Arrow batches."""

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x is pd.NA else function(x) for x in column], dtype="Int64" if kind == "long" else object)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def crc32c_of(data: Column) -> Column:
    """CRC32C of a binary column, a batch at a time."""

    def run(column: pd.Series) -> pd.Series:
        return crc32c_array(pa.array(column, pa.binary(), from_pandas=True)).to_pandas(integer_object_nulls=True)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(data)


def casefold(text: Column) -> Column:
    return _series(casefolded, "string")(text)


def canonical_json(text: Column) -> Column:
    """JSON text in its canonical form."""
    return _series(lambda t: canonical(parsed(t)), "string")(text)


_PARTS = "list_filter(string_split(rel_path, '/'), lambda p: p <> '' AND p <> '.')"
_KNOWN = "(VALUES " + ", ".join(str(k) for k in KINDS) + ") k(ext, want_mime, want_magic, want_folder)"
QUERIES = {
    "artifact_violations": (
        lambda t: violations(t("artifacts")),
        f"""WITH p AS (SELECT *, CASE WHEN rel_path LIKE '/%' OR list_contains({_PARTS}, '..') THEN NULL ELSE array_to_string({_PARTS}, '/') END AS path, regexp_extract(lower(rel_path), '\\.([a-z]+)$', 1) AS e FROM artifacts),
        v AS (SELECT p.artifact_id, unnest([CASE WHEN path IS NOT NULL AND EXISTS (SELECT 1 FROM p q WHERE q.generation = p.generation AND q.artifact_id <> p.artifact_id AND lower(replace(q.path, 'ß', 'ss')) = lower(replace(p.path, 'ß', 'ss'))) THEN 'case_collision' END, CASE WHEN mode_bits & 73 <> 0 THEN 'executable' END, CASE WHEN k.ext IS NULL THEN 'extension' END, CASE WHEN path <> 'SKILL.md' AND want_folder <> split_part(path, '/', 1) THEN 'folder' END, CASE WHEN link_count <> 1 THEN 'link_count' END,
          CASE WHEN want_magic <> '' AND NOT magic LIKE want_magic || '%' THEN 'magic' END, CASE WHEN want_mime <> mime THEN 'mime' END, CASE WHEN len(string_split(path, '/')) > 2 THEN 'nested' END, CASE WHEN path IS NULL THEN 'path' END]) AS v FROM p LEFT JOIN {_KNOWN} ON k.ext = p.e)
        SELECT artifact_id, coalesce(string_agg(v, ',' ORDER BY v), '') AS violations FROM v GROUP BY artifact_id""",
    ),
    "exported_artifacts": (
        lambda t: exportable(t("artifacts")),
        """SELECT a.artifact_id, a.rel_path, a.digest, sha{'salt-1:' || CAST(a.artifact_id AS STRING)} AS evidence_ref FROM artifacts a WHERE a.link_count = 1 AND a.artifact_id % 12 IN (0, 1, 2, 3, 8) AND (a.artifact_id % 12 <> 3 OR a.artifact_id % 5 <> 0 AND a.artifact_id % 7 <> 1)
        AND NOT EXISTS (SELECT 1 FROM artifacts b WHERE b.generation = a.generation AND b.artifact_id <> a.artifact_id AND lower(replace(b.rel_path, 'ß', 'ss')) = lower(replace(a.rel_path, 'ß', 'ss')))""",
    ),
    "active_document_flags": (
        lambda t: active(t("artifacts")),
        "SELECT artifact_id, " + ", ".join(f"coalesce(regexp_matches(html, '{p}'), false) AS has_{k}" for k, p in ACTIVE.items()) + " FROM artifacts",
    ),
    "generation_manifests": (
        lambda t: generations(t("artifacts")),
        "SELECT generation, count(*) AS n_files, sha256(string_agg(digest || ' ' || rel_path || ' ' || artifact_id, chr(10) ORDER BY digest || ' ' || rel_path || ' ' || artifact_id)) AS manifest_digest FROM artifacts GROUP BY generation",
    ),
    "newest_versions": (
        lambda t: newest(t("versions")),
        """SELECT capability_id, version_id, version FROM (SELECT *, row_number() OVER (PARTITION BY capability_id ORDER BY CAST(split_part(version, '.', 1) AS INT) DESC, CAST(split_part(version, '.', 2) AS INT) DESC, CAST(split_part(version, '.', 3) AS INT) DESC, version_id DESC) AS r FROM versions) v WHERE r = 1""",
    ),
    "approval_subjects": (
        lambda t: subjects(t("versions")),
        """SELECT v.version_id, sha256(encode('approval-subject/v1') || '\\x00'::BLOB || encode('{"capability":' || v.capability_id || ',"digest":"' || v.digest || '","versions":"' || (SELECT sha256(string_agg(CAST(s.version_id AS VARCHAR), ',' ORDER BY CAST(s.version_id AS VARCHAR))) FROM versions s WHERE s.capability_id = v.capability_id) || '"}')) AS subject FROM versions v""",
    ),
    "idempotent_ingest": (
        lambda t: ingest_keys(t("documents")),
        "SELECT sha256('v:' || coalesce(source, '') || chr(31) || 'n' || chr(31) || 'v:1' || chr(31) || 'v:' || sha256(coalesce(text, ''))) AS key, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY 1",
    ),
    "endpoint_hosts": (
        lambda t: endpoints(t("pages")),
        "SELECT page_id, lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) AS host, regexp_matches(lower(url), '^https://[^/?#]*\\.example\\.org([/?#]|$)') AS allowed FROM pages",
    ),
    "expansion_ratios": (
        lambda t: expansion(t("artifacts")),
        "SELECT artifact_id, strlen(coalesce(html, '')) AS n_bytes, strlen(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) AS n_text, strlen(coalesce(html, '')) > 10 * strlen(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) AS expands FROM artifacts",
    ),
    "configuration_digests": (
        lambda t: settings(t("events")),
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256('k=' || coalesce(json_extract_string(props, '$.k'), 'null') || ';type=' || event_type || ';user=' || user_id) AS digest FROM events",
    ),
    "checksums": (
        lambda t: t("events").select("event_id", crc32c_of(F.concat("event_type", F.lit(":"), "props").cast("binary")).alias("crc32c")),
        """SELECT event_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(event_type || ':' || props, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
          lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 2197175160))), 4294967295) AS crc32c FROM events""",
    ),
    "canonical_settings": (
        lambda t: t("events").select("event_id", canonical_json(F.concat(F.lit('{ "z": 1.50, "a": '), "props", F.lit(', "n": 1e21}'))).alias("canonical")),
        """SELECT event_id, '{"a":{"k":' || json_extract_string(props, '$.k') || '},"n":1e+21,"z":1.5}' AS canonical FROM events""",
    ),
    "folded_paths": (
        lambda t: t("artifacts").select("artifact_id", casefold(F.concat(F.lit("STRAßE/"), "rel_path")).alias("folded")),
        "SELECT artifact_id, 'strasse/' || lower(replace(rel_path, 'ß', 'ss')) AS folded FROM artifacts",
    ),
    "audit_log": (
        lambda t: audit(t("requests")),
        "SELECT principal, operation, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS n_bytes, min(request_id) AS first_id FROM requests GROUP BY principal, operation",
    ),
}
