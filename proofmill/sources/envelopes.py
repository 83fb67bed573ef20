"""Session files of JSON lines as full event envelopes: three native formats, read in one pass, whole files or nothing.

A line that does not parse, has a member or a version that its format does not list, or says something
that an envelope cannot hold, is refused with a reason, and its file with it. Nothing is inferred: an
event's parent, call, order and actor are what the line states, and what it leaves out is a loss by name.
Every event is made from its own line, so reading takes no shuffle; what must hold between events is
asked of nodes and links by the operators on event graphs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sessions import HARMLESS

SCHEMA = "1"
#: The members of each native format and the versions that may be read.
FORMATS = {
    "linear": (("1",), "actor actor_id at call chunk kind offset project stream text"),
    "tree": (("2",), "actor_id agent at blocks id parent project replaces role seq session spawned_by"),
    "steps": (("1",), "actor_id artifacts from_step from_task input ok output project step task tool"),
}
KINDS = ("message", "call", "chunk", "result", "summary")
BLOCKS = ("text", "tool_use", "tool_result")
#: The head of a line, format and version, as far as it can be read without the rest.
_HEAD = r'^\s*\{\s*"format"\s*:\s*"([^"\\]*)"\s*,\s*"version"\s*:\s*"([^"\\]*)"'
_LINE = """format string, version string, actor string, actor_id string, agent string, at timestamp_ntz, artifacts array<string>, blocks array<struct<type: string, text: string, id: string>>, call string, chunk long, from_step long, from_task string,
  id string, input string, kind string, offset long, ok boolean, output string, parent string, project string, replaces string, role string, seq long, session string, spawned_by string, step long, stream string, task string, text string, tool string, broken string"""
#: Columns of an envelope, in order.
ENVELOPE = (
    "schema_version", "event_id", "native_id", "native_offset", "snapshot_id", "root_id", "session_id", "thread_id", "branch_id", "parent_id", "span_id", "event_type", "actor_kind", "actor_id", "project_id", "native_at", "stream_seq",
    "call_id", "chunk_no", "marker", "replaces_id", "spawner_id", "is_child", "segments", "artifacts", "outcome", "losses",
)


def _id(*parts) -> Column:
    """Names joined by colons; null if one of them is."""
    return reduce(lambda a, b: F.concat(a, F.lit(":"), b), [p if isinstance(p, Column) else F.lit(p) for p in parts])


def _segment(kind: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def _losses(**when: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in when.items()]))


def _envelope(**given: Column) -> Column:
    empty = {"segments": "array<struct<kind: string, digest: string, n_bytes: bigint>>", "artifacts": "array<string>", "losses": "array<string>", "native_offset": "long", "stream_seq": "long", "chunk_no": "long", "native_at": "timestamp_ntz", "is_child": "boolean"}
    given |= {"schema_version": F.lit(SCHEMA), "snapshot_id": F.col("snapshot_id")}
    return F.struct(*[given.get(c, F.lit(None)).cast(empty.get(c, "string")).alias(c) for c in ENVELOPE])


def _linear(r) -> Column:
    """A stream of numbered records; the record before is the parent."""
    root, summary = _id("linear", r("stream")), r("kind") == "summary"
    return F.array(_envelope(
        event_id=_id(root, r("offset").cast("string")), native_id=r("offset").cast("string"), native_offset=r("offset"), stream_seq=r("offset"), root_id=root, session_id=r("stream"),
        parent_id=F.when(r("offset") > 0, _id(root, (r("offset") - 1).cast("string"))), event_type=F.when(summary, "message").otherwise(r("kind")), marker=F.when(summary, "compaction"), actor_kind=r("actor"), actor_id=r("actor_id"),
        project_id=r("project"), native_at=r("at"), call_id=_id(root, r("call")), chunk_no=r("chunk"), is_child=F.lit(False), segments=F.when(r("text").isNull(), F.array()).otherwise(F.array(_segment(F.lit("text"), r("text")))), artifacts=F.array(),
        losses=_losses(omitted_user_content=r("text").isNull() & (r("actor") == "user"), wall_clock=r("at").isNull()),
    ))


def _tree(r) -> Column:
    """Records that name their parent; an agent's side of a session is a root of its own that a record spawned."""
    session = _id("tree", r("session"))
    root = F.when(r("agent").isNull(), session).otherwise(_id(session, r("agent")))
    kinds = F.transform(r("blocks"), lambda b: b["type"])
    tool = F.filter(r("blocks"), lambda b: b["type"] != "text")
    kind = F.when(F.array_contains(kinds, "tool_use"), "call").when(F.array_contains(kinds, "tool_result"), "result").otherwise("message")
    texts = F.transform(F.filter(r("blocks"), lambda b: b["text"].isNotNull()), lambda b: _segment(b["type"], b["text"]))
    return F.array(_envelope(
        event_id=_id(session, r("id")), native_id=r("id"), native_offset=r("seq"), stream_seq=r("seq"), root_id=root, session_id=r("session"), thread_id=r("agent"), parent_id=_id(session, r("parent")), event_type=kind,
        marker=F.when(r("replaces").isNotNull(), "edit"), replaces_id=_id(session, r("replaces")), spawner_id=_id(session, r("spawned_by")), is_child=r("agent").isNotNull(), actor_kind=r("role"), actor_id=r("actor_id"), project_id=r("project"), native_at=r("at"),
        call_id=_id(root, F.get(tool, F.lit(0))["id"]), segments=texts, artifacts=F.array(), losses=_losses(omitted_user_content=(F.size(texts) == 0) & (r("role") == "user"), wall_clock=r("at").isNull()),
    ))


def _steps(r) -> Column:
    """One record a step: a call and, once there is an outcome, its result. The format has no clock."""
    root = _id("steps", r("task"))
    span = _id(root, r("step").cast("string"))
    common = {"native_id": r("step").cast("string"), "root_id": root, "session_id": r("task"), "span_id": span, "actor_kind": F.lit("agent"), "actor_id": r("actor_id"), "project_id": r("project"), "call_id": span, "is_child": r("from_task").isNotNull()}
    spawner = F.when(r("step") == 0, _id("steps", r("from_task"), r("from_step").cast("string"), "call"))
    said = lambda kind, c: F.when(c.isNull(), F.array()).otherwise(F.array(_segment(F.lit(kind), c)))
    call = _envelope(**common, event_id=_id(span, "call"), native_offset=2 * r("step"), stream_seq=2 * r("step"), parent_id=F.when(r("step") > 0, _id(root, (r("step") - 1).cast("string"), "result")), spawner_id=spawner, event_type=F.lit("call"), segments=said("input", r("input")), artifacts=F.coalesce(r("artifacts"), F.array()), losses=_losses(wall_clock=F.lit(True)))
    result = _envelope(**common, event_id=_id(span, "result"), native_offset=2 * r("step") + 1, stream_seq=2 * r("step") + 1, parent_id=_id(span, "call"), event_type=F.lit("result"), segments=said("output", r("output")), artifacts=F.array(), outcome=F.when(r("ok"), "ok").otherwise("error"), losses=_losses(wall_clock=F.lit(True)))
    return F.when(r("ok").isNull(), F.array(call)).otherwise(F.array(call, result))


_ADAPTERS = {"linear": _linear, "tree": _tree, "steps": _steps}


def parsed(lines: DataFrame) -> DataFrame:
    """snapshot_id, the record r of every line, and the reason why it is refused, if it is.

    lines (snapshot_id, line); a null or empty line is malformed, as a file of lines has none. A line that
    does not parse, but whose head names a known format and a version that may not be read, is refused for
    its version, since a version may have a syntax of its own.
    """
    r = lambda name: F.col("r")[name]
    rows = lines.select("snapshot_id", "line", F.from_json("line", _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"))
    is_ = lambda f: r("format") == f
    known = reduce(lambda c, f: c.when(is_(f), F.array(*map(F.lit, ["format", "version", *FORMATS[f][1].split()]))), FORMATS, F.when(F.lit(False), F.array()))
    version = reduce(lambda c, f: c | (is_(f) & r("version").isin(*FORMATS[f][0])), FORMATS, F.lit(False))
    head = lambda k: F.regexp_extract("line", _HEAD, k)
    other = reduce(lambda c, f: c | ((head(1) == f) & ~head(2).isin(*FORMATS[f][0])), FORMATS, F.lit(False))
    keys = F.json_object_keys("line")
    no_place = F.when(is_("linear"), r("stream").isNull() | r("offset").isNull() | (r("offset") < 0)).when(is_("tree"), r("session").isNull() | r("id").isNull() | r("seq").isNull() | (r("seq") < 0)).otherwise(r("task").isNull() | r("step").isNull() | (r("step") < 0))
    odd = F.when(is_("linear"), ~F.coalesce(r("kind").isin(*KINDS), F.lit(False))).when(is_("tree"), F.exists(r("blocks"), lambda b: ~F.coalesce(b["type"].isin(*BLOCKS), F.lit(False)))).otherwise(False)
    calls = is_("tree") & (F.size(F.filter(r("blocks"), lambda b: b["type"] != "text")) > 1)
    no = lambda c: F.coalesce(c, F.lit(False))
    broken = F.col("r").isNull() | r("broken").isNotNull() | keys.isNull()
    reason = (
        F.when(broken & no(other), "version").when(broken, "malformed").when(~no(r("format").isin(*FORMATS)), "format").when(~no(version), "version").when(F.size(F.array_except(keys, known)) > 0, "member")
        .when(no(no_place), "place").when(no(odd) | (is_("tree") & r("blocks").isNull()), "kind").when(no(calls), "calls")
    )
    return rows.select("snapshot_id", "r", reason.alias("refused"))


def events(lines: DataFrame) -> DataFrame:
    """The envelopes of every line that is not refused."""
    made = reduce(lambda c, f: c.when(F.col("r")["format"] == f, _ADAPTERS[f](lambda n: F.col("r")[n])), FORMATS, F.when(F.lit(False), F.array(_envelope())))
    return parsed(lines).filter("refused is null").select(F.explode(made).alias("e")).select("e.*")


def prohibited(losses: str = "losses") -> Column:
    """Losses that are not harmless."""
    return F.array_except(losses, F.array(*map(F.lit, HARMLESS)))


def admissions(lines: DataFrame) -> DataFrame:
    """Every file: its lines, those that are refused and why, events with a prohibited loss, and whether it is admitted.

    One refused line, or one such loss, leaves nothing of the file.
    """
    rows = parsed(lines).groupBy("snapshot_id").agg(F.count("*").alias("n_lines"), F.count("refused").alias("n_refused"), F.array_join(F.array_sort(F.collect_set("refused")), ",").alias("reasons"))
    lost = events(lines).filter(F.size(prohibited()) > 0).groupBy("snapshot_id").agg(F.count("*").alias("n_lost"))
    n = F.coalesce("n_lost", F.lit(0)).cast("long")
    return rows.join(lost, "snapshot_id", "left").select("snapshot_id", "n_lines", "n_refused", "reasons", n.alias("n_lost"), ((F.col("n_refused") == 0) & (n == 0)).alias("admitted"))


def admitted(lines: DataFrame) -> DataFrame:
    """The envelopes of admitted files."""
    return events(lines).join(admissions(lines).filter("admitted").select("snapshot_id"), "snapshot_id", "left_semi").select(*ENVELOPE)


def links(envelopes: DataFrame) -> DataFrame:
    """The edges that envelopes state: order, spawned-by (from the spawning event), supersedes, and references to artifacts, which lie outside."""
    edge = lambda src, dst, kind, state="internal": F.when(src.isNotNull() & dst.isNotNull(), F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), F.lit(state).alias("ref_state")))
    me = F.col("event_id")
    own = F.array_compact(F.array(edge(F.col("parent_id"), me, "order"), edge(F.col("spawner_id"), me, "spawned-by"), edge(me, F.col("replaces_id"), "supersedes")))
    outside = F.transform("artifacts", lambda a: F.struct(me.alias("src"), a.alias("dst"), F.lit("refers").alias("edge_type"), F.lit("external").alias("ref_state")))
    return envelopes.select("root_id", F.explode(F.concat(own, outside)).alias("e")).select("root_id", "e.*")


def nodes(envelopes: DataFrame) -> DataFrame:
    """Envelopes as nodes of an event graph; of several losses a prohibited one counts first. A user's event may carry a claim."""
    loss = F.coalesce(F.get(prohibited(), F.lit(0)), F.get("losses", F.lit(0)))
    return envelopes.select("root_id", "snapshot_id", "native_offset", "event_id", "stream_seq", "event_type", "call_id", "chunk_no", "actor_kind", "actor_id", "marker", "is_child", (F.col("actor_kind") == "user").alias("claim_bearing"), loss.alias("loss"))


_SHOWN = "event_id root_id snapshot_id native_offset parent_id event_type actor_kind call_id chunk_no marker replaces_id spawner_id is_child outcome".split()
_CONV = "CAST(conv_id AS STRING)"
_SEEN = "FROM conversations WHERE NOT (conv_id % 37 = 5 OR conv_id % 41 = 6 AND turn = 1 OR conv_id % 43 = 7 AND turn = 0 OR conv_id % 47 = 8 AND turn = 2)"
_EVENTS = f"""e AS (SELECT 'linear:{{c}}:' || CAST(turn AS STRING) AS event_id, 'linear:{{c}}' AS root_id, 's{{c}}' AS snapshot_id, turn AS native_offset, CASE WHEN turn > 0 THEN 'linear:{{c}}:' || CAST(turn - 1 AS STRING) END AS parent_id,
    CASE turn WHEN 1 THEN 'call' WHEN 2 THEN 'chunk' WHEN 3 THEN 'result' ELSE 'message' END AS event_type, role AS actor_kind, CASE WHEN turn BETWEEN 1 AND 3 THEN 'linear:{{c}}:k' END AS call_id, CASE WHEN turn = 2 THEN 0 END AS chunk_no, CASE WHEN turn = 5 THEN 'compaction' END AS marker,
    NULL AS replaces_id, NULL AS spawner_id, false AS is_child, NULL AS outcome, CAST(text IS NOT NULL AS INT) AS n_segments, coalesce(strlen(text), 0) AS n_bytes, concat_ws(',', CASE WHEN text IS NULL AND role = 'user' THEN 'omitted_user_content' END, CASE WHEN conv_id % 10 = 3 THEN 'wall_clock' END) AS losses {_SEEN} AND conv_id % 3 = 0
  UNION ALL SELECT 'tree:{{c}}:m' || CAST(turn AS STRING), 'tree:{{c}}' || CASE WHEN turn >= 4 THEN ':a' ELSE '' END, 's{{c}}', CASE WHEN turn >= 4 THEN turn - 4 ELSE turn END, CASE WHEN turn NOT IN (0, 4) THEN 'tree:{{c}}:m' || CAST(turn - 1 AS STRING) END,
    CASE turn WHEN 1 THEN 'call' WHEN 2 THEN 'result' ELSE 'message' END, role, CASE WHEN turn IN (1, 2) THEN 'tree:{{c}}:t' END, NULL, CASE WHEN turn = 3 THEN 'edit' END, CASE WHEN turn = 3 THEN 'tree:{{c}}:m0' END, CASE WHEN turn = 4 THEN 'tree:{{c}}:m1' END, turn >= 4, NULL, CAST(text IS NOT NULL AS INT), coalesce(strlen(text), 0),
    CASE WHEN text IS NULL AND role = 'user' THEN 'omitted_user_content' ELSE '' END {_SEEN} AND conv_id % 3 = 1
  UNION ALL SELECT 'steps:{{c}}:' || CAST(turn AS STRING) || k.k, 'steps:{{c}}', 's{{c}}', 2 * turn + k.n, CASE WHEN k.n = 1 THEN 'steps:{{c}}:' || CAST(turn AS STRING) || ':call' WHEN turn > 0 THEN 'steps:{{c}}:' || CAST(turn - 1 AS STRING) || ':result' END, substr(k.k, 2), 'agent', 'steps:{{c}}:' || CAST(turn AS STRING), NULL, NULL, NULL,
    CASE WHEN turn = 0 AND k.n = 0 AND conv_id % 2 = 1 THEN 'steps:' || CAST(conv_id - 3 AS STRING) || ':0:call' END, conv_id % 2 = 1, CASE WHEN k.n = 1 THEN CASE WHEN turn % 4 = 3 THEN 'error' ELSE 'ok' END END, CASE WHEN k.n = 0 THEN CAST(text IS NOT NULL AS INT) ELSE 1 END, CASE WHEN k.n = 0 THEN coalesce(strlen(text), 0) ELSE 4 END, 'wall_clock'
    {_SEEN.replace('FROM conversations', "FROM conversations CROSS JOIN (SELECT ':call' AS k, 0 AS n UNION ALL SELECT ':result', 1) k")} AND conv_id % 3 = 2)""".replace("{c}", f"' || {_CONV} || '")
QUERIES = {
    "session_envelopes": (
        lambda t: events(t("native_lines")).select(*_SHOWN, F.size("segments").alias("n_segments"), F.coalesce(F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["n_bytes"]), F.lit(0)).alias("n_bytes"), F.array_join("losses", ",").alias("losses")),
        f"WITH {_EVENTS} SELECT * FROM e",
    ),
    "session_links": (
        lambda t: links(events(t("native_lines"))),
        f"WITH {_EVENTS} SELECT root_id, parent_id AS src, event_id AS dst, 'order' AS edge_type, 'internal' AS ref_state FROM e WHERE parent_id IS NOT NULL UNION ALL SELECT root_id, spawner_id, event_id, 'spawned-by', 'internal' FROM e WHERE spawner_id IS NOT NULL UNION ALL SELECT root_id, event_id, replaces_id, 'supersedes', 'internal' FROM e WHERE replaces_id IS NOT NULL UNION ALL SELECT root_id, event_id, 'file:' || event_id, 'refers', 'external' FROM e WHERE event_id LIKE 'steps:%:2:call'",
    ),
    "session_admissions": (
        lambda t: admissions(t("native_lines")),
        f"""WITH b AS (SELECT conv_id, text, role, CASE WHEN conv_id % 37 = 5 THEN 'version' WHEN conv_id % 41 = 6 AND turn = 1 THEN 'malformed' WHEN conv_id % 43 = 7 AND turn = 0 THEN 'member' WHEN conv_id % 47 = 8 AND turn = 2 THEN 'place' END AS bad FROM conversations),
        g AS (SELECT 's' || {_CONV} AS snapshot_id, count(*) AS n_lines, count(bad) AS n_refused, coalesce(string_agg(DISTINCT bad, ',' ORDER BY bad), '') AS reasons, count(*) FILTER (WHERE bad IS NULL AND text IS NULL AND role = 'user' AND conv_id % 3 < 2) AS n_lost FROM b GROUP BY conv_id)
        SELECT *, n_refused = 0 AND n_lost = 0 AS admitted FROM g""",
    ),
}
