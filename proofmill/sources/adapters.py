"""Session adapters: native records to one canonical event, a closed set with a matrix of what may ship."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a canonical event, in order.
EVENT = ("adapter", "root_id", "stream_seq", "event_type", "actor_kind", "payload_digest")
INVARIANTS = ("acyclic", "calls", "identity", "order", "references")


def _canonical(adapter: str, root, seq, kind, actor, payload) -> list:
    return [c.alias(n) for c, n in zip((F.lit(adapter), root.cast("long"), seq.cast("long"), kind, actor, F.sha2(F.coalesce(payload, F.lit("")), 256)), EVENT)]


def chat(turns: DataFrame) -> DataFrame:
    """Chat transcripts: a turn is an event."""
    return turns.select(*_canonical("chat", F.col("conv_id"), F.col("turn"), F.lit("message"), F.col("role"), F.col("text")))


def activity(events: DataFrame) -> DataFrame:
    """Activity logs: a user's events are a stream; purchases and errors are tool results."""
    kind = F.when(F.col("event_type").isin("purchase", "error"), "result").otherwise("command")
    return events.select(*_canonical("activity", F.col("user_id"), F.col("event_id"), kind, F.lit("user"), F.col("props")))


def web(pages: DataFrame) -> DataFrame:
    """Page snapshots: one inert document each."""
    return pages.select(*_canonical("web", F.col("page_id"), F.lit(0), F.lit("document"), F.lit("author"), F.col("html")))


ADAPTERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {"activity": ("events", activity), "chat": ("conversations", chat), "web": ("pages", web)}


def combined(read: Callable[[str], DataFrame]) -> DataFrame:
    """The events of all adapters."""
    return reduce(DataFrame.unionByName, [adapter(read(table)) for table, adapter in ADAPTERS.values()])


def shippable(fixtures: DataFrame) -> DataFrame:
    """Adapter versions that may ship: those whose fixtures pass every invariant; one without a fixture does not."""
    passed = F.array_sort(F.collect_set(F.when(F.col("passed"), F.col("invariant"))))
    g = fixtures.groupBy("adapter", "version").agg(F.min("passed").alias("all_passed"), passed.alias("names"))
    return g.select("adapter", "version", (F.col("all_passed") & (F.size("names") == len(INVARIANTS))).alias("ships"))


_FIXTURES = "SELECT DISTINCT event_type AS adapter, user_id % 12 AS version, CASE event_id % 5 WHEN 0 THEN 'acyclic' WHEN 1 THEN 'calls' WHEN 2 THEN 'identity' WHEN 3 THEN 'order' ELSE 'references' END AS invariant, NOT (user_id % 12 = 5 AND event_id % 5 = 2) AS passed FROM events WHERE NOT (user_id % 12 = 7 AND event_id % 5 = 1)"
QUERIES = {
    "canonical_events": (
        lambda t: combined(t).groupBy("adapter", "event_type", "actor_kind").agg(F.count("*").alias("n_events"), F.count_distinct("root_id").alias("n_roots"), F.count_distinct("payload_digest").alias("n_payloads")),
        """SELECT adapter, event_type, actor_kind, count(*) AS n_events, count(DISTINCT root_id) AS n_roots, count(DISTINCT p) AS n_payloads FROM (SELECT 'chat' AS adapter, conv_id AS root_id, 'message' AS event_type, role AS actor_kind, coalesce(text, '') AS p FROM conversations
        UNION ALL SELECT 'activity', user_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'result' ELSE 'command' END, 'user', props FROM events UNION ALL SELECT 'web', page_id, 'document', 'author', html FROM pages) u GROUP BY ALL""",
    ),
    "shippable_adapters": (
        lambda t: shippable(t.sql(_FIXTURES)),
        f"WITH f AS ({_FIXTURES}) SELECT adapter, version, count(DISTINCT invariant) = 5 AND count(*) FILTER (WHERE NOT passed) = 0 AS ships FROM f GROUP BY adapter, version",
    ),
}
