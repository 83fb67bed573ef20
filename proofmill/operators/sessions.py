"""Event graphs of agent sessions: what must hold of their nodes and edges, and what follows if it does not.

"Earlier" is reachability along edges, never a comparison of clocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import cut
from ..plans.reachability import earlier, labels

#: Losses that leave the meaning whole; every other one quarantines the root case.
HARMLESS = ("formatting", "token_counts", "wall_clock", "hidden_reasoning")


def collisions(nodes: DataFrame) -> DataFrame:
    """Event ids that several nodes have."""
    return nodes.groupBy("event_id").agg(F.count("*").alias("n")).filter("n > 1")


def gaps(nodes: DataFrame) -> DataFrame:
    """Nodes whose position in their native stream does not follow the one before."""
    w = Window.partitionBy("root_id").orderBy("native_offset")
    return nodes.select("root_id", "native_offset", "stream_seq", F.lag("stream_seq").over(w).alias("previous")).filter(F.col("stream_seq") != F.coalesce("previous", F.lit(-1)) + 1)


def places(nodes: DataFrame) -> DataFrame:
    """(event_id, chain, place) of every event: its root's stream and its offset there; the first of several with one id."""
    first = nodes.groupBy("event_id").agg(F.min(F.struct("root_id", "native_offset")).alias("p"))
    return first.select("event_id", F.col("p.root_id").alias("chain"), F.col("p.native_offset").alias("place"))


def order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels of what is earlier, from the streams' own order and all edges between events."""
    return labels(places(nodes), edges)


def calls(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Per call: how often it was made and ended, whether its chunks are 0, 1, ..., and whether call and result match.

    They match if there is one of each and every chunk and the result can be reached from the call.
    """
    of = lambda kind, value: F.when(F.col("event_type") == kind, value)
    mine = nodes.filter("call_id is not null")
    found = mine.groupBy("root_id", "call_id").agg(
        F.count(of("call", 1)).alias("n_calls"), F.count(of("result", 1)).alias("n_results"), F.count(of("chunk", 1)).alias("n_chunks"),
        F.count_distinct(of("chunk", F.col("chunk_no"))).alias("kinds"), F.max(of("chunk", F.col("chunk_no"))).alias("top"), F.min(of("call", F.col("native_offset"))).alias("a_place"),
    )
    ends = mine.filter("event_type in ('chunk', 'result')").select("root_id", "call_id", F.col("native_offset").alias("b_place"))
    pairs = ends.join(found.select("root_id", "call_id", "a_place"), ["root_id", "call_id"]).withColumns({"a_chain": F.col("root_id"), "b_chain": F.col("root_id")})
    after = earlier(pairs, known, "a", "b").groupBy("root_id", "call_id").agg(F.min("earlier").alias("after"))
    contiguous = (F.col("n_chunks") == 0) | ((F.col("kinds") == F.col("n_chunks")) & (F.col("top") == F.col("n_chunks") - 1))
    matched = (F.col("n_calls") == 1) & (F.col("n_results") == 1) & F.coalesce("after", F.lit(False))
    return found.join(after, ["root_id", "call_id"], "left").select("root_id", "call_id", "n_calls", "n_results", contiguous.alias("contiguous"), matched.alias("matched"))


def references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every edge: do both its ends resolve, is it marked as outside, or neither?"""
    known = nodes.select("event_id").distinct()
    at = lambda end: known.select(F.col("event_id").alias(end), F.lit(True).alias(f"{end}_there"))
    status = F.when(F.col("src_there") & F.col("dst_there"), "resolved").when(F.col("ref_state").isin("external", "missing"), "marked").otherwise("unresolved")
    return edges.join(at("dst"), "dst", "left").join(at("src"), "src", "left").select("root_id", "src", "dst", "edge_type", status.alias("status"))


def spawns(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Child roots without exactly one spawn edge from an event of another root that precedes them.

    An event that the child's first event leads to does not precede it.
    """
    at = places(nodes)
    src = at.select(F.col("event_id").alias("src"), F.col("chain").alias("b_chain"), F.col("place").alias("b_place"))
    dst = at.select(F.col("event_id").alias("dst"), F.col("chain").alias("a_chain"), F.col("place").alias("a_place"))
    pairs = edges.filter("edge_type = 'spawned-by'").join(src, "src").filter("b_chain <> root_id").join(dst, "dst")
    good = earlier(pairs, known, "a", "b").filter("not earlier").groupBy("root_id").agg(F.count("*").alias("n_spawns"))
    children = nodes.filter("is_child").select("root_id").distinct()
    return children.join(good, "root_id", "left").select("root_id", F.coalesce("n_spawns", F.lit(0)).cast("long").alias("n_spawns")).filter("n_spawns <> 1")


def joins(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Every child's join: is the parent's event missing (an orphan), or not after the event that spawned the child?

    The join edge itself leads there from the child's last event, so an early one closes a cycle: its event
    is then before the spawning one.
    """
    at = places(nodes)
    spot = lambda key, p: at.select(F.col("event_id").alias(key), F.col("chain").alias(f"{p}_chain"), F.col("place").alias(f"{p}_place"))
    made = edges.filter("edge_type = 'spawned-by'").select("root_id", "src").join(spot("src", "b"), "src").drop("src")
    joined = edges.filter("edge_type = 'joined'").select("root_id", "dst").join(spot("dst", "a"), "dst", "left").join(made, "root_id", "left")
    before = earlier(joined, known, "a", "b")
    same = (F.col("a_chain") == F.col("b_chain")) & (F.col("a_place") == F.col("b_place"))
    early = F.col("b_place").isNull() | F.col("earlier") | F.coalesce(same, F.lit(False))
    return before.groupBy("root_id", "dst").agg(F.max(F.col("a_place").isNull()).alias("orphan"), F.max(early).alias("early")).select("root_id", "orphan", "early")


def messages(records: DataFrame) -> DataFrame:
    """Every message: sent, delivered and perhaps consumed, in this order?"""
    place = {k: F.min(F.when(F.col("kind") == k, F.col("seq"))) for k in ("sent", "delivered", "consumed")}
    m = records.groupBy("message_id").agg(*[c.alias(k) for k, c in place.items()])
    order = F.when(F.col("sent").isNull() | F.col("delivered").isNull(), "incomplete").when((F.col("sent") > F.col("delivered")) | (F.col("consumed") < F.col("delivered")), "disordered")
    return m.select("message_id", order.when(F.col("consumed").isNull(), "delivered").otherwise("consumed").alias("status"))


def owned(nodes: DataFrame) -> DataFrame:
    """Which events may carry a claim of the owner, and the digest of the text that is kept for that."""
    mine = F.coalesce(F.col("actor_id") == F.col("owner_id"), F.lit(False))
    return nodes.select("root_id", "native_offset", mine.alias("attributable"), F.when(mine, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("kept_digest"))


def quarantine(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every root case with the number of kinds of prohibited loss in it; one quarantines all its events."""
    event_roots, known = nodes.select("event_id", "root_id").distinct(), order(nodes, edges)
    own = earlier(nodes.select(F.col("root_id").alias("a_chain"), F.col("native_offset").alias("a_place"), F.col("root_id").alias("b_chain"), F.col("native_offset").alias("b_place")), known, "a", "b")
    bad = [
        collisions(nodes).join(event_roots, "event_id").select("root_id", F.lit("collision").alias("reason")),
        gaps(nodes).select("root_id", F.lit("gap").alias("reason")),
        calls(nodes, known).filter("not contiguous or not matched").select("root_id", F.lit("call").alias("reason")),
        references(edges, nodes).filter("status = 'unresolved'").select("root_id", F.lit("reference").alias("reason")),
        spawns(nodes, edges, known).select("root_id", F.lit("spawn").alias("reason")),
        joins(nodes, edges, known).filter("orphan or early").select("root_id", F.lit("join").alias("reason")),
        own.filter("earlier").select(F.col("a_chain").alias("root_id"), F.lit("cycle").alias("reason")).distinct(),
        nodes.filter("actor_id is null and claim_bearing").select("root_id", F.lit("owner").alias("reason")),
        nodes.filter(~F.col("loss").isin(*HARMLESS)).select("root_id", F.lit("loss").alias("reason")),
    ]
    reasons = bad[0]
    for more in bad[1:]:
        reasons = reasons.unionByName(more)
    n = reasons.groupBy("root_id").agg(F.count_distinct("reason").alias("n_reasons"))
    return nodes.select("root_id").distinct().join(n, "root_id", "left").select("root_id", F.coalesce("n_reasons", F.lit(0)).cast("long").alias("n_reasons"), F.col("n_reasons").isNotNull().alias("quarantined"))


def levels(edges: DataFrame) -> DataFrame:
    """event_id and level (longest way from an event without predecessor) of all events; null on and behind a cycle.

    Round after round the events go that have no predecessor left; what remains can't be ordered.
    """
    edges = edges.select("src", "dst")
    left = cut(edges.select(F.explode(F.array("src", "dst")).alias("event_id")).distinct())
    edges, done, level = cut(edges.distinct()), [], 0
    while True:
        free = cut(left.join(edges.select(F.col("dst").alias("event_id")), "event_id", "left_anti"))
        if free.isEmpty():
            break
        done.append(free.withColumn("level", F.lit(level).cast("long")))
        left = cut(left.join(free, "event_id", "left_anti"))
        edges, level = cut(edges.join(free.withColumnRenamed("event_id", "src"), "src", "left_anti")), level + 1
    out = left.withColumn("level", F.lit(None).cast("long"))
    for d in done:
        out = out.unionByName(d)
    return out


def reached(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """Per root the number of pairs of its events of which one is earlier, and whether there is a cycle.

    Pairs are counted, not listed: an event is before all that follow it in its stream, and before all from
    the earliest place to which its labels lead back.
    """
    known = labels(spots, edges).filter("chain = to_chain").select("chain", "place", "earliest")
    later = Window.partitionBy("chain").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = spots.select("chain", "place").withColumn("earliest", F.lit(None).cast("long")).unionByName(known.select("chain", "place", F.col("earliest").cast("long").alias("earliest")))
    back = rows.withColumns({"back": F.min("earliest").over(later), "is_event": F.col("earliest").isNull()}).filter("is_event")
    last = spots.groupBy("chain").agg(F.max("place").alias("last"))
    n = F.col("last") + 1 - F.least(F.col("place") + 1, F.coalesce("back", F.col("place") + 1))
    return back.join(last, "chain").groupBy(F.col("chain").alias("root_id")).agg(F.sum(n).cast("long").alias("n_pairs"), F.max(F.coalesce(F.col("back") <= F.col("place"), F.lit(False))).alias("cyclic")).filter("n_pairs > 0")


def current(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per root the last message that no edge supersedes."""
    gone = edges.filter("edge_type = 'supersedes'").select(F.col("dst").alias("event_id"))
    return nodes.filter("event_type = 'message' or event_type = 'chunk'").join(gone, "event_id", "left_anti").groupBy("root_id").agg(F.max("native_offset").alias("native_offset"))


def statistics(nodes: DataFrame) -> DataFrame:
    """Bytes, events and independent root cases of every snapshot."""
    return nodes.groupBy("snapshot_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n_bytes"), F.count("*").alias("n_events"), F.count_distinct("root_id").alias("n_roots"))


def markers(nodes: DataFrame) -> DataFrame:
    """Compaction markers: the visible events each stands for, which are all before it, and nothing hidden."""
    before = Window.partitionBy("root_id").orderBy("native_offset").rowsBetween(Window.unboundedPreceding, -1)
    seen = nodes.withColumn("n_visible", F.count("*").over(before)).withColumn("hidden", F.col("stream_seq") != F.col("n_visible"))
    return seen.filter("marker = 'compaction'").select("root_id", "native_offset", "n_visible", "hidden")


ORDER = "edge_type = 'order'"
#: Events by place: the first of several with one id, every edge between them, and what can be reached; a stream's own order is an edge to the next place.
_REACH = """spot AS MATERIALIZED (SELECT event_id, min((root_id, native_offset)) AS p FROM nodes GROUP BY event_id),
  jump AS MATERIALIZED (SELECT DISTINCT a.p AS a, b.p AS b FROM edges e JOIN spot a ON a.event_id = e.src JOIN spot b ON b.event_id = e.dst WHERE a.p[1] <> b.p[1] OR b.p[2] <= a.p[2]),
  hop AS (SELECT a, b FROM jump UNION SELECT h.a, j.b FROM hop h JOIN jump j ON j.a[1] = h.b[1] AND j.a[2] >= h.b[2])"""
_BEFORE = "({a}[1] = {b}[1] AND {a}[2] < {b}[2] OR EXISTS (SELECT 1 FROM hop h WHERE h.a[1] = {a}[1] AND h.a[2] >= {a}[2] AND h.b[1] = {b}[1] AND h.b[2] <= {b}[2]))"
_CALLS = f"""SELECT c.root_id, c.call_id, (SELECT count(*) FROM nodes n WHERE n.root_id = c.root_id AND n.call_id = c.call_id AND n.event_type = 'call') AS n_calls,
  (SELECT count(*) FROM nodes n WHERE n.root_id = c.root_id AND n.call_id = c.call_id AND n.event_type = 'result') AS n_results,
  (SELECT coalesce(list(n.chunk_no ORDER BY n.chunk_no) = range(count(*)), true) FROM nodes n WHERE n.root_id = c.root_id AND n.call_id = c.call_id AND n.event_type = 'chunk') AS contiguous,
  coalesce((SELECT bool_and({_BEFORE.format(a='m.p', b='e.p')}) FROM (SELECT (n.root_id, min(n.native_offset)) AS p FROM nodes n WHERE n.root_id = c.root_id AND n.call_id = c.call_id AND n.event_type = 'call' GROUP BY n.root_id) m, (SELECT (n.root_id, n.native_offset) AS p FROM nodes n WHERE n.root_id = c.root_id AND n.call_id = c.call_id AND n.event_type IN ('chunk', 'result')) e), false) AS after
  FROM (SELECT DISTINCT root_id, call_id FROM nodes WHERE call_id IS NOT NULL) c"""
_SPAWNS = f"SELECT c.root_id, (SELECT count(*) FROM edges e JOIN spot s ON s.event_id = e.src AND s.p[1] <> e.root_id JOIN spot d ON d.event_id = e.dst WHERE e.edge_type = 'spawned-by' AND e.root_id = c.root_id AND NOT {_BEFORE.format(a='d.p', b='s.p')}) AS n_spawns FROM (SELECT DISTINCT root_id FROM nodes WHERE is_child) c"
_JOINS = f"""SELECT j.root_id, bool_or(d.p IS NULL) AS orphan, bool_or(s.p IS NULL OR coalesce(d.p = s.p OR {_BEFORE.format(a='d.p', b='s.p')}, false)) AS early FROM edges j LEFT JOIN spot d ON d.event_id = j.dst
  LEFT JOIN (SELECT e.root_id, p FROM edges e JOIN spot ON spot.event_id = e.src WHERE e.edge_type = 'spawned-by') s ON s.root_id = j.root_id WHERE j.edge_type = 'joined' GROUP BY j.root_id, j.dst"""
QUERIES = {
    "event_id_collisions": (lambda t: collisions(t("nodes")), "SELECT event_id, count(*) AS n FROM nodes GROUP BY event_id HAVING count(*) > 1"),
    "stream_gaps": (
        lambda t: gaps(t("nodes")),
        "SELECT a.root_id, a.native_offset, a.stream_seq, b.stream_seq AS previous FROM nodes a LEFT JOIN nodes b ON a.root_id = b.root_id AND b.native_offset = a.native_offset - 1 WHERE a.stream_seq <> coalesce(b.stream_seq, -1) + 1",
    ),
    "call_results": (lambda t: calls(t("nodes"), order(t("nodes"), t("edges"))), f"WITH RECURSIVE {_REACH}, c AS ({_CALLS}) SELECT root_id, call_id, n_calls, n_results, contiguous, n_calls = 1 AND n_results = 1 AND after AS matched FROM c"),
    "reference_resolution": (
        lambda t: references(t("edges"), t("nodes")),
        "SELECT root_id, src, dst, edge_type, CASE WHEN dst IN (SELECT event_id FROM nodes) AND src IN (SELECT event_id FROM nodes) THEN 'resolved' WHEN ref_state <> 'internal' THEN 'marked' ELSE 'unresolved' END AS status FROM edges",
    ),
    "spawn_violations": (lambda t: spawns(t("nodes"), t("edges"), order(t("nodes"), t("edges"))), f"WITH RECURSIVE {_REACH}, s AS ({_SPAWNS}) SELECT root_id, n_spawns FROM s WHERE n_spawns <> 1"),
    "child_joins": (
        lambda t: joins(t("nodes"), t("edges"), order(t("nodes"), t("edges"))),
        f"WITH RECURSIVE {_REACH} {_JOINS}",
    ),
    "message_triples": (
        lambda t: messages(t("messages")),
        "SELECT message_id, CASE WHEN s IN ('sent', 'sent,consumed', 'consumed', 'delivered', 'delivered,consumed') THEN 'incomplete' WHEN s = 'sent,delivered' THEN 'delivered' WHEN s = 'sent,delivered,consumed' THEN 'consumed' ELSE 'disordered' END AS status FROM (SELECT message_id, string_agg(kind, ',' ORDER BY seq) AS s FROM messages GROUP BY message_id) m",
    ),
    "owner_claims": (
        lambda t: owned(t("nodes")),
        "SELECT root_id, native_offset, actor_id IS NOT NULL AND actor_id = owner_id AS attributable, CASE WHEN actor_id = owner_id THEN sha{coalesce(text, '')} END AS kept_digest FROM nodes",
    ),
    "quarantined_roots": (
        lambda t: quarantine(t("nodes"), t("edges")),
        f"""WITH RECURSIVE {_REACH}, c AS ({_CALLS}), s AS ({_SPAWNS}), j AS ({_JOINS}), bad AS (
          SELECT n.root_id, 1 AS r FROM nodes n JOIN nodes m ON n.event_id = m.event_id AND (n.root_id, n.native_offset) <> (m.root_id, m.native_offset)
          UNION SELECT a.root_id, 2 FROM nodes a LEFT JOIN nodes b ON a.root_id = b.root_id AND b.native_offset = a.native_offset - 1 WHERE a.stream_seq <> coalesce(b.stream_seq, -1) + 1
          UNION SELECT root_id, 3 FROM c WHERE NOT (contiguous AND n_calls = 1 AND n_results = 1 AND after)
          UNION SELECT root_id, 4 FROM edges WHERE ref_state = 'internal' AND (dst NOT IN (SELECT event_id FROM nodes) OR src NOT IN (SELECT event_id FROM nodes))
          UNION SELECT root_id, 5 FROM s WHERE n_spawns <> 1
          UNION SELECT root_id, 6 FROM nodes WHERE loss = 'omitted_user_content'
          UNION SELECT root_id, 7 FROM j WHERE orphan OR early
          UNION SELECT n.root_id, 8 FROM nodes n JOIN hop h ON h.a[1] = n.root_id AND h.b[1] = n.root_id AND h.a[2] >= n.native_offset AND h.b[2] <= n.native_offset
          UNION SELECT root_id, 9 FROM nodes WHERE claim_bearing AND actor_id IS NULL)
        SELECT n.root_id, count(DISTINCT b.r) AS n_reasons, count(b.r) > 0 AS quarantined FROM (SELECT DISTINCT root_id FROM nodes) n LEFT JOIN bad b ON n.root_id = b.root_id GROUP BY n.root_id""",
    ),
    "event_levels": (
        lambda t: levels(t("edges").filter(ORDER)),
        """WITH RECURSIVE o AS (SELECT src, dst FROM edges WHERE edge_type = 'order'), r AS (SELECT src, dst FROM o UNION SELECT r.src, o.dst FROM r JOIN o ON r.dst = o.src),
          cyclic AS (SELECT DISTINCT b.dst AS event_id FROM r a JOIN r b ON a.src = a.dst AND b.src = a.src), e AS (SELECT src AS event_id FROM o UNION SELECT dst FROM o),
          ways AS (SELECT event_id, 0 AS level FROM e WHERE event_id NOT IN (SELECT dst FROM o) UNION SELECT o.dst, w.level + 1 FROM ways w JOIN o ON w.event_id = o.src WHERE o.dst NOT IN (SELECT event_id FROM cyclic))
        SELECT e.event_id, max(w.level) AS level FROM e LEFT JOIN ways w ON e.event_id = w.event_id GROUP BY e.event_id""",
    ),
    "earlier_events": (
        lambda t: reached(t("spots"), t("edges").filter(ORDER)),
        """WITH RECURSIVE r AS (SELECT root_id, src, dst FROM edges WHERE edge_type = 'order' UNION SELECT r.root_id, r.src, e.dst FROM r JOIN edges e ON e.edge_type = 'order' AND e.root_id = r.root_id AND r.dst = e.src)
        SELECT root_id, count(*) AS n_pairs, bool_or(src = dst) AS cyclic FROM r GROUP BY root_id""",
    ),
    "current_messages": (
        lambda t: current(t("nodes"), t("edges")),
        "SELECT root_id, max(native_offset) AS native_offset FROM nodes n WHERE event_type IN ('message', 'chunk') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.edge_type = 'supersedes' AND e.dst = n.event_id) GROUP BY root_id",
    ),
    "snapshot_statistics": (lambda t: statistics(t("nodes")), "SELECT snapshot_id, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_bytes, count(*) AS n_events, count(DISTINCT root_id) AS n_roots FROM nodes GROUP BY snapshot_id"),
    "compaction_markers": (
        lambda t: markers(t("nodes")),
        "SELECT root_id, native_offset, (SELECT count(*) FROM nodes b WHERE b.root_id = n.root_id AND b.native_offset < n.native_offset) AS n_visible, stream_seq <> (SELECT count(*) FROM nodes b WHERE b.root_id = n.root_id AND b.native_offset < n.native_offset) AS hidden FROM nodes n WHERE marker = 'compaction'",
    ),
}
