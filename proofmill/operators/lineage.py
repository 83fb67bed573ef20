"""Provenance: closures over derivations, clean generations, diffs, lineages and what is left of a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.streams import digests
from ..plans.durable import cut, looked_up, reach, smallest_reachable

#: Words of a shingle, and the share of an item's shingles from which a document is a near duplicate of it.
SHINGLE, NEAR = 5, 0.5


def closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """All nodes derived from the sources, over any number of edges, sources included."""
    step = lambda front: front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node"))
    return reach(sources, step, ["node"])


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def clean(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The nodes of the next generation: all but the closure."""
    return nodes_of(edges).join(closure(edges, sources), "node", "left_anti")


def tombstones(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Every node as it stands after a purge: kept, or a tombstone with a receipt and nothing else."""
    gone = closure(edges, sources).withColumn("purged", F.lit(True))
    receipt = F.sha2(F.concat(F.lit("purge:"), F.col("node").cast("string")), 256)
    return nodes_of(edges).join(gone, "node", "left").select("node", F.coalesce("purged", F.lit(False)).alias("purged"), F.when(F.col("purged"), receipt).alias("receipt"))


def purge_report(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Per kind of node what was there, what the purge removes, and what of the closure the next generation still holds, once it is written."""
    gone, all_ = cut(closure(edges, sources)), cut(nodes_of(edges))
    written = cut(all_.join(gone, "node", "left_anti"))  # the generation as it is read back
    left = written.join(gone, "node", "left_semi").withColumn("left", F.lit(1))
    g = all_.join(gone.withColumn("purged", F.lit(1)), "node", "left").join(written.withColumn("kept", F.lit(1)), "node", "left").join(left, "node", "left")
    return g.groupBy((F.col("node") % 10).alias("kind")).agg(F.count("*").alias("n_nodes"), F.count("purged").alias("n_purged"), F.count("kept").alias("n_kept"), F.count("left").alias("n_left"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every item of either snapshot: added, removed, changed or same."""
    pair = old.toDF("item_id", "before").join(new.toDF("item_id", "after"), "item_id", "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return pair.select("item_id", status.alias("status"))


def manifest_equal(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What either side has and the other has not, repeats counted; equal manifests give no rows."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("extra")))


def lineage(versions: DataFrame) -> DataFrame:
    """Every version's first ancestor and distance from it, by doubling the pointers in each round."""
    now = cut(versions.select("version_id", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("long").alias("depth")))
    while not now.filter("up is not null").isEmpty():
        above = now.toDF("up", "further", "more")
        now = cut(looked_up(now, "up", "version_id", above).select("version_id", F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    root = closure_roots(versions)
    return now.select("version_id", "depth").join(root, "version_id")


def closure_roots(versions: DataFrame) -> DataFrame:
    """Every version's component of parent links, named by its smallest version."""
    links = versions.filter("parent_id is not null").select(F.col("version_id").alias("a"), F.col("parent_id").alias("b"))
    found = smallest_reachable(links).toDF("version_id", "root_id")
    return versions.select("version_id").join(found, "version_id", "left").select("version_id", F.coalesce("root_id", "version_id").alias("root_id"))


def rollback(versions: DataFrame) -> DataFrame:
    """Per capability the current head and the last approved version before it that a rollback, a new child of the head, would copy."""
    head = versions.groupBy("capability_id").agg(F.max("version_id").alias("head_id"))
    approved = versions.filter("state in ('version-approved', 'exported')").join(head, "capability_id").filter("version_id < head_id")
    return head.join(approved.groupBy("capability_id").agg(F.max("version_id").alias("content_of")), "capability_id", "left")


def reevaluated(claims: DataFrame, supports: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Every claim after sources were withdrawn: how many support it still, and what becomes of it."""
    left = supports.join(withdrawn, "source_id", "left_anti").groupBy("claim_id").agg(F.count_distinct("source_id").alias("n_left"))
    had = supports.groupBy("claim_id").agg(F.count_distinct("source_id").alias("n_had"))
    c = claims.select("claim_id", "impact").join(had, "claim_id", "left").join(left, "claim_id", "left").na.fill(0, ["n_had", "n_left"])
    status = F.when(F.col("n_left") == F.col("n_had"), "stands").when((F.col("n_left") == 0) & (F.col("impact") == "high"), "revoked").when(F.col("n_left") == 0, "invalidated").otherwise("demoted")
    return c.select("claim_id", F.col("n_had").cast("long").alias("n_had"), F.col("n_left").cast("long").alias("n_left"), status.alias("status"))


def chain_gaps(lines: DataFrame, orders: DataFrame, customers: DataFrame, nations: DataFrame, regions: DataFrame) -> DataFrame:
    """Every derivation, hop by hop (line, order, customer, nation, region, grant): the first hop that does not resolve, if any."""
    chain = (
        lines.select("l_orderkey", "l_linenumber").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
        .join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal"), "o_custkey", "left")
        .join(F.broadcast(nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey", "left")
        .join(F.broadcast(regions.select(F.col("r_regionkey").alias("n_regionkey"), F.lit(True).alias("there"))), "n_regionkey", "left")
    )
    gap = F.when(F.col("o_custkey").isNull(), "order").when(F.col("c_nationkey").isNull(), "customer").when(F.col("n_regionkey").isNull(), "nation").when(F.col("there").isNull(), "region").when(F.col("c_acctbal") < 0, "grant")
    return chain.select("l_orderkey", "l_linenumber", gap.alias("gap")).filter("gap is not null").groupBy("gap").agg(F.count("*").alias("n_lines"), F.count_distinct("l_orderkey").alias("n_orders"))


#: The hops by which a section leads back to a grant, or to an explicit decision, as (kind, edge, kind).
HOPS = (
    ("section", "compiled_from", "rule"), ("rule", "confirmed_by", "claim"), ("rule", "decided_by", "decision"), ("claim", "supported_by", "span"),
    ("span", "ingested_in", "run"), ("run", "snapshot_of", "snapshot"), ("snapshot", "granted_by", "grant"),
)


def chains(sections: DataFrame, edges: DataFrame, grants: DataFrame) -> DataFrame:
    """Every section (node): does it lead back to an active grant or to a decision, what stops it, and how many snapshots stand behind it.

    edges are (src, dst, edge_type), grants (node, active). One join per hop carries all sections at once;
    a way counts only if its edges have the types of the hops in their order. One complete way is enough;
    where there is none, gap is the hop that is missing on the longest one, or inactive for its grant.
    """
    at = {"section": cut(sections.select(F.col("node").alias("section"), "node").distinct())}
    for kind, edge, to in HOPS:
        step = at[kind].join(edges.filter(F.col("edge_type") == edge).select(F.col("src").alias("node"), "dst"), "node").select("section", F.col("dst").alias("node")).distinct()
        at[to] = cut(step)
    last = at["grant"].join(grants, "node").groupBy("section").agg(F.max("active").alias("active"))
    out = at["section"].select("section").join(last, "section", "left")
    for kind in ("rule", "claim", "decision", "span", "run", "snapshot", "grant"):
        out = out.join(at[kind].groupBy("section").agg(F.count("*").alias(f"n_{kind}")), "section", "left")
    whole = F.coalesce(F.col("active"), F.lit(False)) | F.col("n_decision").isNotNull()
    gap = F.when(F.col("n_grant").isNotNull(), "inactive")
    for kind, edge, to in reversed(HOPS):
        if to not in ("decision", "rule"):
            gap = gap.when(F.col(f"n_{kind}").isNotNull(), edge)
    return out.select("section", whole.alias("complete"), F.when(~whole, gap.otherwise("compiled_from")).alias("gap"), F.coalesce("n_snapshot", F.lit(0)).cast("long").alias("n_snapshots"))


def conflicts(claims: DataFrame) -> DataFrame:
    """Pairs of claims of which one contradicts the other, each pair once, and whether it blocks."""
    other = claims.select(F.col("claim_id").alias("contradicts"), F.col("impact").alias("other_impact"))
    pairs = claims.filter("contradicts is not null").join(other, "contradicts")
    high = (F.col("impact") == "high") | (F.col("other_impact") == "high")
    return pairs.groupBy(F.least("claim_id", "contradicts").alias("a"), F.greatest("claim_id", "contradicts").alias("b")).agg(F.max(high & ~F.col("adjudicated")).alias("blocks"))


def words(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(rows: DataFrame, key: str) -> DataFrame:
    """(key, shingle) of every distinct run of SHINGLE words."""
    w = rows.select(key, words(F.col("text")).alias("w")).filter(F.size("w") >= SHINGLE)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - SHINGLE + 1), lambda k: F.array_join(F.slice("w", k, SHINGLE), " "))
    return w.select(key, F.explode(F.array_distinct(runs)).alias("shingle"))


def near_duplicates(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs of a sealed item and a document that has at least half of its shingles; opaque ids and counts only.

    Only documents' shingles whose 64-bit hash an item has are shuffled, with the string that confirms them.
    """
    mine = shingles(items, "item_id").withColumn("h", F.xxhash64("shingle"))
    theirs = shingles(documents, "doc_id").withColumn("h", F.xxhash64("shingle")).join(mine.select("h").distinct(), "h", "left_semi")
    size = mine.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    hits = theirs.join(mine, ["h", "shingle"]).groupBy("item_id", "doc_id").agg(F.count("*").alias("n_shared"))
    return hits.join(size, "item_id").filter(F.col("n_shared") >= F.col("n_shingles") * NEAR)


def clusters(documents: DataFrame) -> DataFrame:
    """Documents with the same words in the same order as one cluster, named by the smallest id; single ones and those without a word are left out."""
    keyed = documents.select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).select("doc_id", F.sha2(F.array_join("w", " "), 256).alias("k"))
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(first, "k").select("doc_id", F.col("a").alias("cluster_id"))


def synonyms(parts: DataFrame) -> DataFrame:
    """Capability labels merged where they share a word, over any number of steps: cluster of each label."""
    label = parts.select("p_name", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    keep = label.filter(F.length("word") >= 6)
    first = keep.groupBy("word").agg(F.min("p_name").alias("b"))
    links = keep.join(first, "word").select(F.col("p_name").alias("a"), "b")
    found = smallest_reachable(links).toDF("p_name", "cluster")
    return parts.select("p_name").distinct().join(found, "p_name", "left").select("p_name", F.coalesce("cluster", "p_name").alias("cluster"))


def incremental(turns: DataFrame, watermark: int = 3) -> DataFrame:
    """Every append-only session: what is read now, what waits for the next run, and the prefix that a later run must find again.

    A session's prefix is digested as a stream, so no session is held in memory.
    """
    kept = F.col("turn") <= watermark
    line = F.concat_ws(":", F.col("turn").cast("string"), "role", F.sha2(F.coalesce("text", F.lit("")), 256))
    n = turns.groupBy("conv_id").agg(F.count(F.when(kept, 1)).alias("n_now"), F.count(F.when(~kept, 1)).alias("n_next"))
    found = digests(turns.filter(kept).select("conv_id", "turn", line.alias("line")), "conv_id", ["turn", "line"], "\n").select("conv_id", "digest")
    return n.join(found, "conv_id", "left").select("conv_id", "n_now", "n_next", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("prefix_digest"))


def rewritten(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sessions whose prefix was edited, reordered or shortened since the last snapshot."""
    pair = incremental(before).select("conv_id", "n_now", F.col("prefix_digest").alias("was")).join(incremental(after).select("conv_id", F.col("n_now").alias("n_after"), F.col("prefix_digest").alias("is")), "conv_id", "left")
    verdict = F.when(F.col("n_after").isNull() | (F.col("n_after") < F.col("n_now")), "shortened").when(F.col("was") != F.col("is"), "edited").otherwise("appended")
    return pair.select("conv_id", verdict.alias("verdict"))


_AFTER = "SELECT conv_id, turn, role, CASE WHEN conv_id % 10 = 4 AND turn = 1 THEN 'edited' ELSE text END AS text FROM conversations WHERE NOT (conv_id % 10 = 6 AND turn = 0)"
_CLOSURE = "WITH RECURSIVE gone AS (SELECT node FROM denied UNION SELECT e.dst FROM gone JOIN prov_edges e ON gone.node = e.src)"
_NODES = "(SELECT src AS node FROM prov_edges UNION SELECT dst FROM prov_edges)"
_WITHDRAWN = "SELECT s_suppkey % 97 AS source_id FROM supplier WHERE s_suppkey % 4 = 1 GROUP BY 1"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_SHINGLES = "SELECT DISTINCT {key}, array_to_string(w[k:k+4], ' ') AS shingle FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS k FROM (SELECT {key}, " + _WORDS + " AS w FROM {table}) a WHERE len(w) >= 5) b"
_CHANGED = "SELECT artifact_id, rel_path, digest FROM artifacts"
QUERIES = {
    "purge_closure": (lambda t: closure(t("prov_edges"), t("denied")), f"{_CLOSURE} SELECT node FROM gone"),
    "clean_generation": (lambda t: clean(t("prov_edges"), t("denied")), f"{_CLOSURE} SELECT node FROM {_NODES} n WHERE node NOT IN (SELECT node FROM gone)"),
    "tombstones": (
        lambda t: tombstones(t("prov_edges"), t("denied")),
        f"{_CLOSURE} SELECT n.node, g.node IS NOT NULL AS purged, CASE WHEN g.node IS NOT NULL THEN sha{{'purge:' || CAST(n.node AS STRING)}} END AS receipt FROM {_NODES} n LEFT JOIN gone g ON n.node = g.node",
    ),
    "purge_report": (
        lambda t: purge_report(t("prov_edges"), t("denied")),
        f"{_CLOSURE} SELECT n.node % 10 AS kind, count(*) AS n_nodes, count(*) FILTER (WHERE n.node IN (SELECT node FROM gone)) AS n_purged, count(*) FILTER (WHERE n.node NOT IN (SELECT node FROM gone)) AS n_kept, count(*) FILTER (WHERE n.node IN (SELECT node FROM gone) AND n.node NOT IN (SELECT node FROM gone)) AS n_left FROM {_NODES} n GROUP BY 1",
    ),
    "snapshot_diff": (
        lambda t: diff(t("snapshot_old"), t("snapshot_new")),
        """SELECT item_id, CASE count(DISTINCT side) WHEN 2 THEN CASE WHEN count(DISTINCT digest) = 1 THEN 'same' ELSE 'changed' END ELSE CASE min(side) WHEN 1 THEN 'removed' ELSE 'added' END END AS status
        FROM (SELECT *, 1 AS side FROM snapshot_old UNION ALL SELECT *, 2 FROM snapshot_new) u GROUP BY item_id""",
    ),
    "manifest_differences": (
        lambda t: manifest_equal(t("artifacts").select("artifact_id", "rel_path"), t("artifacts").filter("artifact_id % 9 <> 2").select(F.when(F.col("artifact_id") % 10 == 3, -F.col("artifact_id")).otherwise(F.col("artifact_id")).alias("artifact_id"), "rel_path")),
        """SELECT artifact_id, rel_path, 'missing' AS side FROM artifacts WHERE artifact_id % 9 = 2 OR artifact_id % 10 = 3 UNION ALL SELECT -artifact_id, rel_path, 'extra' FROM artifacts WHERE artifact_id % 9 <> 2 AND artifact_id % 10 = 3""",
    ),
    "version_lineage": (
        lambda t: lineage(t("versions")),
        """WITH RECURSIVE up AS (SELECT version_id, version_id AS root_id, parent_id, 0 AS depth FROM versions UNION ALL SELECT u.version_id, v.version_id, v.parent_id, u.depth + 1 FROM up u JOIN versions v ON u.parent_id = v.version_id)
        SELECT version_id, root_id, depth FROM up WHERE parent_id IS NULL""",
    ),
    "rollback_targets": (
        lambda t: rollback(t("versions")),
        "SELECT v.capability_id, max(v.version_id) AS head_id, (SELECT max(a.version_id) FROM versions a WHERE a.capability_id = v.capability_id AND a.state IN ('exported', 'version-approved') AND EXISTS (SELECT 1 FROM versions b WHERE b.capability_id = a.capability_id AND b.version_id > a.version_id)) AS content_of FROM versions v GROUP BY v.capability_id",
    ),
    "claims_after_removal": (
        lambda t: reevaluated(t("claims"), t("supports"), t.sql(_WITHDRAWN)),
        f"""WITH w AS ({_WITHDRAWN}), s AS (SELECT c.claim_id, c.impact, count(DISTINCT s.source_id) AS n_had, count(DISTINCT CASE WHEN w.source_id IS NULL THEN s.source_id END) AS n_left FROM claims c LEFT JOIN supports s ON c.claim_id = s.claim_id LEFT JOIN w ON s.source_id = w.source_id GROUP BY c.claim_id, c.impact)
        SELECT claim_id, n_had, n_left, CASE WHEN n_left = n_had THEN 'stands' WHEN n_left > 0 THEN 'demoted' WHEN impact = 'high' THEN 'revoked' ELSE 'invalidated' END AS status FROM s""",
    ),
    "provenance_chain_gaps": (
        lambda t: chain_gaps(t("lineitem"), t("orders").filter("o_orderkey % 97 <> 5"), t("customer").filter("c_custkey % 89 <> 6"), t("nation").filter("n_nationkey <> 7"), t("region").filter("r_regionkey <> 3")),
        """WITH g AS (SELECT l.l_orderkey, CASE WHEN l.l_orderkey % 97 = 5 THEN 'order' WHEN o.o_custkey % 89 = 6 THEN 'customer' WHEN c.c_nationkey = 7 THEN 'nation' WHEN n.n_regionkey = 3 THEN 'region' WHEN c.c_acctbal < 0 THEN 'grant' END AS gap
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
        SELECT gap, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM g WHERE gap IS NOT NULL GROUP BY gap""",
    ),
    "provenance_chains": (
        lambda t: chains(t("events").filter("event_id % 10 = 0").select((F.col("event_id") * 100).alias("node")), t("chain_edges"), t("chain_grants")),
        """WITH RECURSIVE w AS (SELECT event_id * 100 AS section, event_id * 100 AS node, 0 AS hop, '' AS last FROM events WHERE event_id % 10 = 0
          UNION SELECT w.section, e.dst, w.hop + 1, e.edge_type FROM w JOIN chain_edges e ON e.src = w.node AND ((w.hop = 0 AND e.edge_type = 'compiled_from') OR (w.hop = 1 AND e.edge_type IN ('confirmed_by', 'decided_by')) OR (w.last = 'confirmed_by' AND e.edge_type = 'supported_by') OR (w.last = 'supported_by' AND e.edge_type = 'ingested_in') OR (w.last = 'ingested_in' AND e.edge_type = 'snapshot_of') OR (w.last = 'snapshot_of' AND e.edge_type = 'granted_by'))),
        g AS (SELECT section, bool_or(last = 'decided_by' OR coalesce(c.active, false)) AS complete, max(CASE last WHEN 'decided_by' THEN 1 ELSE hop END) AS hops, count(DISTINCT CASE WHEN last = 'snapshot_of' THEN w.node END) AS n_snapshots FROM w LEFT JOIN chain_grants c ON last = 'granted_by' AND c.node = w.node GROUP BY section)
        SELECT section, complete, CASE WHEN NOT complete THEN (['compiled_from', 'confirmed_by', 'supported_by', 'ingested_in', 'snapshot_of', 'granted_by', 'inactive'])[hops + 1] END AS gap, n_snapshots FROM g""",
    ),
    "conflict_pairs": (
        lambda t: conflicts(t("claims")),
        "SELECT least(x.claim_id, y.claim_id) AS a, greatest(x.claim_id, y.claim_id) AS b, bool_or((x.impact = 'high' OR y.impact = 'high') AND NOT x.adjudicated) AS blocks FROM claims x JOIN claims y ON x.contradicts = y.claim_id GROUP BY 1, 2",
    ),
    "near_duplicate_items": (
        lambda t: near_duplicates(t("benchmark"), t("documents")),
        f"""WITH m AS ({_SHINGLES.format(key='item_id', table='benchmark')}), d AS ({_SHINGLES.format(key='doc_id', table='documents')}), n AS (SELECT item_id, count(*) AS n_shingles FROM m GROUP BY item_id)
        SELECT m.item_id, d.doc_id, count(*) AS n_shared, n.n_shingles FROM m JOIN d ON m.shingle = d.shingle JOIN n ON n.item_id = m.item_id GROUP BY m.item_id, d.doc_id, n.n_shingles HAVING 2 * count(*) >= n.n_shingles""",
    ),
    "duplicate_clusters": (
        lambda t: clusters(t("documents")),
        f"WITH k AS (SELECT doc_id, array_to_string({_WORDS.format()}, ' ') AS k FROM documents WHERE len({_WORDS.format()}) > 0), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS cluster_id, count(*) OVER (PARTITION BY k) AS n FROM k) SELECT doc_id, cluster_id FROM c WHERE n > 1",
    ),
    "merged_labels": (
        lambda t: synonyms(t("part")),
        """WITH RECURSIVE l AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS word FROM part), j AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM l a JOIN l b ON a.word = b.word AND length(a.word) >= 6),
          r AS (SELECT a, b FROM j UNION SELECT r.a, j.b FROM r JOIN j ON r.b = j.a) SELECT p.p_name, coalesce(min(r.b), p.p_name) AS cluster FROM (SELECT DISTINCT p_name FROM part) p LEFT JOIN r ON r.a = p.p_name GROUP BY p.p_name""",
    ),
    "incremental_sessions": (
        lambda t: incremental(t("conversations")),
        "SELECT conv_id, count(*) FILTER (WHERE turn <= 3) AS n_now, count(*) FILTER (WHERE turn > 3) AS n_next, sha{coalesce(string_agg(turn || ':' || role || ':' || sha{coalesce(text, '')}, chr(10) ORDER BY turn) FILTER (WHERE turn <= 3), '')} AS prefix_digest FROM conversations GROUP BY conv_id".replace("sha{coalesce(string_agg", "sha256(coalesce(string_agg").replace("'')} AS prefix", "'')) AS prefix"),
    ),
    "rewritten_sessions": (
        lambda t: rewritten(t("conversations"), t.sql(_AFTER)),
        """SELECT conv_id, CASE WHEN conv_id % 10 = 6 THEN 'shortened' WHEN conv_id % 10 = 4 AND max(turn) >= 1 THEN 'edited' ELSE 'appended' END AS verdict FROM conversations GROUP BY conv_id""",
    ),
}
