"""Operator 13: a trie of conversations' turns, with what shared prefixes save.

``rebuilt`` orders each conversation's turns and puts the first turns of a base conversation in front.
``trie`` deals conversations by the digest of their first turn; the subtries of small first turns go to
hash buckets, and applyInPandas builds a bucket's tries as dictionaries of node numbers. Children get
higher numbers than their parents, so sums over subtrees are one pass from the last node to the first, an
iterative postorder. A first turn with more than LIMIT turns below it is not built in one task: the
turns that all its conversations share are a chain of nodes, counted by Spark, and its conversations are
dealt anew by the digest of the turn after the chain, again and again until every subtrie is small.
What the chains' nodes need from below is then added up level by level. A chain may be as long as it
likes: no round is spent inside it, so the rounds are at most the branchings that more than LIMIT turns
share.

Nodes are told apart by SHA-256 of roles and texts, so texts are read once and never shuffled. Digests
over the members that end at a node are sequential by definition: in small subtries they are made in
place; at chains and at the root, sorted pieces of ids are joined in all tasks, and one task a node runs
over the pieces.

Cases: null role and text are empty; a null turn comes first; turns with the same number are ordered by
digest of role and text; repeated rows are turns of their own; rows with a null conv_id are one
conversation without a base, whose id is an empty string in digests and which is no smallest member
unless it is alone; a base is conv_id minus the remainder of conv_id by FAMILY, of the sign of conv_id,
so negative ids have their base above them; an empty table gives no rows, not even a root; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table
from .mixing import WORD
from .prefix import running

FAMILY, HEAD = 20, 4
#: Turns of a subtrie that one task builds at most, turns of a bucket of subtries on average, ids' bytes of a piece.
LIMIT, BUCKET, PIECE = 2048, 8192, 1 << 16
NONE = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
#: absent and parent_absent stand for a null id, which pandas would make a float of.
BUILT = "key binary, above binary, top boolean, conv_id long, absent boolean, depth long, parent_conv_id long, parent_absent boolean, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt(scratch: Scratch, turns: DataFrame, family: int = FAMILY, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest, words) of every rebuilt turn, (conv_id, n_turns) of every conversation)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = scratch.keep(turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one")))
    own = scratch.keep(running(scratch, slim, ["conv_id"], ["turn", "digest"], "one", "place").select("conv_id", "place", "digest", "words"))
    id_ = F.col("conv_id")
    convs = own.groupBy("conv_id").agg((F.max("place") + 1).alias("n_own")).withColumns({"h": F.when(id_.isNull(), F.lit(0)).otherwise(F.crc32(id_.cast("string").cast("binary")) % head), "base": id_ - id_ % family})
    bases = own.filter((F.col("place") < head - 1) & (id_ % family == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "words")  # head - 1 rows a base
    n_base = bases.groupBy("base").agg(F.count("*").alias("n_base"))
    convs = convs.join(n_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = scratch.keep(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")))
    front = convs.filter("taken > 0").join(bases, "base").filter("place < taken").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")  # family * (head - 1) rows a base
    about = convs.select(id_.alias("of"), "h", "taken")
    back = own.join(about, id_.eqNullSafe(F.col("of"))).filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "words")
    return scratch.keep(front.unionAll(back)), convs.select("conv_id", "n_turns")


def _ids(members: list) -> str:
    return ",".join("" if m is None else str(m) for m in members)


def _build(rows: list[tuple]) -> list[tuple]:
    """Nodes of one subtrie, the top first; rows are (conv_id, depth, digest, words) by conversation and depth."""
    children, above, depth, words, first, count, ends = [], [], [], [], [], [], []
    node, conv, begun = -1, None, False

    def close():
        if begun:
            ends[node].append(conv)

    for conv_id, d, digest, w in rows:
        if not begun or conv_id != conv or d <= depth[node]:
            close()
            node, conv, begun = -1, conv_id, True
        found = (children[node].get(digest) if node >= 0 else 0 if children else None)
        if found is None:
            found = len(children)
            if node >= 0:
                children[node][digest] = found
            for column, x in ((children, {}), (above, node), (depth, d), (words, w), (first, conv_id), (count, 0), (ends, [])):
                column.append(x)
        node = found
        count[node] += 1
        if first[node] is None:
            first[node] = conv_id
    close()
    leaves, saved = [0] * len(children), [0] * len(children)
    for k in range(len(children) - 1, -1, -1):  # children before their parents
        leaves[k] = leaves[k] or 1
        saved[k] += (count[k] - 1) * words[k]
        if above[k] >= 0:
            leaves[above[k]] += leaves[k]
            saved[above[k]] += saved[k]
    return [(first[k], depth[k], first[above[k]] if above[k] >= 0 else None, count[k], len(children[k]), leaves[k], saved[k], hashlib.sha256(_ids(ends[k]).encode()).hexdigest()) for k in range(len(children))]


def _bucket(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    rows = rows.sort_values(["absent", "conv_id", "depth"], ascending=[False, True, True])
    for (key, above), some in rows.groupby(["key", "above"], sort=False):
        ids = [None if gone else x for x, gone in zip(some["conv_id"].tolist(), some["absent"].tolist())]
        for k, (first, depth, over, *rest) in enumerate(_build(list(zip(ids, some["depth"].tolist(), some["digest"].tolist(), some["words"].tolist())))):
            out.append((key, above, k == 0, first or 0, first is None, depth, over or 0, over is None, *rest))
    return pd.DataFrame(out, columns=[c.split()[0] for c in BUILT.split(", ")])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first, piece): consecutive ids of a key, joined."""
    at, ids, size, n = None, [], 0, 0

    def close():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([n], pa.int64()), pa.array([",".join(ids)])], ["key", "place", "piece"])

    for batch in batches:
        for key, place, text in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (key != at or size > PIECE):
                yield close()
                ids, size = [], 0
            if not ids:
                at, n = key, place
            ids.append(text)
            size += len(text) + 1
    if ids:
        yield close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256): pieces of a key in order, joined and digested as they come."""
    at, digest = None, None
    one = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])
    for batch in batches:
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if digest is not None and key == at:
                digest.update(b"," + piece.encode())
                continue
            if digest is not None:
                yield one()
            at, digest = key, hashlib.sha256(piece.encode())
    if digest is not None:
        yield one()


def ends(scratch: Scratch, members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of members (key, conv_id): the digest of each key's ids in order."""
    rows = scratch.keep(members.select("key", "conv_id", F.lit(1).cast("long").alias("one")))
    placed = running(scratch, rows, ["key"], ["conv_id"], "one", "place").select("key", "place", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("text"))
    pieces = placed.repartitionByRange("key", "place").sortWithinPartitions("key", "place").mapInArrow(_pieces, "key binary, place long, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_digests, "key binary, ends_sha256 string")


def _below(nodes: DataFrame, tops: DataFrame | None) -> DataFrame:
    """nodes with what they get from the tops of the subtries below them; null for a leaf."""
    if tops is None:
        return nodes.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")})
    sums = tops.groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return nodes.join(sums, "key", "left")


def trie(scratch: Scratch, turns: DataFrame, convs: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """A row per node of turns (conv_id, depth, digest, words) and convs (conv_id, n_turns)."""
    root, zero, one = F.lit(b""), F.lit(0).cast("long"), F.lit(1).cast("long")
    open_, built, chains = turns.withColumns({"above": root, "from": one}), [], []
    while True:
        # by the digest of the turn at which they part; key is the digest of the way to there
        lead = open_.filter(F.col("depth") == F.col("from")).select(F.col("conv_id").alias("of"), F.unhex(F.sha2(F.concat("above", "digest"), 256)).alias("key"))
        dealt = scratch.keep(open_.join(lead, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "depth", "digest", "words", "above", "key"))
        sizes = scratch.keep(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("depth").alias("start")))
        big = sizes.filter(F.col("n") > limit)
        n_small = sizes.filter(F.col("n") <= limit).agg(F.sum("n")).first()[0] or 0
        buckets = max(1, -(-n_small // bucket))
        if n_small:
            small = dealt.join(big.select("key"), "key", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
            small = small.withColumns({"absent": F.col("conv_id").isNull(), "conv_id": F.coalesce("conv_id", zero)})
            found = small.groupBy("bucket").applyInPandas(_bucket, BUILT)
            built.append(scratch.keep(found.withColumns({"conv_id": F.when(~F.col("absent"), F.col("conv_id")), "parent_conv_id": F.when(~F.col("parent_absent"), F.col("parent_conv_id"))})))
        if big.isEmpty():
            break
        rows = scratch.keep(dealt.join(big.select("key", "start"), "key"))
        at = rows.groupBy("key", "depth").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.min("words").alias("words"), F.min("conv_id").alias("conv_id"), F.first("above").alias("above"), F.first("start").alias("start"))
        at = scratch.keep(at)
        top = at.filter("depth = start").select("key", F.col("n").alias("n_convs"), F.col("conv_id").alias("first"), "above", "start")
        parts = at.select("key", "depth", "n", "low", "high").join(top.select("key", "n_convs"), "key")
        bottom = parts.groupBy("key").agg(F.coalesce(F.min(F.when((F.col("n") < F.col("n_convs")) | (F.col("low") != F.col("high")), F.col("depth") - 1)), F.max("depth")).alias("bottom"))
        chain = scratch.keep(top.join(bottom, "key"))
        links = scratch.keep(at.select("key", "depth", "words").join(chain.select("key", "bottom"), "key").filter("depth <= bottom").select("key", "depth", "words"))
        last = rows.groupBy("conv_id", "key").agg(F.max("depth").alias("n_turns")).join(chain.select("key", "bottom"), "key").filter("n_turns = bottom")
        chains.append((chain, links, scratch.keep(last.select("key", "conv_id"))))
        below = rows.join(chain.select("key", "bottom"), "key").filter("depth > bottom")
        open_ = scratch.keep(below.select("conv_id", "depth", "digest", "words", F.col("key").alias("above"), (F.col("bottom") + 1).alias("from")))
        if open_.isEmpty():
            break
    # from the last level to the first: what chains get from below
    tops = reduce(DataFrame.unionAll, [b.filter("top").select("above", "n_leaves", "saved_tokens") for b in built]) if built else None
    named = []
    for chain, links, last in reversed(chains):
        weight = links.groupBy("key").agg(F.sum("words").alias("words"))
        rows = chain.join(weight, "key")
        rows = _below(rows, tops)
        rows = rows.withColumns({"n_children": F.coalesce("n_children", zero), "n_leaves": F.coalesce("n_leaves", one), "saved_tokens": F.coalesce("saved_tokens", zero) + (F.col("n_convs") - 1) * F.col("words")})
        rows = scratch.keep(rows)
        named.append((rows, links, last))
        more = rows.select("above", "n_leaves", "saved_tokens")
        tops = scratch.keep(more if tops is None else tops.unionAll(more))
    members = convs.filter("n_turns = 0").select(root.alias("key"), "conv_id")
    digests = scratch.keep(ends(scratch, reduce(DataFrame.unionAll, [last for _, _, last in named], members)))
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).withColumn("key", root).filter("n_convs > 0")
    top = _below(top, tops).join(digests, "key", "left")
    top = scratch.keep(top.select("key", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")))
    bottoms = reduce(DataFrame.unionAll, [rows.select(F.col("key").alias("above"), F.col("first").alias("over")) for rows, _, _ in named], top.select(F.col("key").alias("above"), F.col("conv_id").alias("over")))
    bottoms = scratch.keep(bottoms)
    out = [top.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    for b in built:
        linked = b.join(bottoms, "above", "left")
        out.append(linked.withColumn("parent_conv_id", F.when(F.col("top"), F.col("over")).otherwise(F.col("parent_conv_id"))).select(*COLUMNS))
    for rows, links, _ in named:
        steps = running(scratch, links, ["key"], ["depth"], "words", "earlier").drop("words")
        nodes = steps.join(rows, "key").join(bottoms, "above", "left").join(digests, "key", "left")
        low, head = F.col("depth") == F.col("bottom"), F.col("depth") == F.col("start")
        out.append(
            nodes.select(
                F.col("first").alias("conv_id"), "depth", F.when(head, F.col("over")).otherwise(F.col("first")).alias("parent_conv_id"), "n_convs",
                F.when(low, F.col("n_children")).otherwise(one).alias("n_children"), "n_leaves", (F.col("saved_tokens") - (F.col("n_convs") - 1) * F.col("earlier")).alias("saved_tokens"),
                F.when(low, F.coalesce("ends_sha256", F.lit(NONE))).otherwise(F.lit(NONE)).alias("ends_sha256"),
            )
        )
    return reduce(DataFrame.unionAll, out)


def prefixes(conversations: DataFrame, family: int = FAMILY, head: int = HEAD, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    scratch = Scratch(conversations.sparkSession)
    return trie(scratch, *rebuilt(scratch, conversations, family, head), limit, bucket)


def query(spark, sf_dir: str) -> DataFrame:
    return prefixes(table(spark, sf_dir, "conversations"))


ORACLE = r"""
    WITH heads AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations) z),
    o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    h AS (SELECT c.conv_id, c.conv_id - c.conv_id % 20 AS base, k.h, least(k.h, (SELECT count(*) FROM o WHERE o.conv_id = c.conv_id - c.conv_id % 20)) AS taken FROM (SELECT DISTINCT conv_id FROM o) c JOIN heads k ON c.conv_id = k.conv_id),
    r AS (SELECT h.conv_id, o.place + 1 AS depth, o.role, o.text FROM h JOIN o ON o.conv_id = h.base AND o.place < h.taken UNION ALL SELECT h.conv_id, o.place - h.h + h.taken + 1, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id AND o.place >= h.h),
    p AS (SELECT conv_id, depth, array_to_string(list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth), '') AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM h),
    n AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words FROM p GROUP BY path, depth),
    k AS (SELECT left(path, 64 * (depth - 1)) AS above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
    t AS (SELECT p.path, count(*) FILTER (WHERE k.above IS NULL) AS n_leaves, sum((n.n - 1) * n.words) AS saved FROM n LEFT JOIN k ON k.above = n.path JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path),
    e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p WHERE depth = (SELECT max(q.depth) FROM p q WHERE q.conv_id = p.conv_id) GROUP BY path)
    SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN (SELECT a.conv_id FROM n a WHERE a.path = left(n.path, 64 * (n.depth - 1)) AND a.depth = n.depth - 1) END AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM n LEFT JOIN k ON k.above = n.path JOIN t ON t.path = n.path LEFT JOIN e ON e.path = n.path"""
