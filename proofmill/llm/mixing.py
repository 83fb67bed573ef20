"""Operator 12: a mix of sources to target weights.

Sources stand in order of code points, null last, and weigh WEIGHTS in turn. A budget of words, all that
there are unless another is given, is shared by weight; no source gets more than MOST times its words,
and what is over is shared again by weight among the others, until none is above. Shares are compared
as whole numbers.

Inside a source, documents are range-sorted by a hash-random key of doc_id; prefix sums of their sizes,
added up task by task, say where each document starts. A source's budget of words is its target without
the fraction: as many whole epochs as fit, then one more that is cut exactly where the budget ends,
inside a document if need be. So every source takes its target to within one word, and no document is
taken more than MOST times.

Cases: a null text has no words, is taken 0 times and is returned; a null source is a source of its own,
the last; a null doc_id is a value like others; rows alike in doc_id, source and size are
interchangeable, each gets its own place; with no word at all every target is 0; an empty table gives
no rows; extra columns are not read, unless they are to be carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table
from .prefix import running

WEIGHTS, MOST = (1, 2, 3), 3
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def levels(scratch: Scratch, sizes: DataFrame, budget: int | None, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size and target of every source of sizes (source, size)."""
    found = scratch.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")))
    ranked = running(scratch, found, [], [F.col("source").asc_nulls_last()], "one", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = scratch.keep(ranked.select("source", "source_size", (F.col("source_size") * most).alias("cap"), weight.alias("weight")))
    total, heavy = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weight = (total or 0) if budget is None else budget, heavy or 0
    full, rest, n = 0, all_weight, 0
    while True:  # sources only join those at their cap, so this ends
        capped = F.expr(f"CAST(cap AS DECIMAL(19,0)) * CAST({rest} AS DECIMAL(19,0)) <= CAST(weight AS DECIMAL(19,0)) * CAST({total - full} AS DECIMAL(19,0))")
        more, caps, gone = ranked.filter(capped).agg(F.count("*"), F.sum("cap"), F.sum("weight")).first()
        if more == n:
            break
        n, full, rest = more, caps, all_weight - gone
        if not rest:
            capped = F.lit(True)
            break
    share = (F.col("weight") * (total - full)).cast("double") / max(rest, 1)
    return ranked.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, budget: int | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, starts_at and taken of every row, and the columns to carry.

    starts_at is where the document starts in its source's order; taken is how many of its words the mix
    takes, repeats counted.
    """
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    taken = [F.col(c).alias(f"carry{k}_") for k, c in enumerate(carry)]
    slim = scratch.keep(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *taken))
    placed = running(scratch, slim, ["source"], ["key", "doc_id", "size"], "size", "starts_at")
    level = levels(scratch, slim, budget, weights, most).withColumnRenamed("source", "of_source")
    rows = placed.join(level, F.col("source").eqNullSafe(F.col("of_source")))
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs).withColumn("left", words - F.col("epochs") * F.col("source_size"))
    part = F.least("size", F.greatest(F.lit(0), F.col("left") - F.col("starts_at")))
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size") + part)
    return rows.select("doc_id", "source", "size", "source_size", "target", "starts_at", "taken", *(F.col(f"carry{k}_").alias(c) for k, c in enumerate(carry)))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, epoch and text of the mix: whole texts, and the first words of one that is cut."""
    rows = mix(docs, carry=("text",), **options).filter("taken > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.expr("CAST(ceil(taken / size) AS INT)"))))
    left = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    bare = F.regexp_replace("text", f"^{BLANK}", "")
    cut = F.array_join(F.slice(F.split(bare, BLANK), F.lit(1), F.least(left, F.col("size")).cast("int")), " ")
    return rows.select("doc_id", "source", "epoch", F.when(left >= F.col("size"), F.col("text")).otherwise(cut).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "starts_at")


ORACLE = r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
    t AS (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM s),
    c AS (SELECT a.*, a.cap * (SELECT sum(b.weight) FROM s b WHERE b.cap * a.weight >= a.cap * b.weight) <= a.weight * (t.total - coalesce((SELECT sum(b.cap) FROM s b WHERE b.cap * a.weight < a.cap * b.weight), 0)) AS full FROM s a, t),
    r AS (SELECT t.total - coalesce(sum(c.cap) FILTER (WHERE c.full), 0) AS words, sum(c.weight) FILTER (WHERE NOT c.full) AS weight FROM c, t GROUP BY t.total),
    l AS (SELECT source, source_size, CASE WHEN c.full THEN CAST(c.cap AS DOUBLE) ELSE CAST(c.weight * r.words AS DOUBLE) / CAST(r.weight AS DOUBLE) END AS target FROM c, r),
    p AS (SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at FROM d),
    e AS (SELECT p.*, l.source_size, l.target, CASE WHEN l.source_size > 0 THEN CAST(floor(l.target) AS BIGINT) // l.source_size ELSE 0 END AS epochs FROM p JOIN l ON p.source IS NOT DISTINCT FROM l.source)
    SELECT doc_id, size, source_size, target, epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - starts_at)) AS taken, starts_at FROM e"""
