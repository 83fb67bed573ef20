"""Ingestion that is whole or nothing: revisions pinned before and after reading, and the hard ceilings of sources and tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attempts at one read (the first and three more), and the ceilings: of a source, and of all that a task takes.
ATTEMPTS = 4
OF_SOURCE = {"raw_bytes": 67_108_864, "ratio": 10, "depth": 2, "entries": 10_000, "event_bytes": 1_048_576, "wall_seconds": 60, "cpu_seconds": 60, "memory_bytes": 536_870_912, "output_bytes": 67_108_864}
OF_TASK = {"task_raw_bytes": ("raw_bytes", 268_435_456), "staged_files": ("entries", 10_000), "staging_bytes": ("staged_bytes", 536_870_912)}


def pinned(reads: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Every source: what becomes of its reads, the attempt that is taken, and how many stages were discarded before it.

    reads (source_id, attempt, pinned, before, after, digest) hold the revision that was granted and those
    seen before and after a read; attempts count from 1. A read is good if all three agree; one whose revision
    moved while it was read is discarded, and tried again while attempts are left. A source that stands at
    another revision than the pinned one, or says none, is quarantined at once, whatever later reads say, unless
    an earlier one was good. Of repeated attempts none is taken, as it isn't known which one was staged.
    """
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    kind = F.when(F.col("pinned").isNull() | F.col("before").isNull() | F.col("after").isNull(), "unknown").when(~same("before", "after"), "moved").when(~same("before", "pinned"), "other").otherwise("good")
    once = reads.groupBy("source_id", "attempt").agg(F.count("*").alias("n"), F.max(kind).alias("kind"), F.max("digest").alias("digest"))
    once = once.withColumn("kind", F.when(F.col("n") > 1, "repeated").otherwise(F.col("kind")))
    at = lambda *k: F.min(F.when(F.col("kind").isin(*k) & F.col("attempt").between(1, attempts), F.col("attempt")))
    g = once.groupBy("source_id").agg(at("good").alias("good"), at("unknown", "other", "repeated").alias("bad"), F.max("attempt").alias("last"), F.max(~F.coalesce(F.col("attempt").between(1, attempts), F.lit(False))).alias("beyond"), F.min_by("digest", F.struct(F.col("kind") != "good", "attempt")).alias("digest"))
    taken = F.col("good").isNotNull() & (F.col("bad").isNull() | (F.col("good") < F.col("bad")))
    state = F.when(taken, "taken").when(F.col("bad").isNotNull() | F.col("beyond") | (F.col("last") >= attempts), "quarantined").otherwise("retry")
    tried = once.join(g.select("source_id", "good"), "source_id").filter("kind = 'moved' and (good is null or attempt < good)").groupBy("source_id").agg(F.count("*").alias("n"))
    return g.join(tried, "source_id", "left").select("source_id", state.alias("state"), F.when(taken, F.col("good")).alias("attempt"), F.when(taken, F.col("digest")).alias("digest"), F.coalesce("n", F.lit(0)).cast("long").alias("n_discarded"))


def limits(settings: DataFrame) -> DataFrame:
    """Per task the ceilings that hold, and the names of settings that would raise one; a setting may only lower it.

    settings (task_id, name, value); a null or an unknown name sets nothing. Of several settings the lowest holds.
    """
    top = OF_SOURCE | {n: c for n, (_, c) in OF_TASK.items()}
    own = [F.least(F.lit(c).cast("long"), F.min(F.when(F.col("name") == n, F.col("value")))).alias(n) for n, c in top.items()]
    above = reduce(lambda x, n: x.when((F.col("name") == n) & (F.col("value") > top[n]), n), top, F.when(F.lit(False), ""))
    return settings.groupBy("task_id").agg(*own, F.array_join(F.array_sort(F.collect_set(above)), ",").alias("raised"))


def verdicts(usage: DataFrame, settings: DataFrame) -> DataFrame:
    """Every source with the ceilings it breaks, in order of name, and whether anything of it is taken.

    usage (task_id, source_id, place, raw_bytes, unpacked_bytes, depth, entries, event_bytes, wall_seconds,
    cpu_seconds, memory_bytes, output_bytes, staged_bytes). A measurement that is missing counts as broken. A source
    that breaks a ceiling of its own leaves nothing behind and counts for nothing. The others are taken in
    order of place while the task's own ceilings hold; from the first one that would break them none is.
    """
    set_ = limits(settings)
    top = [F.coalesce(f"set_{n}", F.lit(c).cast("long")).alias(f"top_{n}") for n, c in (OF_SOURCE | {n: c for n, (_, c) in OF_TASK.items()}).items()]
    rows = usage.join(set_.select("task_id", *[F.col(n).alias(f"set_{n}") for n in set_.columns if n not in ("task_id", "raised")]), "task_id", "left").select(*[usage[c] for c in usage.columns], *top)
    over = {n: F.col(n) > F.col(f"top_{n}") for n in OF_SOURCE if n != "ratio"} | {"ratio": F.col("unpacked_bytes") > F.col("raw_bytes") * F.col("top_ratio")}
    broken = lambda conditions: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in sorted(conditions.items())]))
    rows = rows.withColumn("own", broken(over))
    clean = F.size("own") == 0
    so_far = Window.partitionBy("task_id").orderBy("place", "source_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"sum_{n}": F.sum(F.when(clean, F.col(c)).otherwise(0)).over(so_far) for n, (c, _) in OF_TASK.items()})
    whole = broken({n: F.col(f"sum_{n}") > F.col(f"top_{n}") for n in OF_TASK})
    names = F.when(clean, whole).otherwise(F.col("own"))
    return rows.select("task_id", "source_id", F.array_join(names, ",").alias("broken"), (F.size(names) == 0).alias("taken"))


def kept(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What is left of rows (with a source_id) of sources: all of those that are taken, and nothing of others."""
    return rows.join(found.filter("taken").select("source_id").distinct(), "source_id", "left_semi")


def _over(bound: str) -> str:
    conditions = {n: f"coalesce(u.{n} > {bound.format(n=n, c=c)}, true)" for n, c in OF_SOURCE.items() if n != "ratio"} | {"ratio": f"coalesce(u.unpacked_bytes > u.raw_bytes * {bound.format(n='ratio', c=10)}, true)"}
    return ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sorted(conditions.items()))


_SET = "least({c}, (SELECT min(value) FROM source_settings x WHERE x.task_id = u.task_id AND x.name = '{n}'))"
QUERIES = {
    "pinned_reads": (
        lambda t: pinned(t("source_reads")),
        """WITH r AS (SELECT source_id, attempt, count(*) AS n, max(CASE WHEN pinned IS NULL OR before IS NULL OR after IS NULL THEN 'unknown' WHEN before <> after THEN 'moved' WHEN before <> pinned THEN 'other' ELSE 'good' END) AS kind, max(digest) AS digest FROM source_reads GROUP BY ALL),
          k AS (SELECT source_id, string_agg(CASE WHEN n > 1 THEN 'b' WHEN kind = 'good' THEN 'g' WHEN kind = 'moved' THEN 'm' ELSE 'b' END, '' ORDER BY attempt) AS s, list(digest ORDER BY attempt) AS d FROM r GROUP BY source_id)
        SELECT source_id, CASE WHEN regexp_matches(s, '^m*g') THEN 'taken' WHEN s LIKE '%b%' OR length(s) >= 4 THEN 'quarantined' ELSE 'retry' END AS state, CASE WHEN regexp_matches(s, '^m*g') THEN CAST(strpos(s, 'g') AS BIGINT) END AS attempt, CASE WHEN regexp_matches(s, '^m*g') THEN d[strpos(s, 'g')] END AS digest,
          CAST(length(replace(replace(CASE WHEN strpos(s, 'g') > 0 THEN substr(s, 1, strpos(s, 'g')) ELSE s END, 'g', ''), 'b', '')) AS BIGINT) AS n_discarded FROM k""",
    ),
    "ceiling_verdicts": (
        lambda t: verdicts(t("source_usage"), t("source_settings")),
        f"""WITH o AS (SELECT u.*, concat_ws(',', {_over(_SET)}) AS own FROM source_usage u), c AS (SELECT * FROM o WHERE own = ''),
          w AS (SELECT a.task_id, a.source_id, sum(b.raw_bytes) AS raw, sum(b.entries) AS files, sum(b.staged_bytes) AS staged FROM c a JOIN c b ON a.task_id = b.task_id AND b.place <= a.place GROUP BY ALL),
          v AS (SELECT u.task_id, u.source_id, CASE WHEN own <> '' THEN own ELSE concat_ws(',', CASE WHEN files > {_SET.format(n='staged_files', c=10_000)} THEN 'staged_files' END, CASE WHEN staged > {_SET.format(n='staging_bytes', c=536_870_912)} THEN 'staging_bytes' END, CASE WHEN raw > {_SET.format(n='task_raw_bytes', c=268_435_456)} THEN 'task_raw_bytes' END) END AS broken
            FROM o u LEFT JOIN w ON w.source_id = u.source_id)
        SELECT *, broken = '' AS taken FROM v""",
    ),
    "task_ceilings": (
        lambda t: limits(t("source_settings")).select("task_id", "raw_bytes", "depth", "task_raw_bytes", "staged_files", "raised"),
        """SELECT task_id, least(67108864, min(value) FILTER (WHERE name = 'raw_bytes')) AS raw_bytes, least(2, min(value) FILTER (WHERE name = 'depth')) AS depth, least(268435456, min(value) FILTER (WHERE name = 'task_raw_bytes')) AS task_raw_bytes, least(10000, min(value) FILTER (WHERE name = 'staged_files')) AS staged_files,
          concat_ws(',', CASE WHEN max(value) FILTER (WHERE name = 'depth') > 2 THEN 'depth' END, CASE WHEN max(value) FILTER (WHERE name = 'raw_bytes') > 67108864 THEN 'raw_bytes' END) AS raised FROM source_settings GROUP BY task_id""",
    ),
}
