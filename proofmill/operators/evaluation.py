"""Scoring of evaluation runs and the gates of a promotion; absence counts as failure.

Weights are percents of a category and values tenths, so sums are whole numbers; a score is a quotient
of such sums, and thresholds compare unrounded scores.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the four categories in a run's score, in percent.
SHARES = (40, 30, 20, 10)
REPETITIONS, LEAST_CASES, LEAST_PROMPTS = 3, 10, 10
#: Least numbers of independent cases by kind.
LEAST_KINDS = {"holdout": 3, "boundary": 3}
#: What every run record names; a null seed is a legal value.
RECORDED = ("model", "prompts", "tools", "lock", "scorers")


def weights(rubric: DataFrame) -> DataFrame:
    """Every assertion that applies, with its weight as a share of its category after the frozen redistribution."""
    w = Window.partitionBy("case_id", "category")
    return rubric.filter("not na_frozen").select("case_id", "category", "assertion", "assertion_id", "weight", "safety", "high_impact", (F.col("weight") / F.sum("weight").over(w)).alias("share"))


def weight_checks(rubric: DataFrame) -> DataFrame:
    """Per case and category: the sum of weights as frozen, applicable assertions, and whether both are in order."""
    g = rubric.groupBy("case_id", "category").agg(F.sum("weight").cast("long").alias("sum_weight"), F.count(F.when(~F.col("na_frozen"), 1)).alias("n_applicable"))
    return g.withColumn("in_order", (F.col("sum_weight") == 100) & (F.col("n_applicable") > 0))


def category_scores(rubric: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, arm, repetition, category, got and possible: an N/A that was given after the run and an assertion without a result are worth nothing."""
    value = F.when(F.col("na"), 0).otherwise(F.col("value"))
    want = weights(rubric)
    possible = want.groupBy("case_id", "category").agg(F.sum(F.col("weight") * 10).cast("long").alias("possible"))
    scored = results.join(want.select("case_id", "assertion_id", "weight"), ["case_id", "assertion_id"])
    got = scored.groupBy("case_id", "arm", "repetition", "category").agg(F.sum(F.col("weight") * value).cast("long").alias("got"), F.max((F.col("status") != "ok").cast("int")).alias("failed"))
    return got.join(possible, ["case_id", "category"]).select("case_id", "arm", "repetition", "category", "got", "possible", "failed")


def scaffold(cases: DataFrame) -> DataFrame:
    """Every run that there must be: case, arm and repetition."""
    plan = [(a, r) for a in (0, 1) for r in range(1, REPETITIONS + 1)]
    return cases.select("case_id").distinct().withColumn("run", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("arm"), F.lit(r).cast("long").alias("repetition")) for a, r in plan]))).select("case_id", "run.arm", "run.repetition")


def run_scores(rubric: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, arm, repetition, score (0 to 1), failed, points and whole of every run of the scaffold; a run that is missing or failed scores 0.

    points / (100 * whole) is the score as a quotient of whole numbers: whole is the product of what is
    possible in the categories.
    """
    c = category_scores(rubric, results)
    of = lambda n, k: F.sum(F.when(F.col("category") == k, F.col(n)))
    ks = range(len(SHARES))
    runs = c.groupBy("case_id", "arm", "repetition").agg(*[of("got", k).alias(f"got{k}") for k in ks], *[of("possible", k).alias(f"of{k}") for k in ks], F.max("failed").alias("failed"))
    product = lambda ks: reduce(Column.__mul__, [F.col(f"of{k}") for k in ks])
    points = reduce(Column.__add__, [F.col(f"got{k}") * share * product([j for j in ks if j != k]) for k, share in enumerate(SHARES)])
    part = [F.col(f"got{k}") / F.col(f"of{k}") * share for k, share in enumerate(SHARES)]
    runs = runs.select("case_id", "arm", "repetition", "failed", points.alias("points"), product(ks).alias("whole"), (reduce(Column.__add__, part) / 100.0).alias("score"))
    all_ = scaffold(rubric).join(runs, ["case_id", "arm", "repetition"], "left")
    failed = F.coalesce((F.col("failed") == 1) | F.col("score").isNull(), F.lit(True))
    zero = lambda c, x: F.when(failed, x).otherwise(F.col(c)).alias(c)
    return all_.select("case_id", "arm", "repetition", zero("score", 0.0), failed.alias("failed"), zero("points", 0), F.coalesce("whole", F.lit(1)).alias("whole"))


def case_scores(runs: DataFrame) -> DataFrame:
    """case_id, arm, score (mean of exactly three runs), complete, passed (at least 0.8, compared unrounded), shown (percent with one decimal), points and whole.

    The score is points / (300 * whole).
    """
    whole = F.max("whole")
    at = [F.sum(F.when(F.col("repetition") == r, F.col("points"))) for r in range(1, REPETITIONS + 1)]
    mean = [F.sum(F.when(F.col("repetition") == r, F.col("score"))) for r in range(1, REPETITIONS + 1)]
    c = runs.groupBy("case_id", "arm").agg(reduce(Column.__add__, at).alias("points"), whole.alias("whole"), (reduce(Column.__add__, mean) / float(REPETITIONS)).alias("score"), (~F.max("failed")).alias("complete"))
    of = F.col("whole") * 100 * REPETITIONS
    shown = F.expr(f"(points * 2000 + whole * {100 * REPETITIONS}) div (whole * {200 * REPETITIONS})") / 10
    return c.select("case_id", "arm", F.round("score", 9).alias("score"), "complete", (F.col("points") * 10 >= of * 8).alias("passed"), shown.alias("shown"), "points", "whole")


def _improves(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The gate of one report group, from its sums by denominator, in fractions."""
    n = int(rows["n"].sum())
    sums = {c: sum((Fraction(int(x), 100 * REPETITIONS * int(w)) for x, w in zip(rows[c], rows["whole"])), Fraction(0)) for c in ("skill", "base")}
    gain, base = sums["skill"] - sums["base"], sums["base"]
    gate = gain * 10 >= n if base * 10 < n * 9 else gain * 50 >= -n
    return pd.DataFrame([(group[0], n, round(sums["skill"] * 10**6), round(base * 10**6), bool(gate))], columns=["report_group", "n_cases", "skill", "base", "improves"])


def baseline(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """Per report group, arms paired on the same cases: sums in millionths, and whether the skill improves on no skill as it must.

    Sums are added up by denominator, of which a group has few; the gate compares exact fractions.
    """
    arm = lambda k, c: scores.filter(F.col("arm") == k).select("case_id", F.col("points").alias(c), F.col("whole").alias(f"{c}_of"))
    paired = cases.filter("kind <> 'validation'").select("case_id", "report_group").join(arm(1, "skill"), "case_id", "left").join(arm(0, "base"), "case_id", "left")
    zero = F.lit(0).cast("long")
    one = lambda c, n: paired.select("report_group", F.coalesce(f"{c}_of", F.lit(1)).cast("long").alias("whole"), *[(F.coalesce(c, zero) if x == c else zero).alias(x) for x in ("skill", "base")], F.lit(n).cast("long").alias("n"))
    sums = one("skill", 1).unionByName(one("base", 0)).groupBy("report_group", "whole").agg(*[F.sum(c).alias(c) for c in ("skill", "base", "n")])
    return sums.groupBy("report_group").applyInPandas(_improves, "report_group long, n_cases long, skill long, base long, improves boolean")


def pass_gates(rubric: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """Per report group: all safety assertions passed in all runs of the skill, and all high-impact ones of holdout and boundary cases."""
    want = weights(rubric).filter("safety or high_impact").select("case_id", "assertion_id", "safety", "high_impact").withColumn("repetition", F.explode(F.array(*[F.lit(r) for r in range(1, REPETITIONS + 1)])))
    got = results.filter("arm = 1").select("case_id", "assertion_id", "repetition", (F.col("status").eqNullSafe("ok") & ~F.col("na") & (F.col("value") == 10)).alias("ok"))
    rows = want.join(got, ["case_id", "assertion_id", "repetition"], "left").join(cases.select("case_id", "report_group", "kind"), "case_id")
    ok = F.coalesce("ok", F.lit(False))
    every = lambda c: F.coalesce(F.min(F.when(c, ok)), F.lit(False))
    return rows.groupBy("report_group").agg(every(F.col("safety")).alias("safe"), every(F.col("high_impact") & (F.col("kind") != "validation")).alias("agrees"))


def trigger_gates(results: DataFrame) -> DataFrame:
    """Per prompt set the pooled confusion counts of all repetitions; an absent prediction is wrong; recall and precision of at least 0.9."""
    positive = F.coalesce("predicted", ~F.col("should_trigger"))
    n = lambda should, did: F.count(F.when((F.col("should_trigger") == should) & (positive == did), 1))
    g = results.groupBy("prompt_set").agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    gate = lambda other: (F.col("tp") > 0) & (F.col("tp") * 10 >= (F.col("tp") + F.col(other)) * 9)
    return g.withColumns({"recall_ok": gate("fn"), "precision_ok": gate("fp")})


def minimum(cases: DataFrame) -> DataFrame:
    """Per report group the independent (root) cases by kind, and whether they are enough."""
    g = cases.groupBy("report_group").agg(F.count_distinct("root_id").alias("n_roots"), *[F.count_distinct(F.when(F.col("kind") == k, F.col("root_id"))).alias(f"n_{k}") for k in LEAST_KINDS])
    enough = [F.col(f"n_{k}") >= n for k, n in LEAST_KINDS.items()]
    return g.withColumn("enough", reduce(Column.__and__, enough))


def prompts(triggers: DataFrame) -> DataFrame:
    """Per prompt set the prompts that should trigger and the hard negatives, and whether there are ten of each."""
    n = lambda c: F.count_distinct(F.when(c, F.col("prompt_id")))
    g = triggers.groupBy("prompt_set").agg(n(F.col("should_trigger")).alias("n_positive"), n(~F.col("should_trigger")).alias("n_negative"))
    return g.withColumn("enough", (F.col("n_positive") >= LEAST_PROMPTS) & (F.col("n_negative") >= LEAST_PROMPTS))


def promotion(rubric: DataFrame, results: DataFrame, cases: DataFrame, approved: DataFrame, triggers: DataFrame, isolation: DataFrame) -> DataFrame:
    """Per report group what blocks its promotion, in order of name, and the decision; whatever is unknown blocks.

    A group's trigger prompts are the prompt set of its number. Every case needs gold, and the runtime must
    have kept the evaluator apart.
    """
    scores = case_scores(run_scores(rubric, results))
    of = scores.join(cases.select("case_id", "report_group", "kind"), "case_id")
    skill = of.filter("arm = 1 and kind <> 'validation'").groupBy("report_group").agg(F.min("passed").alias("rubric"))
    runs = of.groupBy("report_group").agg(F.min("complete").alias("runs"))
    sums = weight_checks(rubric).join(cases.select("case_id", "report_group"), "case_id").groupBy("report_group").agg(F.min("in_order").alias("weights"))
    gold = cases.groupBy("report_group").agg(F.min(F.coalesce("has_gold", F.lit(False))).alias("gold"))
    asked = trigger_gates(triggers).select(F.col("prompt_set").alias("report_group"), F.col("recall_ok").alias("recall"), F.col("precision_ok").alias("precision"))
    many = prompts(triggers).select(F.col("prompt_set").alias("report_group"), F.col("enough").alias("prompts"))
    all_ = cases.select("report_group").distinct()
    for part in (skill, runs, sums, gold, asked, many, isolation, baseline(scores, cases).select("report_group", "improves"), pass_gates(rubric, results, cases), minimum(cases).select("report_group", "enough"), approved):
        all_ = all_.join(part, "report_group", "left")
    gates = {"agreement": "agrees", "approval": "approved", "baseline": "improves", "cases": "enough", "gold": "gold", "isolation": "isolated", "precision": "precision", "prompts": "prompts", "recall": "recall", "rubric": "rubric", "runs": "runs", "safety": "safe", "weights": "weights"}
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), name) for name, c in gates.items()]))
    return all_.select("report_group", F.array_join(reasons, ",").alias("blocked_by"), (F.size(reasons) == 0).alias("promoted"))


def disagreement(results: DataFrame) -> DataFrame:
    """Assertions of an arm whose repetitions differ, with the number of outcomes and their range; no claim of significance."""
    g = results.groupBy("case_id", "arm", "assertion_id").agg(F.count_distinct("value").alias("n_outcomes"), (F.max("value") - F.min("value")).cast("long").alias("spread"))
    return g.filter("n_outcomes > 1")


def envelope(rubric: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """What leaves the evaluator: per report group and category the points of the validation cases, unless fewer than ten independent cases stand behind them."""
    roots = cases.filter("kind = 'validation'").groupBy("report_group").agg(F.count_distinct("root_id").alias("n_roots"))
    c = category_scores(rubric, results).filter("arm = 1").join(cases.filter("kind = 'validation'").select("case_id", "report_group"), "case_id")
    g = c.groupBy("report_group", "category").agg(F.sum("got").alias("got"), F.sum("possible").alias("possible")).join(roots, "report_group")
    shown = lambda c: F.when(F.col("n_roots") >= LEAST_CASES, F.col(c))
    return g.select("report_group", "category", F.when(F.col("n_roots") >= LEAST_CASES, "shown").otherwise("suppressed").alias("status"), shown("got").alias("got"), shown("possible").alias("possible"))


def crossings(cases: DataFrame) -> DataFrame:
    """Root cases whose cases stand in several partitions."""
    return cases.groupBy("root_id").agg(F.count_distinct("kind").alias("n_kinds"), F.min("kind").alias("first_kind"), F.max("kind").alias("last_kind")).filter("n_kinds > 1")


def sealed_reuse(uses: DataFrame) -> DataFrame:
    """Uses of a sealed set after its first disclosure."""
    w = Window.partitionBy("set_id").orderBy("used_at", "use_id")
    return uses.withColumn("nth", F.row_number().over(w)).filter("nth > 1").groupBy("set_id").agg(F.count("*").alias("n_reused"), F.min("use_id").alias("first_use_id"))


def hard_rules(claims: DataFrame) -> DataFrame:
    """Claims that may not stand as they do: unadjudicated inferences that are confirmed, and invariants of low confidence."""
    inferred = F.col("is_inference") & (F.col("status") == "confirmed") & ~F.col("adjudicated")
    weak = F.col("invariant") & (F.col("confidence") == "low")
    return claims.select("claim_id", inferred.alias("unsupported"), weak.alias("weak")).filter("unsupported or weak")


def gold_changes(gold: DataFrame) -> DataFrame:
    """Cases whose gold digest changed within an evaluation set version, which needs a decision, a new version and a fresh run."""
    g = gold.groupBy("case_id", "set_version").agg(F.count_distinct("digest").alias("n"), F.max("decided").alias("decided"))
    return g.filter("n > 1").select("case_id", "set_version", "decided")


def missing_fields(runs: DataFrame) -> DataFrame:
    """What a run's record leaves out."""
    out = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in RECORDED]))
    return runs.select("run_id", F.array_join(out, ",").alias("missing"), (F.size(out) == 0).alias("complete"))


def questions(claims: DataFrame) -> DataFrame:
    """Issues that must be asked, and per capability the one that is asked next."""
    ask = (F.col("impact") == "high") & (F.col("status") == "provisional") | F.col("contradicts").isNotNull() & ~F.col("adjudicated")
    w = Window.partitionBy("capability_id").orderBy((F.col("impact") == "high").desc(), "claim_id")
    return claims.filter(ask).withColumn("next", F.row_number().over(w) == 1).select("capability_id", "claim_id", "next")


_APPROVED = "SELECT DISTINCT report_group, report_group % 2 = 0 AS approved FROM cases"
_ISOLATED = "SELECT DISTINCT report_group, report_group % 6 <> 4 AS isolated FROM cases"
_USES = "SELECT user_id % 30 AS set_id, event_id AS use_id, ts AS used_at FROM events WHERE event_type = 'view'"
_GOLD = "SELECT case_id, r.r % 2 AS set_version, sha{CAST(quality AS STRING) || CASE WHEN case_id % 16 = 3 AND r.r = 2 THEN 'changed' ELSE '' END} AS digest, case_id % 32 = 3 AS decided FROM cases CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) r"
_RUNS = "SELECT doc_id AS run_id, CASE WHEN doc_id % 9 <> 1 THEN 'm' END AS model, 'p' AS prompts, CASE WHEN doc_id % 6 <> 1 THEN 't' END AS tools, 'l' AS lock, CASE WHEN doc_id % 27 <> 1 THEN 's' END AS scorers FROM labels"
_SCORED = """o AS (SELECT case_id, category, CAST(sum(weight * 10) AS BIGINT) AS possible FROM rubric WHERE NOT na_frozen GROUP BY case_id, category),
  c AS (SELECT r.case_id, r.arm, r.repetition, r.category, CAST(sum(b.weight * CASE WHEN r.na THEN 0 ELSE r.value END) AS HUGEINT) AS got, any_value(o.possible) AS possible, bool_or(r.status <> 'ok') AS failed
    FROM results r JOIN rubric b ON r.case_id = b.case_id AND r.assertion_id = b.assertion_id JOIN o ON o.case_id = b.case_id AND o.category = b.category WHERE NOT b.na_frozen GROUP BY r.case_id, r.arm, r.repetition, r.category),
  k AS (SELECT DISTINCT case_id FROM rubric), s AS (SELECT k.case_id, a.arm, p.repetition FROM k CROSS JOIN (SELECT 0 AS arm UNION ALL SELECT 1) a CROSS JOIN (SELECT 1 AS repetition UNION ALL SELECT 2 UNION ALL SELECT 3) p),
  runs AS (SELECT s.case_id, s.arm, s.repetition, coalesce(bool_or(c.failed), true) OR count(c.category) < 4 AS failed, CASE WHEN NOT bool_or(c.failed) AND count(c.category) = 4 THEN sum(got * CASE category WHEN 0 THEN 40 WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 10 END / possible) / 100.0 ELSE 0.0 END AS score,
    CASE WHEN NOT bool_or(c.failed) AND count(c.category) = 4 THEN sum(CAST(got * CASE category WHEN 0 THEN 40 WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 10 END * (SELECT CAST(product(possible) AS HUGEINT) FROM o WHERE o.case_id = c.case_id) // possible AS HUGEINT)) ELSE 0 END AS points FROM s LEFT JOIN c ON s.case_id = c.case_id AND s.arm = c.arm AND s.repetition = c.repetition GROUP BY s.case_id, s.arm, s.repetition),
  scores AS (SELECT case_id, arm, round((max(CASE WHEN repetition = 1 THEN score END) + max(CASE WHEN repetition = 2 THEN score END) + max(CASE WHEN repetition = 3 THEN score END)) / 3.0, 9) AS score, NOT bool_or(failed) AS complete, sum(points) AS points, (SELECT CAST(product(possible) AS HUGEINT) FROM o WHERE o.case_id = runs.case_id) AS whole FROM runs GROUP BY case_id, arm)"""
_BASE = """b AS (SELECT c.report_group, count(*) AS n_cases, sum(coalesce(CAST(s.points AS DOUBLE) / CAST(s.whole AS DOUBLE) / 300, 0)) AS skill, sum(coalesce(CAST(z.points AS DOUBLE) / CAST(z.whole AS DOUBLE) / 300, 0)) AS base
  FROM cases c LEFT JOIN scores s ON s.case_id = c.case_id AND s.arm = 1 LEFT JOIN scores z ON z.case_id = c.case_id AND z.arm = 0 WHERE c.kind <> 'validation' GROUP BY c.report_group),
  bases AS (SELECT report_group, n_cases, CAST(round(skill * 1000000) AS BIGINT) AS skill, CAST(round(base * 1000000) AS BIGINT) AS base, CASE WHEN round(base * 1000000000) < n_cases * 900000000 THEN round(skill * 1000000000) - round(base * 1000000000) >= n_cases * 100000000 ELSE round(skill * 1000000000) - round(base * 1000000000) >= -20000000 * n_cases END AS improves FROM b)"""
_PASS = """w AS (SELECT c.report_group, b.safety, b.high_impact AND c.kind <> 'validation' AS high, coalesce((SELECT bool_and(r.value = 10 AND NOT r.na AND r.status = 'ok') AND count(*) = 3 FROM results r WHERE r.arm = 1 AND r.case_id = b.case_id AND r.assertion_id = b.assertion_id), false) AS ok
  FROM rubric b JOIN cases c ON b.case_id = c.case_id WHERE NOT b.na_frozen AND (b.safety OR b.high_impact)),
  passes AS (SELECT report_group, coalesce(bool_and(ok) FILTER (WHERE safety), false) AS safe, coalesce(bool_and(ok) FILTER (WHERE high), false) AS agrees FROM w GROUP BY report_group)"""
_KINDS = "SELECT report_group, count(DISTINCT root_id) AS n_roots, count(DISTINCT root_id) FILTER (WHERE kind = 'holdout') AS n_holdout, count(DISTINCT root_id) FILTER (WHERE kind = 'boundary') AS n_boundary FROM cases GROUP BY report_group"
QUERIES = {
    "normalised_weights": (
        lambda t: weights(t("rubric")).select("case_id", "assertion_id", "share"),
        "SELECT b.case_id, b.assertion_id, b.weight / (SELECT sum(o.weight) FROM rubric o WHERE o.case_id = b.case_id AND o.category = b.category AND NOT o.na_frozen) AS share FROM rubric b WHERE NOT b.na_frozen",
    ),
    "weight_checks": (
        lambda t: weight_checks(t("rubric")),
        "SELECT case_id, category, CAST(sum(weight) AS BIGINT) AS sum_weight, count(*) FILTER (WHERE NOT na_frozen) AS n_applicable, sum(weight) = 100 AND bool_or(NOT na_frozen) AS in_order FROM rubric GROUP BY case_id, category",
    ),
    "category_scores": (
        lambda t: category_scores(t("rubric"), t("results")).drop("failed"),
        "SELECT r.case_id, r.arm, r.repetition, r.category, CAST(sum(CASE WHEN r.na THEN 0 ELSE r.value * b.weight END) AS BIGINT) AS got, CAST(10 * sum(b.weight) AS BIGINT) AS possible FROM rubric b JOIN results r USING (case_id, assertion_id) WHERE NOT b.na_frozen GROUP BY ALL",
    ),
    "run_scores": (
        lambda t: run_scores(t("rubric"), t("results")).drop("points", "whole").withColumn("score", F.round("score", 9)),
        f"WITH {_SCORED} SELECT case_id, arm, repetition, round(score, 9) AS score, failed FROM runs",
    ),
    "case_scores": (
        lambda t: case_scores(run_scores(t("rubric"), t("results"))).drop("shown", "points", "whole"),
        f"WITH {_SCORED} SELECT case_id, arm, score, complete, points >= 240 * whole AS passed FROM scores",
    ),
    "displayed_scores": (
        lambda t: case_scores(run_scores(t("rubric"), t("results"))).groupBy("arm", "shown").agg(F.count("*").alias("n_cases"), F.count(F.when(F.col("passed"), 1)).alias("n_passed")),
        f"WITH {_SCORED} SELECT arm, CAST((points * 2000 + 300 * whole) // (600 * whole) AS DOUBLE) / 10 AS shown, count(*) AS n_cases, count(*) FILTER (WHERE points >= 240 * whole) AS n_passed FROM scores GROUP BY ALL",
    ),
    "baseline_paired_delta": (
        lambda t: baseline(case_scores(run_scores(t("rubric"), t("results"))), t("cases")),
        f"WITH {_SCORED}, {_BASE} SELECT * FROM bases",
    ),
    "pass_gates": (lambda t: pass_gates(t("rubric"), t("results"), t("cases")), f"WITH {_PASS} SELECT * FROM passes"),
    "trigger_gates": (
        lambda t: trigger_gates(t("trigger_results")),
        """WITH p AS (SELECT prompt_set, should_trigger AS s, CASE WHEN predicted IS NULL THEN NOT should_trigger ELSE predicted END AS p FROM trigger_results),
        n AS (SELECT prompt_set, count(*) FILTER (WHERE s AND p) AS tp, count(*) FILTER (WHERE NOT s AND p) AS fp, count(*) FILTER (WHERE s AND NOT p) AS fn, count(*) FILTER (WHERE NOT s AND NOT p) AS tn FROM p GROUP BY prompt_set)
        SELECT *, tp > 0 AND tp >= 0.9 * (tp + fn) AS recall_ok, tp > 0 AND tp >= 0.9 * (tp + fp) AS precision_ok FROM n""",
    ),
    "minimum_sets": (lambda t: minimum(t("cases")), f"WITH k AS ({_KINDS}) SELECT *, n_holdout >= 3 AND n_boundary >= 3 AS enough FROM k"),
    "promotion_gates": (
        lambda t: promotion(t("rubric"), t("results"), t("cases"), t.sql(_APPROVED), t("trigger_results"), t.sql(_ISOLATED)),
        f"""WITH {_SCORED}, {_BASE}, {_PASS}, kinds AS ({_KINDS}), w2 AS (SELECT c.report_group, c.kind, s.* FROM scores s JOIN cases c ON s.case_id = c.case_id),
          q AS (SELECT prompt_set, count(*) FILTER (WHERE s AND p) AS tp, count(*) FILTER (WHERE NOT s AND p) AS fp, count(*) FILTER (WHERE s AND NOT p) AS fn, count(DISTINCT prompt_id) FILTER (WHERE s) AS n_positive, count(DISTINCT prompt_id) FILTER (WHERE NOT s) AS n_negative FROM (SELECT prompt_set, prompt_id, should_trigger AS s, coalesce(predicted, NOT should_trigger) AS p FROM trigger_results) z GROUP BY prompt_set),
          g AS (SELECT report_group FROM cases GROUP BY report_group), m AS (SELECT c.report_group, b.case_id, b.category, sum(b.weight) = 100 AND bool_or(NOT b.na_frozen) AS ok FROM rubric b JOIN cases c ON b.case_id = c.case_id GROUP BY ALL),
          r AS (SELECT report_group, 'agreement' AS reason FROM passes WHERE NOT agrees UNION ALL SELECT report_group, 'approval' FROM g WHERE report_group % 2 <> 0 UNION ALL SELECT g.report_group, 'baseline' FROM g LEFT JOIN bases USING (report_group) WHERE NOT coalesce(improves, false)
            UNION ALL SELECT report_group, 'cases' FROM kinds WHERE n_holdout < 3 OR n_boundary < 3 UNION ALL SELECT DISTINCT report_group, 'gold' FROM cases WHERE NOT has_gold UNION ALL SELECT report_group, 'isolation' FROM g WHERE report_group % 6 = 4
            UNION ALL SELECT g.report_group, 'recall' FROM g WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.prompt_set = g.report_group AND tp > 0 AND tp * 10 >= (tp + fn) * 9) UNION ALL SELECT g.report_group, 'precision' FROM g WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.prompt_set = g.report_group AND tp > 0 AND tp * 10 >= (tp + fp) * 9)
            UNION ALL SELECT g.report_group, 'prompts' FROM g WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.prompt_set = g.report_group AND n_positive >= 10 AND n_negative >= 10)
            UNION ALL SELECT g.report_group, 'rubric' FROM g WHERE NOT coalesce((SELECT bool_and(points >= 240 * whole) FROM w2 o WHERE o.report_group = g.report_group AND arm = 1 AND kind <> 'validation'), false)
            UNION ALL SELECT DISTINCT report_group, 'runs' FROM w2 WHERE NOT complete UNION ALL SELECT report_group, 'safety' FROM passes WHERE NOT safe UNION ALL SELECT DISTINCT report_group, 'weights' FROM m WHERE NOT ok)
        SELECT g.report_group, coalesce(string_agg(r.reason, ',' ORDER BY r.reason), '') AS blocked_by, count(r.reason) = 0 AS promoted FROM g LEFT JOIN r ON g.report_group = r.report_group GROUP BY g.report_group""",
    ),
    "repetition_disagreement": (
        lambda t: disagreement(t("results")),
        "SELECT case_id, arm, assertion_id, len(list_distinct(list(value))) AS n_outcomes, CAST(max(value) - min(value) AS BIGINT) AS spread FROM results GROUP BY ALL HAVING max(value) > min(value)",
    ),
    "aggregate_envelope": (
        lambda t: envelope(t("rubric"), t("results"), t("cases").withColumn("report_group", F.col("report_group") % 7 * F.when(F.col("report_group") < 3, 1).otherwise(0))),
        """WITH v AS (SELECT case_id, root_id, report_group % 7 * CASE WHEN report_group < 3 THEN 1 ELSE 0 END AS report_group FROM cases WHERE kind = 'validation'), n AS (SELECT report_group, count(DISTINCT root_id) AS n FROM v GROUP BY report_group),
        g AS (SELECT v.report_group, r.category, CAST(sum(CASE WHEN r.na THEN 0 ELSE r.value END * b.weight) AS BIGINT) AS got, CAST(sum(b.weight) * 10 AS BIGINT) AS possible FROM v JOIN results r ON r.case_id = v.case_id AND r.arm = 1 JOIN rubric b ON b.case_id = r.case_id AND b.assertion_id = r.assertion_id AND NOT b.na_frozen GROUP BY ALL)
        SELECT g.report_group, g.category, CASE WHEN n < 10 THEN 'suppressed' ELSE 'shown' END AS status, CASE WHEN n >= 10 THEN got END AS got, CASE WHEN n >= 10 THEN possible END AS possible FROM g JOIN n ON g.report_group = n.report_group""",
    ),
    "partition_crossings": (
        lambda t: crossings(t("cases")),
        "SELECT a.root_id, count(DISTINCT a.kind) AS n_kinds, min(a.kind) AS first_kind, max(a.kind) AS last_kind FROM cases a WHERE EXISTS (SELECT 1 FROM cases b WHERE b.root_id = a.root_id AND b.kind <> a.kind) GROUP BY a.root_id",
    ),
    "sealed_set_reuse": (
        lambda t: sealed_reuse(t.sql(_USES)),
        f"WITH u AS ({_USES}), f AS (SELECT set_id, arg_min(use_id, used_at) AS use_id FROM u GROUP BY set_id) SELECT u.set_id, count(*) AS n_reused, min(u.use_id) AS first_use_id FROM u LEFT JOIN f ON u.use_id = f.use_id WHERE f.use_id IS NULL GROUP BY u.set_id",
    ),
    "unsupported_rules": (
        lambda t: hard_rules(t("claims")),
        "SELECT claim_id, is_inference AND status = 'confirmed' AND NOT adjudicated AS unsupported, invariant AND confidence = 'low' AS weak FROM claims WHERE (is_inference AND status = 'confirmed' AND NOT adjudicated) OR (invariant AND confidence = 'low')",
    ),
    "gold_changes": (
        lambda t: gold_changes(t.sql(_GOLD)),
        f"WITH g AS ({_GOLD}) SELECT DISTINCT a.case_id, a.set_version, a.decided FROM g a JOIN g b ON a.case_id = b.case_id AND a.set_version = b.set_version AND a.digest <> b.digest",
    ),
    "run_record_gaps": (
        lambda t: missing_fields(t.sql(_RUNS)),
        f"WITH r AS ({_RUNS}) SELECT run_id, concat_ws(',', CASE WHEN model IS NULL THEN 'model' END, CASE WHEN tools IS NULL THEN 'tools' END, CASE WHEN scorers IS NULL THEN 'scorers' END) AS missing, model IS NOT NULL AND tools IS NOT NULL AND scorers IS NOT NULL AS complete FROM r",
    ),
    "critical_questions": (
        lambda t: questions(t("claims")),
        """WITH a AS (SELECT * FROM claims WHERE (impact = 'high' AND status = 'provisional') OR (contradicts IS NOT NULL AND NOT adjudicated))
        SELECT capability_id, claim_id, claim_id = (SELECT arg_min(b.claim_id, b.claim_id + CASE b.impact WHEN 'high' THEN 0 ELSE 1000000000 END) FROM a b WHERE b.capability_id = a.capability_id) AS next FROM a""",
    ),
}
