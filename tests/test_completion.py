import re

import pytest
from proofmill.operators import completion
from proofmill.plans.relations import Reader

SMALLEST = "/root/testdata/sf0.001"

GOOD = {
    "modes": {"mode": "discover"},
    "selectors": {"search_granted": True, "retain_granted": True, "metadata_only": True, "cursor": "budget", "user_named": False, "content_granted": True, "attested": True, "principal_ok": True, "revision": "r", "snapshot": "excluded"},
    "candidates": {"trigger": "t", "outcome": "o", "scenario": "s", "total": 12, "n_links": 1},
    "fields": {"value": "v", "unsupported": False},
    "claims": {"n_derivations": 1, "impact": "high", "status": "provisional", "adjudicated": True, "invariant": True, "confidence": "medium"},
    "drafts": {"schema_errors": 0, "chain_gaps": 0, "sensitive_findings": 0, "executables": 0},
    "evaluations": {"isolated": True, "repetitions": 3, "contaminated": False, "gates_met": True},
    "approvals": {"subject": "a", "approved_subject": "a"},
    "consents": {f"{p}{c}": "x" for c in ("destination", "manifest", "policy", "subject") for p in ("", "consented_")} | {"digest": "d", "found_digest": "d"},
}
MAPPED = {"MAP", "CAPABILITY_REVIEW"}
#: A change of one table, and the states whose predicate then fails.
CASES = [
    ("modes", {}, set()), ("modes", {"mode": "other"}, {"SOURCE_REVIEW"}), ("modes", {"mode": "update"}, {"SOURCE_REVIEW"}), *[("selectors", {c: v}, {"SOURCE_REVIEW"}) for c in ("search_granted", "retain_granted", "metadata_only") for v in (False, None)], ("selectors", {"cursor": "open"}, {"SOURCE_REVIEW"}), ("selectors", {"cursor": "exhausted"}, set()), ("selectors", {"cursor": None}, {"SOURCE_REVIEW"}),
    *[("selectors", {c: v}, {"INGEST"}) for c in ("content_granted", "attested", "principal_ok") for v in (False, None)], ("selectors", {"revision": ""}, {"INGEST"}), ("selectors", {"snapshot": "stale"}, MAPPED), ("selectors", {"snapshot": None}, MAPPED),
    *[("candidates", {c: v}, MAPPED) for c in ("trigger", "outcome", "scenario") for v in ("", None)], ("candidates", {"total": 13}, MAPPED), ("candidates", {"n_links": 0}, MAPPED), ("fields", {"value": None}, {"EXTRACT"}), ("fields", {"value": None, "unsupported": True}, set()), ("fields", {"unsupported": True}, {"EXTRACT"}),
    ("claims", {"n_derivations": 0}, {"EXTRACT"}), ("claims", {"adjudicated": False}, {"COMPILE"}), ("claims", {"adjudicated": None}, {"COMPILE"}), ("claims", {"adjudicated": False, "impact": "other"}, set()), ("claims", {"adjudicated": False, "status": "confirmed"}, set()), ("claims", {"confidence": "low"}, {"COMPILE"}), ("claims", {"confidence": "low", "invariant": False}, set()),
    *[("drafts", {c: v}, {"COMPILE"}) for c in GOOD["drafts"] for v in (1, None)], ("evaluations", {"repetitions": 2}, {"VERSION_REVIEW"}), ("evaluations", {"repetitions": 4}, {"VERSION_REVIEW"}), ("evaluations", {"isolated": False}, {"VERSION_REVIEW"}), ("evaluations", {"contaminated": True}, {"VERSION_REVIEW"}), ("evaluations", {"contaminated": None}, {"VERSION_REVIEW"}), ("evaluations", {"gates_met": None}, {"VERSION_REVIEW"}),
    ("approvals", {"approved_subject": "b"}, {"EXPORT_REVIEW"}), ("approvals", {"approved_subject": None}, {"EXPORT_REVIEW"}), *[("consents", {c: v}, {"DONE"}) for c in GOOD["consents"] if c != "subject" for v in ("other", None)],
    ("selectors", None, {"SOURCE_REVIEW", "INGEST"} | MAPPED), ("candidates", None, MAPPED), ("fields", None, {"EXTRACT"}), ("claims", None, {"EXTRACT", "COMPILE"}), ("drafts", None, {"COMPILE"}), ("consents", None, {"DONE"}), ("modes", None, {"SOURCE_REVIEW"}),
]
TYPES = {bool: "boolean", int: "long", str: "string"}


@pytest.fixture(scope="module")
def found(spark):
    tables = []
    for name, columns in GOOD.items():
        rows = [(k, *(columns | (m if t == name else {})).values()) for k, (t, m, _) in enumerate(CASES) if t != name or m is not None]
        tables.append(spark.createDataFrame(rows, "task_id long, " + ", ".join(f"{c} {TYPES[type(v)]}" for c, v in columns.items())))
    return completion.predicates(*tables).cache()


def test_each_predicate_one_change_at_a_time(found):
    held = {(r.task_id, r.state) for r in found.collect() if r.holds}
    assert {k: {s for s in completion.STATES if (k, s) not in held} for k in range(len(CASES))} == {k: bad for k, (_, _, bad) in enumerate(CASES)}


def test_states_that_were_reached_too_early(spark, found):
    log = spark.createDataFrame([(0, 1, "DONE"), (0, 2, "SCOUT"), (1, 1, "SOURCE_REVIEW"), (999, 1, "MAP")], "task_id long, seq long, to_phase string")
    assert {(r.task_id, r.seq, r.state, r.n_failed) for r in completion.unmet(log, found).collect()} == {(1, 1, "SOURCE_REVIEW", 1), (999, 1, "MAP", None)}


def test_steps_are_numbered_once_and_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(completion, "STEPS", 100)
    plan = completion.QUERIES["state_predicates"][0](Reader(spark, SMALLEST))._jdf.queryExecution()
    assert "Window" not in str(plan.optimizedPlan())
    dealt = re.findall(r"Exchange hashpartitioning\(task_id#\d+L, (\d+)\), REPARTITION_BY_NUM", str(plan.executedPlan()))
    assert set(dealt) == {"10"} and str(plan.executedPlan()).count("Exchange hashpartitioning") == len(dealt)


def test_unmet_completions_number_steps_once(spark, monkeypatch):
    monkeypatch.setattr(completion, "STEPS", 100)
    plan = completion.QUERIES["unmet_completions"][0](Reader(spark, SMALLEST))._jdf.queryExecution()
    assert "Window" not in str(plan.optimizedPlan())
    assert set(re.findall(r", (\d+)\), REPARTITION_BY_NUM", str(plan.executedPlan()))) == {"10"}


def test_unmet_completions_meet_where_steps_were_dealt(spark, monkeypatch):
    """Records and predicates are not dealt again, to a number of parts that does not grow with the steps."""
    monkeypatch.setattr(completion, "STEPS", 100)
    plan = str(completion.QUERIES["unmet_completions"][0](Reader(spark, SMALLEST))._jdf.queryExecution().executedPlan())
    dealt = re.findall(r"Exchange hashpartitioning\(task_id#\d+L, 10\), REPARTITION_BY_NUM", plan)
    assert dealt and plan.count("Exchange hashpartitioning(task_id") == len(dealt)
