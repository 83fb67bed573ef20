"""Each gate one step below and at its threshold, and the cases that must be refused."""

import datetime as dt

import pytest
from proofmill.operators import artifacts, evaluation, evidence, grants, lineage, policies, sessions
from proofmill.plans import durable, states

T = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)
GRANT = "grant_id long, principal long, tenant long, grant_type string, operation string, selector long, revision long, purpose string, issued_at timestamp_ntz, shorter_until timestamp_ntz, task_done_at timestamp_ntz, revoked_at timestamp_ntz, derived_processing_until timestamp_ntz, range_from timestamp_ntz, range_to timestamp_ntz"
ASK = "request_id long, principal long, tenant long, operation string, selector long, revision long, purpose string, at timestamp_ntz, resource_at timestamp_ntz"


def test_grants(spark):
    grant = (1, 1, 1, "content", "read", 5, 1, "distill", T, None, None, None, T + 72 * H, T - H, T)
    ask = (0, 1, 1, "read", 5, 1, "distill", T + H, T - H)
    other = lambda k, v: (*ask[:k], v, *ask[k + 1 :])
    asks = [ask, other(1, 2), other(2, 2), other(3, "list"), other(4, 6), other(5, 2), other(6, "resale"), other(7, T - H), other(7, T + 24 * H), other(7, T + 73 * H), other(8, T - H - H / 60), other(8, T), other(8, T - H / 60), other(7, T + 72 * H)]
    asks = [(k, *a[1:]) for k, a in enumerate(asks)]
    got = {r.request_id: (r.read_ok, r.reuse_ok) for r in grants.decisions(spark.createDataFrame(asks, ASK), spark.createDataFrame([grant], GRANT)).collect()}
    assert got == {0: (True, True)} | {k: (False, False) for k in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 13)} | {8: (False, True), 12: (True, True)}
    short = [(*grant[:9], T + H, None, None, *grant[12:]), (*grant[:9], None, T + H, None, *grant[12:]), (*grant[:9], None, None, T + H, *grant[12:]), (*grant[:3], "metadata", *grant[4:])]
    for g in short:
        assert not grants.decisions(spark.createDataFrame([ask], ASK), spark.createDataFrame([g], GRANT)).first().read_ok


ATTEST = "attestation_id long, selector long, issuer string, policy_version int, verified_at timestamp_ntz, expires_at timestamp_ntz, revoked boolean, superseded boolean, in_scope boolean, forbids boolean"


@pytest.mark.parametrize("change, allowed", [({}, True), ({2: "self"}, False), ({3: 1}, False), ({4: T - 25 * H}, False), ({4: T - 24 * H}, True), ({4: T + H}, False), ({5: T}, False), ({6: True}, False), ({7: True}, False), ({8: False}, False), ({9: True}, False), ({1: 8}, False)])
def test_attestations(spark, change, allowed):
    row = [1, 7, "resolver", 2, T - H, T + H, False, False, True, False]
    for k, v in change.items():
        row[k] = v
    ops = spark.createDataFrame([(1, 7, T)], "operation_id long, selector long, at timestamp_ntz")
    assert grants.attested(ops, spark.createDataFrame([tuple(row)], ATTEST)).first().allowed is allowed


def test_a_prohibition_wins_over_a_later_permission(spark):
    rows = [(1, 7, "resolver", 2, T - 2 * H, T + H, False, False, True, True), (2, 7, "resolver", 2, T - H, T + H, False, False, True, False)]
    ops = spark.createDataFrame([(1, 7, T)], "operation_id long, selector long, at timestamp_ntz")
    assert not grants.attested(ops, spark.createDataFrame(rows, ATTEST)).first().allowed


def test_an_old_prohibition_holds_until_it_expires(spark):
    rows = [(1, 7, "resolver", 2, T - 60 * H, T + H, False, False, True, True), (2, 7, "resolver", 2, T - H, T + 9 * H, False, False, True, False)]
    ops = spark.createDataFrame([(1, 7, T), (2, 7, T + H)], "operation_id long, selector long, at timestamp_ntz")
    assert {r.operation_id: r.allowed for r in grants.attested(ops, spark.createDataFrame(rows, ATTEST)).collect()} == {1: False, 2: True}


def test_the_greater_of_two_attestations_of_one_instant(spark):
    rows = [(k, 7, "resolver", 2, T - H, T + k * H, False, False, True, False) for k in (3, 1, 2)]
    ops = spark.createDataFrame([(1, 7, T)], "operation_id long, selector long, at timestamp_ntz")
    assert grants.attested(ops, spark.createDataFrame(rows, ATTEST)).first().attestation_id == 3


CASES = "case_id long, root_id long, kind string, report_group long, has_gold boolean"


def evaluation_set(spark, skill=10, base=5, drop=None, change=None, gold=True, missed=0, false=0, negatives=10, isolated=True):
    cases = [(k, k, "holdout" if k % 2 else "boundary", 1, gold) for k in range(6)]
    rubric = [(k, c, j, c * 10 + j, w, False, j == 1 and c == 1, j == 1) for k in range(6) for c in range(4) for j, w in ((1, 60), (2, 40))]
    results = [[k, c, j, c * 10 + j, arm, r, skill if arm else base, False, "ok"] for k in range(6) for c in range(4) for j in (1, 2) for arm in (0, 1) for r in (1, 2, 3)]
    if change:
        at, v = change
        results[10][at] = v
    if drop is not None:
        results = [r for r in results if not drop(r)]
    frames = (spark.createDataFrame(rubric, "case_id long, category long, assertion long, assertion_id long, weight long, na_frozen boolean, safety boolean, high_impact boolean"),
              spark.createDataFrame([tuple(r) for r in results], "case_id long, category long, assertion long, assertion_id long, arm long, repetition long, value long, na boolean, status string"), spark.createDataFrame(cases, CASES))
    asked = [(1, k, k < 10, (k < 10) != (k < missed or 10 <= k < 10 + false)) for k in range(10 + negatives)]
    triggers = spark.createDataFrame(asked, "prompt_set long, prompt_id long, should_trigger boolean, predicted boolean")
    return evaluation.promotion(*frames, spark.createDataFrame([(1, True)], "report_group long, approved boolean"), triggers, spark.createDataFrame([(1, isolated)], "report_group long, isolated boolean")).first()


def test_promotion(spark):
    assert evaluation_set(spark).promoted
    assert evaluation_set(spark, skill=9).blocked_by == "agreement,safety"
    assert evaluation_set(spark, base=9).promoted  # ninety percent: two points below are enough
    assert evaluation_set(spark, drop=lambda r: r[0] == 2 and r[4] == 0 and r[5] == 3).blocked_by == "runs"
    assert "runs" in evaluation_set(spark, drop=lambda r: r[0] == 2 and r[4] == 1 and r[5] == 3).blocked_by
    assert "runs" in evaluation_set(spark, change=(8, "timeout")).blocked_by
    assert evaluation_set(spark, gold=None).blocked_by == "gold" and evaluation_set(spark, isolated=False).blocked_by == "isolation"
    assert evaluation_set(spark, missed=1, false=1).promoted  # nine of ten are enough
    assert evaluation_set(spark, missed=2).blocked_by == "recall" and evaluation_set(spark, false=2).blocked_by == "precision"
    assert evaluation_set(spark, negatives=9).blocked_by == "prompts"


@pytest.mark.parametrize("points, passed", [(240 * 10**12, True), (240 * 10**12 - 1, False)])
def test_threshold_of_a_case(spark, points, passed):
    """One part in 10**14 below the threshold is below it."""
    runs = spark.createDataFrame([(1, 1, r, 0.8, False, points // 3 + (r <= points % 3), 10**12) for r in (1, 2, 3)], "case_id long, arm long, repetition long, score double, failed boolean, points long, whole long")
    got = evaluation.case_scores(runs).first()
    assert got.passed is passed and got.shown == 80.0


@pytest.mark.parametrize("points, improves", [(-370, True), (-371, False)])
def test_threshold_of_the_improvement(spark, points, improves):
    """A third, a seventh and what makes their sum a tenth of three cases exactly; a double would not meet it."""
    scores = [(1, 1, 300, 3), (1, 0, 0, 1), (2, 1, 300, 7), (2, 0, 0, 1), (3, 1, points, 7), (3, 0, 0, 1)]
    cases = spark.createDataFrame([(k, k, "holdout", 1, True) for k in (1, 2, 3)], CASES)
    assert evaluation.baseline(spark.createDataFrame(scores, "case_id long, arm long, points long, whole long"), cases).first().improves is improves


def test_purges(spark):
    order = {1: "PREPARE RECEIPT RESULT", 2: "RESULT RECEIPT PREPARE", 3: "PREPARE RESULT RECEIPT", 4: "PREPARE RECEIPT", 5: "RECEIPT RESULT", 6: "RECEIPT PREPARE RESULT"}
    rows = [(k, r, at, 2) for k, v in order.items() for at, r in enumerate(v.split())] + [(7, r, at, 1) for at, r in enumerate(order[1].split())]
    got = {r.purge_id: r.state for r in policies.purges(spark.createDataFrame(rows, "purge_id long, record string, seq long, epoch long"), 2).collect()}
    assert got == {1: "done", 2: "refuse", 3: "refuse", 4: "resume", 5: "refuse", 6: "refuse", 7: "redo"}


FILE = "artifact_id long, generation long, rel_path string, mime string, magic string, mode_bits int, link_count int"


@pytest.mark.parametrize("paths, wrong", [
    (("references/straße.md", "references/STRASSE.md"), "case_collision"), (("references/a.yml",), ""), (("assets/a.jpeg",), ""), (("assets/a.webp",), ""), (("assets/b.webp",), "magic"),
    (("references/a.png",), "folder"), (("assets/a.md",), "folder"), (("SKILL.md",), ""), (("notes.md",), "folder"),
])
def test_artifacts(spark, paths, wrong):
    mime = {"md": "text/markdown", "yml": "application/yaml", "jpeg": "image/jpeg", "webp": "image/webp", "png": "image/png"}
    magic = {"assets/a.jpeg": "FFD8FFE0", "assets/a.webp": "524946461234567857454250", "assets/b.webp": "524946461234567857415645", "references/a.png": "89504E470D0A1A0A"}
    rows = [(k, 1, p, mime[p.rsplit(".", 1)[1]], magic.get(p, "00"), 420, 1) for k, p in enumerate(paths)]
    assert {r.violations for r in artifacts.violations(spark.createDataFrame(rows, FILE)).collect()} == {wrong}


def test_words_of_any_script(spark):
    texts = [None, "", "-- !!", "123 45", "123, 45", "привет мир", "Привет, мир!", "你好 世界", "hello", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.cluster_id) for r in lineage.clusters(docs).collect()) == [(3, 3), (4, 3), (5, 5), (6, 5)]
    long = spark.createDataFrame([(1, "один два три четыре пять шесть"), (2, "one two")], "item_id long, text string")
    both = spark.createDataFrame([(7, "ноль один два три четыре пять шесть"), (8, "один два")], "doc_id long, text string")
    assert [(r.item_id, r.doc_id, r.n_shared) for r in lineage.near_duplicates(long, both).collect()] == [(1, 7, 2)]
    assert evidence.copies(docs).isEmpty()


@pytest.mark.parametrize("wrong, absent, recall", [(1, 0, True), (2, 0, False), (1, 1, False)])
def test_trigger_recall(spark, wrong, absent, recall):
    rows = [(0, True, k >= wrong) for k in range(10 - absent)] + [(0, True, None)] * absent + [(0, False, False)] * 10
    got = evaluation.trigger_gates(spark.createDataFrame(rows, "prompt_set long, should_trigger boolean, predicted boolean")).first()
    assert got.recall_ok is recall and got.precision_ok


def test_cycles_and_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6), (7, 8)], "src long, dst long")
    assert {r.event_id: r.level for r in sessions.levels(edges).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None, 7: 0, 8: 1}


def test_closure_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], "src long, dst long")
    assert sorted(r.node for r in lineage.closure(edges, spark.createDataFrame([(2,)], "node long")).collect()) == [1, 2, 3, 4]
    chain = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 500 + k) for k in range(50)], "a long, b long")
    assert {r.root for r in durable.smallest_reachable(chain).collect()} == {0, 500}


LOG = "task_id long, seq long, event_id long, ts timestamp_ntz, from_phase string, event string, to_phase string, fencing_epoch long, run_epoch long, earliest_phase string"


def test_log(spark):
    ok = [(1, 0, 0, T, "INIT", "start_distill", "SOURCE_REVIEW", 1, 1, None), (1, 1, 1, T, "SOURCE_REVIEW", "pause", "SUSPENDED", 1, 1, None), (1, 2, 2, T, "SUSPENDED", "resume", "SOURCE_REVIEW", 2, 1, None), (1, 3, 3, T, "SOURCE_REVIEW", "all_rejected", "DONE_PARTIAL", 2, 1, None)]
    log = spark.createDataFrame(ok, LOG)
    assert states.illegal(log).isEmpty() and states.breaks(log).isEmpty() and states.resumed(log).first().restored and states.replay(log).first().kind == "terminal"
    bad = spark.createDataFrame([*ok, (1, 4, 4, T, "DONE_PARTIAL", "pause", "SUSPENDED", 1, 1, None)], LOG)
    assert states.illegal(bad).count() == 1 and states.breaks(bad).first().fenced


def test_consents(spark):
    rows = [(1, 7, T + 2 * H, T, 0, "claim"), (2, 7, T, T, 0, "claim"), (2, 8, T + H / 2, T, 1, "claim"), (2, 7, T + 3 * H, T, 2, "claim"), (2, 8, T + 4 * H, T, 3, "consume"), (2, 7, T + 4 * H, T, 4, "consume"), (2, 7, T + 5 * H, T, 5, "claim"), (3, 7, T, T, 0, "consume")]
    got = {(r.consent_id, r.attempt): r.status for r in states.claims(spark.createDataFrame(rows, "consent_id long, txn long, at timestamp_ntz, issued_at timestamp_ntz, attempt long, action string")).collect()}
    assert got == {(1, 0): "expired", (2, 0): "claimed", (2, 1): "refused", (2, 2): "recovers", (2, 3): "refused", (2, 4): "consumed", (2, 5): "refused", (3, 0): "refused"}


def record(seq, before, event, to, **more):
    return (1, seq, seq, T + (more.get("at") or 0) * dt.timedelta(days=1), before, event, to, more.get("earliest"), more.get("fence", 1), more.get("epoch", 1))


FULL_LOG = "task_id long, seq long, event_id long, ts timestamp_ntz, from_phase string, event string, to_phase string, earliest_phase string, fencing_epoch long, run_epoch long"


@pytest.mark.parametrize("first, second, legal", [
    (("COMPILE", "pause", "SUSPENDED"), ("SUSPENDED", "resume", "COMPILE"), True),
    (("COMPILE", "pause", "SUSPENDED"), ("SUSPENDED", "resume", "DONE"), False),
    (("COMPILE", "pause", "SUSPENDED"), ("SUSPENDED", "pause", "SUSPENDED"), False),
    (("COMPILE", "pause", "SUSPENDED"), ("SUSPENDED", "exhaust", "SUSPENDED_EXHAUSTED"), False),
    (("COMPILE", "pause", "SUSPENDED"), ("SUSPENDED", "cancel", "CANCELLED"), True),
    (("COMPILE", "authority_lost", "AUTH_STALE"), ("AUTH_STALE", "authority_renewed", "EXTRACT"), True),
    (("COMPILE", "authority_lost", "AUTH_STALE"), ("AUTH_STALE", "authority_renewed", "COMPILE"), False),
    (("COMPILE", "authority_lost", "AUTH_STALE"), ("AUTH_STALE", "authority_renewed", "INIT"), False),
    (("EVALUATE", "passed", "VERSION_REVIEW"), ("VERSION_REVIEW", "version_rejected", "CANCELLED"), True),
])
def test_returns(spark, first, second, legal):
    log = spark.createDataFrame([record(0, *first), record(1, *second, earliest="EXTRACT", epoch=2)], FULL_LOG)
    assert states.illegal(log).isEmpty() is legal


@pytest.mark.parametrize("epoch, old", [(1, True), (2, False)])
def test_a_new_epoch_on_re_entry(spark, epoch, old):
    log = spark.createDataFrame([record(0, "COMPILE", "authority_lost", "AUTH_STALE"), record(1, "AUTH_STALE", "authority_renewed", "EXTRACT", earliest="EXTRACT", epoch=epoch)], FULL_LOG)
    assert (not states.breaks(log).filter("old_epoch").isEmpty()) is old


def test_a_suspension_costs_no_time(spark):
    log = spark.createDataFrame([record(0, "INIT", "start_distill", "SOURCE_REVIEW"), record(1, "SOURCE_REVIEW", "pause", "SUSPENDED", at=1), record(2, "SUSPENDED", "resume", "SOURCE_REVIEW", at=11), record(3, "SOURCE_REVIEW", "content_granted", "INGEST", at=12)], FULL_LOG)
    assert states.spent(log).first().active_seconds == 2 * 86400


@pytest.mark.parametrize("days, gone", [(None, 30), (1, 1), (400, 90)])
def test_retention(spark, days, gone):
    log = spark.createDataFrame([record(0, "INIT", "start_distill", "SOURCE_REVIEW"), record(1, "SOURCE_REVIEW", "exhaust", "SUSPENDED_EXHAUSTED", at=5)], FULL_LOG)
    kept = spark.createDataFrame([(1, days)], "task_id long, retention_days int")
    now = lambda x: spark.createDataFrame([(T + x,)], "now timestamp_ntz")
    at = dt.timedelta(days=gone)
    assert states.sweep(log, kept, now(at)).first().n_deleted == 1 and states.sweep(log, kept, now(at - dt.timedelta(seconds=1))).isEmpty()


def test_leases(spark):
    rows = [(1, 1, 7, T, T + 2 * H), (1, 2, 7, T + H, T + 3 * H), (1, 3, 8, T + 2.5 * H, T + 4 * H), (1, 4, 7, T + 4 * H, T + 5 * H), (2, 5, 8, T, T + H), (1, 6, 9, T + 4.5 * H, T + 4.5 * H)]
    got = states.overlaps(spark.createDataFrame(rows, "task_id long, lease_id long, writer long, starts timestamp_ntz, ends timestamp_ntz")).collect()
    assert sorted(r.lease_id for r in got) == [3, 6]
