import json

from proofmill.operators import sessions
from proofmill.sources import envelopes

LINEAR = {"format": "linear", "version": "1", "stream": "a", "offset": 0, "kind": "message", "actor": "user", "actor_id": "u", "at": "2024-01-01T00:00:00", "text": "hi"}
TREE = {"format": "tree", "version": "2", "session": "b", "id": "x", "seq": 0, "role": "user", "actor_id": "u", "at": "2024-01-01T00:00:00", "blocks": [{"type": "text", "text": "hi"}]}
STEPS = {"format": "steps", "version": "1", "task": "c", "step": 0, "actor_id": "g", "tool": "run", "input": "in", "output": "out", "ok": True}
USE = {"type": "tool_use", "id": "t", "text": "{}"}


def table(spark, *lines):
    rows = [(f"s{k}", x if x is None or isinstance(x, str) else json.dumps(x)) for k, x in enumerate(lines)]
    return spark.createDataFrame(rows, "snapshot_id string, line string")


REFUSED = [
    (LINEAR, None), (TREE, None), (STEPS, None), (None, "malformed"), ("", "malformed"), ("{", "malformed"), ("[1]", "malformed"), (json.dumps(LINEAR)[:-3], "malformed"), (LINEAR | {"offset": "zero"}, "malformed"),
    ({}, "format"), (LINEAR | {"format": "other"}, "format"), (LINEAR | {"version": "2"}, "version"), (TREE | {"version": "1"}, "version"), ({k: v for k, v in STEPS.items() if k != "version"}, "version"),
    (LINEAR | {"more": 1}, "member"), (LINEAR | {"blocks": []}, "member"), (TREE | {"text": "x"}, "member"), (LINEAR | {"offset": None}, "place"), (LINEAR | {"offset": -1}, "place"), (TREE | {"session": None}, "place"), (STEPS | {"task": None}, "place"),
    (LINEAR | {"kind": "thought"}, "kind"), (LINEAR | {"kind": None}, "kind"), (TREE | {"blocks": None}, "kind"), (TREE | {"blocks": [{"type": "image"}]}, "kind"), (TREE | {"blocks": [USE, USE]}, "calls"), (TREE | {"blocks": [{"type": "text", "text": "a"}, USE]}, None),
]


def test_refusals(spark):
    rows = {r.snapshot_id: r.refused for r in envelopes.parsed(table(spark, *[x for x, _ in REFUSED])).collect()}
    assert [rows[f"s{k}"] for k in range(len(REFUSED))] == [r for _, r in REFUSED]


def test_one_refused_line_leaves_nothing_of_its_file(spark):
    lines = spark.createDataFrame([("good", json.dumps(LINEAR)), ("bad", json.dumps(LINEAR | {"stream": "z"})), ("bad", "{"), ("lost", json.dumps(LINEAR | {"stream": "y", "text": None}))], "snapshot_id string, line string")
    got = {r.snapshot_id: (r.n_lines, r.n_refused, r.reasons, r.n_lost, r.admitted) for r in envelopes.admissions(lines).collect()}
    assert got == {"good": (1, 0, "", 0, True), "bad": (2, 1, "malformed", 0, False), "lost": (1, 0, "", 1, False)}
    assert {r.snapshot_id for r in envelopes.admitted(lines).collect()} == {"good"}


def test_a_missing_clock_is_harmless(spark):
    row = envelopes.admissions(table(spark, LINEAR | {"at": None})).first()
    assert row.admitted and envelopes.events(table(spark, LINEAR | {"at": None})).first().losses == ["wall_clock"]


def test_a_step_without_an_outcome_is_a_call_alone(spark):
    got = envelopes.events(table(spark, {k: v for k, v in STEPS.items() if k not in ("ok", "output")})).collect()
    assert [(e.event_id, e.event_type, e.outcome) for e in got] == [("steps:c:0:call", "call", None)]
    both = envelopes.events(table(spark, STEPS | {"ok": False, "artifacts": ["f1", "f2"]}))
    assert {e.event_type: e.outcome for e in both.collect()} == {"call": None, "result": "error"}
    assert sorted((e.src, e.dst, e.edge_type, e.ref_state) for e in envelopes.links(both).collect()) == [("steps:c:0:call", "f1", "refers", "external"), ("steps:c:0:call", "f2", "refers", "external"), ("steps:c:0:call", "steps:c:0:result", "order", "internal")]


def test_every_envelope_has_all_columns_and_no_text(spark):
    got = envelopes.events(table(spark, LINEAR, TREE, STEPS))
    assert got.columns == list(envelopes.ENVELOPE)
    secret = envelopes.events(table(spark, LINEAR | {"text": "a secret text"})).first()
    assert "secret" not in str(secret) and secret.segments[0].n_bytes == 13


def session(*members):
    return [TREE | {"seq": k, "id": f"i{k}", "parent": f"i{k - 1}" if k else None} | m for k, m in enumerate(members)]


RESULT = {"role": "tool", "blocks": [{"type": "tool_result", "id": "t", "text": "ok"}]}
GOOD = session({}, {"role": "agent", "blocks": [USE]}, RESULT)
CHILD = {"agent": "k", "seq": 0, "id": "k0", "parent": None, "spawned_by": "i1", "role": "agent"}


CASES = [
    (GOOD, set()), ([*GOOD, TREE | CHILD], set()), (GOOD[:2], {""}), ([*GOOD, GOOD[2] | {"seq": 3, "id": "i3"}], {""}), ([GOOD[0], GOOD[2]], {""}), ([*GOOD, GOOD[0]], {""}),
    ([*GOOD, TREE | {"seq": 3, "id": "i3", "parent": "gone"}], {""}), ([*GOOD, TREE | {"seq": 3, "id": "i3", "parent": "i2", "replaces": "gone"}], {""}), ([*GOOD, TREE | CHILD | {"spawned_by": None}], {":k"}), ([*GOOD, TREE | CHILD | {"spawned_by": "gone"}], {":k"}),
    ([GOOD[0] | {"parent": "i2"}, *GOOD[1:]], {""}), ([GOOD[0] | {"actor_id": None}, *GOOD[1:]], {""}), ([GOOD[0], GOOD[1] | {"seq": 2}, GOOD[2] | {"seq": 3}], {""}),
]


def test_envelopes_as_an_event_graph(spark):
    """What envelopes state is checked as a graph: calls, references, spawns, order, cycles and owners; a session each."""
    lines = [(f"s{k}", json.dumps(x | {"session": f"b{k}"})) for k, (case, _) in enumerate(CASES) for x in case]
    found = envelopes.events(spark.createDataFrame(lines, "snapshot_id string, line string")).cache()
    got = sessions.quarantine(envelopes.nodes(found), envelopes.links(found))
    assert {r.root_id for r in got.collect() if r.quarantined} == {f"tree:b{k}{r}" for k, (_, bad) in enumerate(CASES) for r in bad}


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "snapshot_id string, line string")
    assert envelopes.events(none).count() == envelopes.admissions(none).count() == envelopes.links(envelopes.events(none)).count() == 0


def test_a_broken_line_of_another_version_is_refused_for_its_version(spark):
    cut = lambda line: json.dumps(line)[:50]
    lines = table(spark, cut(LINEAR | {"version": "9"}), cut(TREE | {"version": "9"}), cut(LINEAR), cut(LINEAR | {"format": "other", "version": "9"}), json.dumps(LINEAR | {"text": '{"format":"linear","version":"9"'})[:-1])
    assert [r.refused for r in envelopes.parsed(lines).orderBy("snapshot_id").collect()] == ["version", "version", "malformed", "malformed", "malformed"]
