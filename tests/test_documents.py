import json

from proofmill.sources import documents
from pyspark.sql import functions as F

GOOD = "# a comment\ntask_id: \"t: 1 # é \\\" \\n\"\nphase: source review\nrun_epoch: -3\npaused: true\nsources:\n  - one\n  - \"2\"\n\n  - three four\nbudgets:\n  pages: 5\n  note: null\n"
READ = {"task_id": "t: 1 # é \" \n", "phase": "source review", "run_epoch": -3, "paused": True, "sources": ["one", "2", "three four"], "budgets": {"pages": 5, "note": None}}


def changed(old, new):
    assert old in GOOD
    return GOOD.replace(old, new)


YAML = [
    (GOOD, ""), (GOOD.replace("\n", "\r\n"), ""), (GOOD.rstrip("\n"), ""), (changed("  - one\n  - \"2\"\n\n  - three four\n", "").replace("sources:", "sources: []"), ""),
    (None, "empty"), ("", "empty"), ("# nothing\n\n", "empty"), ("---\n" + GOOD, "marker,line"), (changed("phase: source review", "phase: &a x"), "anchor,scalar"), (changed("phase: source review", "phase: *a"), "anchor,scalar"), (changed("phase: source review", "phase: !!str x"), "scalar,tag"),
    (changed("phase: source review", "phase: {a: 1}"), "flow,scalar"), (changed("phase: source review", "phase: |"), "block,scalar"), (changed("phase: source review", "phase: yes"), "scalar"), (changed("phase: source review", "phase: No"), "scalar"), (changed("phase: source review", "phase: 'x'"), "scalar"),
    (changed("phase: source review", "phase: a: b"), "scalar"), (changed("phase: source review", "phase: a # b"), "scalar"), (changed("run_epoch: -3", "run_epoch: 012"), "scalar"), (changed("run_epoch: -3", "run_epoch: 1.5"), "scalar"), (changed("run_epoch: -3", "run_epoch: 0x1f"), "scalar"), (changed("run_epoch: -3", "run_epoch: 2024-01-01"), "scalar"),
    (changed("  - one", "\t- one"), "indent,line,tab,value"), (changed("  - one", "    - one"), "indent,line,value"), (changed("  - one", "  - [a]"), "flow,scalar"), (changed("  - one", "  - []"), "flow"), (changed("  - three four\n", "  - a\n  b: c\n"), "indent"), (changed("paused: true\n", "paused: true\n  - x\n"), "indent"),
    (changed("paused: true", "paused:"), "value"), (changed("paused: true\n", "paused: true\npaused: true\n"), "parse"), (changed("  pages: 5\n", "  pages: 5\n  pages: 5\n"), "parse"), (changed("paused: true\n", ""), "missing"), (changed("paused: true", "halted: true"), "unknown"), (changed("paused: true", "paused: 1"), "type"), (changed("run_epoch: -3", "run_epoch: null"), "type"),
    (changed("sources:\n", "sources:\n# in between\n"), ""), (changed('"2"', '"\\q"'), "parse"), (changed("run_epoch: -3", "run_epoch: 99999999999999999999"), "scalar"),
]
JSON = [
    (json.dumps(READ), ""), (json.dumps(READ)[:-1], "parse"), (json.dumps(READ)[:-1] + ', "paused": true}', "parse"), ('{"a": {"b": 1, "b": 2}}', "parse"), ("[1]", "parse"), (None, "parse"), ("null", "parse"), (json.dumps(READ | {"x": 1}), "unknown"), (json.dumps(READ | {"paused": "true"}), "type"), (json.dumps(READ | {"run_epoch": 1.5}), "type"),
]


def test_documents(spark):
    cases = [("yaml", *c) for c in YAML] + [("json", *c) for c in JSON] + [("toml", GOOD, "format"), (None, GOOD, "format")]
    rows = spark.createDataFrame([(k, f, t) for k, (f, t, _) in enumerate(cases)], "doc long, format string, text string")
    got = {r.doc: r for r in documents.checked(rows, documents.STATE).select("doc", "refused", F.to_json("value").alias("value")).collect()}
    assert len(got) == len(cases)
    wrong = {k: (got[k].refused, want, text) for k, (_, text, want) in enumerate(cases) if sorted(got[k].refused.split(",")) != sorted(want.split(","))}
    assert not wrong
    assert json.loads(got[0].value) == json.loads(got[1].value) == READ and all((got[k].value is None) == (want != "") for k, (_, _, want) in enumerate(cases))


def test_round_trip(spark):
    rows = spark.createDataFrame([(1, "a\n\"b\" \\ #:", "yes", 7, False, ["- x", ""], {"k": "1", "a": "é"}), (2, "", "null", 0, True, [], {})], "doc long, task_id string, phase string, run_epoch long, paused boolean, sources array<string>, budgets map<string, string>")
    text = documents.rendered(documents.STATE, **{n: F.col(n) for n in documents.STATE})
    back = documents.checked(rows.select("doc", F.lit("yaml").alias("format"), text.alias("text")), documents.STATE).select("doc", "refused", F.to_json("value").alias("value"))
    want = {r.doc: {n: r[n] for n in documents.STATE} for r in rows.collect()}
    assert {r.doc: (r.refused, json.loads(r.value)) for r in back.collect()} == {k: ("", v) for k, v in want.items()}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "state.yaml").write_text(GOOD)
    got = documents.read(spark, str(tmp_path)).collect()
    assert [(r.doc.rsplit("/", 1)[1], r.text) for r in got] == [("state.yaml", GOOD)]
