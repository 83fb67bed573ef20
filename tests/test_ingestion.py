import pytest
from proofmill.operators import ingestion

READS = [
    ([(1, "r", "r", "r")], ("taken", 1, 0)), ([(1, "r", "r", "s")], ("retry", None, 1)), ([(1, "r", "r", "s"), (2, "r", "r", "r")], ("taken", 2, 1)), ([(k, "r", "r", "s") for k in (1, 2, 3, 4)], ("quarantined", None, 4)),
    ([(k, "r", "r", "s") for k in (1, 2, 3)], ("retry", None, 3)), ([(1, "r", "s", "s")], ("quarantined", None, 0)), ([(1, "r", "s", "s"), (2, "r", "r", "r")], ("quarantined", None, 0)), ([(1, "r", "r", "r"), (2, "r", "s", "s")], ("taken", 1, 0)),
    ([(1, None, "r", "r")], ("quarantined", None, 0)), ([(1, "r", None, None)], ("quarantined", None, 0)), ([(1, "r", "r", "r"), (1, "r", "r", "r")], ("quarantined", None, 0)), ([(5, "r", "r", "r")], ("quarantined", None, 0)), ([(4, "r", "r", "r")], ("taken", 4, 0)), ([(None, "r", "r", "r")], ("quarantined", None, 0)),
]


def test_pinned(spark):
    rows = [(k, *r, f"{k}-{r[0]}") for k, (reads, _) in enumerate(READS) for r in reads]
    got = {r.source_id: (r.state, r.attempt, r.n_discarded, r.digest) for r in ingestion.pinned(spark.createDataFrame(rows, "source_id long, attempt long, pinned string, before string, after string, digest string")).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: want for k, (_, want) in enumerate(READS)}
    assert all(v[3] == (f"{k}-{v[1]}" if v[0] == "taken" else None) for k, v in got.items())


FITS = {"raw_bytes": 100, "unpacked_bytes": 1000, "depth": 2, "entries": 10, "event_bytes": 1_048_576, "wall_seconds": 60, "cpu_seconds": 60, "memory_bytes": 536_870_912, "output_bytes": 67_108_864, "staged_bytes": 5}
SETTINGS = "task_id long, name string, value long"


def usage(spark, rows):
    return spark.createDataFrame([(t, s, p, *(FITS | m).values()) for t, s, p, m in rows], "task_id long, source_id long, place long, " + ", ".join(f"{c} long" for c in FITS))


@pytest.fixture
def unset(spark):
    return spark.createDataFrame([], SETTINGS)


def test_each_ceiling_one_step_either_side(spark, unset):
    cases = [({}, ""), ({"unpacked_bytes": 1001}, "ratio")] + [({n: c}, "") for n, c in ingestion.OF_SOURCE.items() if n not in ("ratio", "raw_bytes")] + [({n: c + 1}, n) for n, c in ingestion.OF_SOURCE.items() if n not in ("ratio", "raw_bytes")]
    cases += [({"raw_bytes": 67_108_864}, ""), ({"raw_bytes": 67_108_865}, "raw_bytes"), ({"raw_bytes": None}, "ratio,raw_bytes"), ({"depth": 3, "cpu_seconds": 61}, "cpu_seconds,depth"), ({"raw_bytes": 0, "unpacked_bytes": 1}, "ratio")]
    found = {r.source_id: r for r in ingestion.verdicts(usage(spark, [(k, k, 0, m) for k, (m, _) in enumerate(cases)]), unset).collect()}
    assert [found[k].broken for k in range(len(cases))] == [b for _, b in cases] and all(found[k].taken == (b == "") for k, (_, b) in enumerate(cases))


def test_a_task_is_full(spark, unset):
    """What breaks its own ceilings counts for nothing; from the first source too many on none is taken, even a small one."""
    big = {"raw_bytes": 67_108_864}
    rows = [(0, k, k, big) for k in range(4)] + [(0, 10, -1, {"raw_bytes": 67_108_865})] + [(1, 20 + k, k, big) for k in range(4)] + [(1, 24, 4, {"raw_bytes": 1, "unpacked_bytes": 1}), (1, 25, 5, {"raw_bytes": 0, "unpacked_bytes": 0})] + [(2, 30, 0, {"entries": 9_999}), (2, 31, 1, {"entries": 2}), (3, 40, 0, {"staged_bytes": 536_870_912}), (3, 41, 1, {"staged_bytes": 0}), (4, 50, 0, {"staged_bytes": 536_870_913})]
    found = ingestion.verdicts(usage(spark, rows), unset)
    got = {r.source_id: r.broken for r in found.collect() if not r.taken}
    assert got == {10: "raw_bytes", 24: "task_raw_bytes", 25: "task_raw_bytes", 31: "staged_files", 50: "staging_bytes"}
    assert {r.source_id for r in ingestion.kept(usage(spark, rows).select("source_id"), found).collect()} == {r[1] for r in rows} - set(got)


def test_settings_lower_and_never_raise(spark):
    settings = spark.createDataFrame([(0, "depth", 1), (0, "depth", 5), (1, "depth", 3), (1, "raw_bytes", None), (1, "other", 0), (2, "task_raw_bytes", 150)], SETTINGS)
    assert {r.task_id: (r.depth, r.raw_bytes, r.raised) for r in ingestion.limits(settings).collect()} == {0: (1, 67_108_864, "depth"), 1: (2, 67_108_864, "depth"), 2: (2, 67_108_864, "")}
    got = {r.source_id: r.broken for r in ingestion.verdicts(usage(spark, [(0, 0, 0, {}), (1, 1, 0, {}), (1, 2, 1, {"depth": 3}), (2, 3, 0, {}), (2, 4, 1, {})]), settings).collect()}
    assert got == {0: "depth", 1: "", 2: "depth", 3: "", 4: "task_raw_bytes"}
