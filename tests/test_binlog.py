import hashlib

import pytest
from proofmill.functions import checksums
from proofmill.sources import binlog


def log(payloads, epochs=None):
    out, before = [], bytes(32)
    for k, p in enumerate(payloads):
        data = binlog.body(k, (epochs or [1] * len(payloads))[k], before, p)
        before = hashlib.sha256(data).digest()
        out.append(binlog.frame(data))
    return out


def flipped(raw, at):
    return raw[:at] + bytes([raw[at] ^ 4]) + raw[at + 1 :]


FRAMES = log([b"alpha", b"", b"gamma" * 40, b"delta"])
WHOLE = b"".join(FRAMES)
ENDS = [sum(map(len, FRAMES[: k + 1])) for k in range(4)]
FORGED = b"".join([*FRAMES[:2], binlog.frame(binlog.body(2, 1, bytes(32), b"x"))])
CASES = [
    ("sound", WHOLE, (4, 4, len(WHOLE), "sound")),
    ("torn", WHOLE[:-1], (4, 3, ENDS[2], "truncated")),
    ("one_byte_of_the_last", WHOLE[: ENDS[2] + 1], (4, 3, ENDS[2], "truncated")),
    ("flip_in_the_last", flipped(WHOLE, len(WHOLE) - 6), (4, 3, ENDS[2], "truncated")),
    ("flip_inside", flipped(WHOLE, ENDS[1] + 90), (4, 2, ENDS[1], "FAILED_PERMANENT")),
    ("length_inside", flipped(WHOLE, ENDS[0] + 1), (2, 1, ENDS[0], "FAILED_PERMANENT")),
    ("forged_hash", FORGED, (3, 2, ENDS[1], "FAILED_PERMANENT")),
    ("repeated", b"".join([*FRAMES[:2], FRAMES[1]]), (3, 2, ENDS[1], "FAILED_PERMANENT")),
    ("only_torn", WHOLE[:10], (1, 0, 0, "truncated")),
    ("stale_epoch", b"".join(log([b"a", b"b", b"c"], [1, 2, 1])), (3, 2, 2 * len(FRAMES[1]) + 2, "FAILED_PERMANENT")),
]


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, raw, _ in CASES:
        (tmp_path / "deep" / f"{name}.log").write_bytes(raw)
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"not a log")
    got = {r["log"].rsplit("/", 1)[1][:-4]: (r.n_records, r.n_verified, r.verified_bytes, r.status) for r in binlog.verified(binlog.read(spark, str(tmp_path))).collect()}
    assert got == {name: want for name, _, want in CASES}


def test_every_flipped_bit_is_noticed(spark):
    raws = [(k, flipped(WHOLE, k)) for k in range(len(WHOLE))]
    got = binlog.verified(binlog.frames(spark.createDataFrame(raws, "path long, content binary"))).collect()
    assert len(got) == len(WHOLE)
    for r in got:
        torn = r["log"] >= ENDS[2] and r["log"] != ENDS[2] + 3  # there the last frame gets shorter, and bytes are left behind it
        assert r.status == ("truncated" if torn else "FAILED_PERMANENT"), r
        assert r.n_verified == sum(e <= r["log"] for e in ENDS)


def test_packed(spark):
    bodies = [("a", k, f[4:-4].hex(), False, None) for k, f in enumerate(FRAMES)] + [("b", 0, FRAMES[0][4:-4].hex(), False, 7)]
    got = {r["log"]: bytes(r.content) for r in binlog.packed(spark.createDataFrame(bodies, "log string, place long, body string, flip boolean, kept long")).collect()}
    assert got == {"a": WHOLE, "b": FRAMES[0][:7]}


def test_checksums_of_batches():
    import pyarrow as pa

    rows = [b"", b"123456789", None, bytes(32), b"\xff" * 32, b"x" * 1000, b"a"]
    assert checksums.crc32c_array(pa.array(rows, pa.binary())).to_pylist() == [checksums.crc32c(r) for r in rows]
    assert checksums.crc32c_array(pa.array(rows, pa.binary()).slice(1, 3)).to_pylist() == [0xE3069283, None, 0x8A9136AA]


@pytest.mark.parametrize("raw", [b"", b"\x00", b"\xff" * 300, bytes(300)])
def test_bytes_that_are_no_log(raw):
    assert all(not whole for _, _, whole in binlog.scan(raw)) and len(binlog.parsed(raw)) <= 1


def test_logs_are_read_together(spark, monkeypatch):
    """Checksums of many small logs take one pass; rows are those of each log alone."""
    logs = [b"".join(binlog.frame(binlog.body(k, 1, bytes(32), b"x" * (n + k))) for k in range(n % 4)) + (b"torn" if n % 5 == 2 else b"") for n in range(12)]
    passes, spans = [], binlog.crc32c_spans
    monkeypatch.setattr(binlog, "crc32c_spans", lambda *a: passes.append(1) or spans(*a))
    together = binlog._parsed(logs)
    assert len(passes) == 1 and together == [binlog.parsed(raw) for raw in logs]
