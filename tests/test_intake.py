import gzip
import zlib

import pytest
from proofmill.operators import intake

PNG = bytes.fromhex("89504E470D0A1A0A")


@pytest.mark.parametrize("raw, n", [(b"", 0), (b"plain", 5), (gzip.compress(b"short text, hardly any smaller"), None), (gzip.compress(bytes(10**6)), "over"), (zlib.compress(bytes(10**6)), "over"), (gzip.compress(bytes(10**6))[:200], None), (b"\x1f\x8bno gzip", 9)])
def test_expansion_stops_at_the_ceiling(raw, n):
    got = intake.expanded(raw)
    if n == "over":
        assert got == 10 * len(raw) + 1
    elif n is None:
        assert got >= len(raw)
    else:
        assert got == n


def test_ratio():
    """A whole ratio that just holds what is unpacked, and the one below it."""
    raw = gzip.compress(b"a" * 100_000)
    enough = -(-100_000 // len(raw))
    assert intake.expanded(raw, ratio=enough) == 100_000 and intake.expanded(raw, ratio=enough - 1) == (enough - 1) * len(raw) + 1


FILES = {
    "good/SKILL.md": "été 中文".encode(), "good/assets/a.png": PNG + b"rest", "good/assets/b.webp": b"RIFF1234WEBPxx",
    "utf8/a.md": b"\xff\xfe", "utf8/ok.md": b"fine", "overlong/a.md": b"\xc0\x80", "surrogate/a.md": b"\xed\xa0\x80", "nul/a.txt": b"a\x00b",
    "magic/a.md": PNG, "png/a.png": b"text", "riff/a.webp": b"RIFF1234AVI xx", "bomb/a.md": gzip.compress(bytes(10**6)), "exe/a.sh": b"echo", "deep/x/y/a.json": b"{}",
}


def test_files(spark, tmp_path):
    for p, raw in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(raw)
    files = intake.read(spark, str(tmp_path))
    found = intake.verdicts(files)
    got = {f"{r.source_id}/{r.rel_path}": r.violations for r in found.collect()}
    assert got == dict.fromkeys(FILES, "") | {"utf8/a.md": "utf8", "overlong/a.md": "utf8", "surrogate/a.md": "utf8", "nul/a.txt": "utf8", "magic/a.md": "utf8", "png/a.png": "magic", "riff/a.webp": "magic", "bomb/a.md": "ratio,utf8", "exe/a.sh": "extension"}
    assert {f"{r.source_id}/{r.rel_path}" for r in intake.accepted(files, found).collect()} == {p for p in FILES if p.split("/")[0] in ("good", "deep")}


def test_a_source_above_the_ceiling(spark, monkeypatch):
    monkeypatch.setattr(intake, "RAW", 10)
    rows = spark.createDataFrame([("a", "x.md", b"12345"), ("a", "y.md", b"12345"), ("b", "x.md", b"12345"), ("b", "y.md", b"123456"), ("c", "z.md", None)], "source_id string, rel_path string, content binary")
    got = {(r.source_id, r.rel_path): r.violations for r in intake.verdicts(rows).collect()}
    assert got == {("a", "x.md"): "", ("a", "y.md"): "", ("b", "x.md"): "size", ("b", "y.md"): "size", ("c", "z.md"): ""}
