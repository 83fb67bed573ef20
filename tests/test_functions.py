import json
import zlib

import pytest
from proofmill.operators import artifacts as a
from pyspark.sql import functions as F


def test_crc32c_known_values():
    assert a.crc32c(b"123456789") == 0xE3069283 and a.crc32c(b"") == 0 and a.crc32c(None) is None
    assert a.crc32c(bytes(32)) == 0x8A9136AA and a.crc32c(b"\xff" * 32) == 0x62A8AB43
    assert a.crc32c(b"123456789") != zlib.crc32(b"123456789")


@pytest.mark.parametrize("x, said", [(0.0, "0"), (-0.0, "0"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (9007199254740992.0, "9007199254740992"), (295147905179352830000.0, "295147905179352830000"), (9.999999999999997e22, "9.999999999999997e+22"), (1e23, "1e+23"), (1e21, "1e+21"), (999999999999999900000.0, "999999999999999900000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (333333333.3333332, "333333333.3333332"), (-1.5, "-1.5"), (0.002, "0.002")])
def test_numbers(x, said):
    assert a.number(x) == said and float(said) == x


def test_canonical_json():
    members = {"\u20ac": "Euro Sign", "\r": "Carriage Return", "\ufb33": "Hebrew", "1": "One", "\U0001f600": "Emoji", "\u0080": "Control", "\u00f6": "Latin"}
    assert list(json.loads(a.canonical(members)).values()) == ["Carriage Return", "One", "Control", "Latin", "Euro Sign", "Emoji", "Hebrew"]
    assert a.canonical({"b": [1, 2.0, None, True], "a": "\u20ac$\x0f\n\"\\"}) == '{"a":"\u20ac$\\u000f\\n\\"\\\\","b":[1,2,null,true]}'
    with pytest.raises(ValueError):
        a.canonical(float("nan"))
    assert a.canonical(a.parsed('{"b": 9007199254740993, "a": [1000000000000000000000, 1e21, -0, true, 1.50]}')) == '{"a":[1e+21,1e+21,0,true,1.5],"b":9007199254740992}'
    with pytest.raises(ValueError):
        a.parsed('{"a": 1, "a": 2}')


def test_casefold():
    assert a.casefolded("STRASSE") == a.casefolded("stra\u00dfe") and a.casefolded("e\u0301") == a.casefolded("\u00c9") and a.casefolded(None) is None


def test_columns(spark):
    rows = spark.createDataFrame([("a/./b//c",), ("/etc/x",), ("a/../b",), (None,), ("",)], "p string")
    assert [r[0] for r in rows.select(a.normalised(rows.p)).collect()] == ["a/b/c", None, None, None, ""]
    keys = spark.createDataFrame([(None, "x"), ("", "x"), ("x", None), ("x", "")], "a string, b string").select(a.identity(F.col("a"), F.col("b"))).collect()
    assert len({r[0] for r in keys}) == 4
    folded = rows.select(a.casefold(rows.p), a.crc32c_of(rows.p.cast("binary"))).collect()
    assert folded[0][0] == "a/./b//c" and folded[3][0] is None and folded[3][1] is None and folded[4][1] == 0


#: Fixed values of RFC 8032, section 7.1: seed, public key, message, signature.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


@pytest.mark.parametrize("seed, key, message, signature", [tuple(map(bytes.fromhex, v)) for v in VECTORS])
def test_signature_vectors(seed, key, message, signature):
    from proofmill.functions import signatures as s

    assert s.public(seed) == key and s.sign(seed, message) == signature and s.verified(key, message, signature)
    assert not s.verified(key, message + b"x", signature) and not s.verified(key[:-1], message, signature) and not s.verified(key, message, signature[:-1])
    assert not s.verified(None, message, signature) and not s.verified(key, message, signature[:32] + (int.from_bytes(signature[32:], "little") + s.L).to_bytes(32, "little"))
    assert not s.verified(b"\xff" * 32, message, signature) and not s.verified((2).to_bytes(32, "little"), message, signature)
    for k in range(0, 512, 37):
        bad = bytearray(signature)
        bad[k // 8] ^= 1 << k % 8
        assert not s.verified(key, message, bytes(bad))


def test_signatures_of_columns(spark):
    from proofmill.functions import signatures as s

    seed, key, message, signature = map(bytes.fromhex, VECTORS[1])
    rows = spark.createDataFrame([(1, key, message, signature), (2, key, b"other", signature), (3, None, message, signature), (4, key, message, None)], "id long, k binary, m binary, s binary")
    assert {r.id: r.good for r in s.checked(rows, "k", "m", "s", "good").collect()} == {1: True, 2: False, 3: False, 4: False}
    asked = spark.createDataFrame([(1, "e", message, signature, 2, 7), (2, "x", message, signature, 2, 7), (3, "e", message, signature[:-1], 2, 7), (4, "e", message, signature, 1, 7), (5, "e", message, signature, 2, 6), (6, "e", message, signature, None, 7)], "receipt long, key_id string, message binary, signature binary, fencing_epoch int, authority_epoch int")
    got = s.receipts(asked, spark.createDataFrame([("e", key)], "key_id string, public_key binary"), spark.createDataFrame([(2, 7)], "fencing int, authority int"))
    assert {r.receipt: r.status for r in got.collect()} == {1: "accepted", 2: "unknown key", 3: "not signed", 4: "stale", 5: "stale", 6: "stale"}


def test_keys_met_once_and_often_agree():
    from proofmill.functions import signatures as s

    seed, key, message, signature = map(bytes.fromhex, VECTORS[1])
    odd = [(0).to_bytes(32, "little"), (1).to_bytes(32, "little"), (s.P - 1).to_bytes(32, "little")]  # points of small order
    for k in [key, s.public(bytes(32)), *odd]:
        for m, mark in [(message, signature), (b"other", signature), (message, odd[1] + bytes(32)), (message, odd[2] + bytes(32)), (message, odd[0] + signature[32:])]:
            assert s.verified(k, m, mark) == s.verified(k, m, mark, often=True)


def test_receipts_are_signed_and_verified_by_many_tasks(spark):
    from proofmill.functions import signatures as s
    from proofmill.plans import fixtures

    rows = spark.range(64).coalesce(1).selectExpr("id AS receipt", "'e' AS key_id", "'d' AS digest", "1 AS fencing_epoch", "1 AS authority_epoch", "CASE id % 3 WHEN 0 THEN 'altered' WHEN 1 THEN 'cut' ELSE '' END AS fault")
    made = fixtures.receipts(rows)
    assert made.rdd.getNumPartitions() > 1
    got = s.receipts(made, fixtures.evaluators(rows.select("key_id").distinct()), spark.sql("SELECT 1 AS fencing, 1 AS authority"))
    assert got.rdd.getNumPartitions() > 1 and {r.receipt: r.status for r in got.collect()} == {k: "accepted" if k % 3 == 2 else "not signed" for k in range(64)}


def test_rotations_are_signed_once_by_many_tasks(spark):
    from proofmill.functions import signatures as s
    from proofmill.operators.policies import trusted
    from proofmill.plans import fixtures

    rows = spark.range(40).coalesce(1).selectExpr("id AS old_key", "id + 1 AS new_key", "id <> 30 AS signed")
    made = fixtures.rotations(rows)
    assert made.rdd.getNumPartitions() > 1 and str(made._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
    row = made.filter("old_key = 7").first()
    assert s.verified(bytes(row.public_key), bytes(row.message), bytes(row.signature)) and row.public_key == s.public(fixtures.seed("7"))
    assert {r[0] for r in trusted(made, 0).collect()} == set(range(31))
