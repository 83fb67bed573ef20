"""Ed25519 as RFC 8032 has it, over Arrow batches on the executors; nothing goes to the driver.

Points are in extended coordinates. The base point, and each key that a batch holds often, get a table of
multiples by digits of eight bits, so a product is 32 additions; other keys are multiplied by doubling.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Fixed values of the curve: field, order of the base point, coefficient, square root of -1, base point's y.
P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
BASE_Y = 4 * pow(5, P - 2, P) % P
ZERO = (0, 1, 1, 0)
Point = tuple[int, int, int, int]
Row = tuple[int, int, int]
#: Bits of a table's digits, and how often a batch must hold a key for a table of it to pay.
WINDOW, OFTEN = 8, 32


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _x(y: int, odd: int) -> int | None:
    """The x of a point with this y; None if there is none."""
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (not x and odd):
        return None
    return x if x & 1 == odd else P - x


def _unpack(data: bytes) -> Point | None:
    """The point that 32 bytes stand for; None if they are no canonical form of one."""
    if len(data) != 32:
        return None
    number = int.from_bytes(data, "little")
    y, odd = number & (1 << 255) - 1, number >> 255
    if y >= P or (x := _x(y, odd)) is None:
        return None
    return x, y, 1, x * y % P


def _pack(p: Point) -> bytes:
    inverse = pow(p[2], -1, P)
    return (p[1] * inverse % P | (p[0] * inverse % P & 1) << 255).to_bytes(32, "little")


def _affine(points: list[Point]) -> list[Row]:
    """Points as (y - x, y + x, 2dxy), with one inversion for all."""
    before, product = [], 1
    for p in points:
        before.append(product)
        product = product * p[2] % P
    inverse, out = pow(product, -1, P), []
    for p, b in zip(reversed(points), reversed(before)):
        one, inverse = inverse * b % P, inverse * p[2] % P
        x, y = p[0] * one % P, p[1] * one % P
        out.append((y - x, y + x, 2 * D * x * y % P))
    return out[::-1]


def _table(p: Point) -> list[list[Row]]:
    """table[i][d] is d * 2**(WINDOW * i) times the point."""
    out, size = [], 1 << WINDOW
    for _ in range(-(-256 // WINDOW)):
        row = [ZERO]
        for _ in range(size - 1):
            row.append(_add(row[-1], p))
        out += row
        p = _add(row[-1], p)
    flat = _affine(out)
    return [flat[k : k + size] for k in range(0, len(flat), size)]


def _plus(p: Point, row: Row) -> Point:
    """p and a point of a table."""
    x, y, z, t = p
    a, b, c = (y - x) * row[0] % P, (y + x) * row[1] % P, t * row[2] % P
    e, f, g, h = b - a, 2 * z - c, 2 * z + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, table: list[list[Row]], start: Point = ZERO) -> Point:
    for row in table:
        if digit := n & (1 << WINDOW) - 1:
            start = _plus(start, row[digit])
        n >>= WINDOW
    return start


def _doubled(p: Point) -> Point:
    x, y, z, _ = p
    a, b = x * x % P, y * y % P
    h, e, g = a + b, a + b - (x + y) * (x + y) % P, a - b
    f = 2 * z * z % P + g
    return e * f % P, g * h % P, f * g % P, e * h % P


def _once(n: int, p: Point) -> Point:
    """n times a point that is not met again: by doubling, over signed odd digits of five bits."""
    digits = []
    while n:
        d = 0
        if n & 1:
            d = n & 31
            d -= 32 if d > 15 else 0
            n -= d
        digits.append(d)
        n >>= 1
    odd, twice = [p], _doubled(p)
    for _ in range(7):
        odd.append(_add(odd[-1], twice))
    out = ZERO
    for d in reversed(digits):
        out = _doubled(out)
        if d > 0:
            out = _add(out, odd[d >> 1])
        elif d:
            x, y, z, t = odd[-d >> 1]
            out = _add(out, (-x, y, z, -t))
    return out


_BASE = _table((_x(BASE_Y, 0), BASE_Y, 1, _x(BASE_Y, 0) * BASE_Y % P))


def _negative(key: bytes) -> Point | None:
    """A key's negative; None if it is no point."""
    p = _unpack(key)
    return p and (P - p[0], p[1], 1, P - p[3])


@lru_cache(maxsize=16)
def _negated(key: bytes) -> list[list[Row]] | None:
    """The table of a key's negative; None if it is no point."""
    p = _negative(key)
    return p and _table(p)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


@lru_cache(maxsize=4096)
def public(seed: bytes) -> bytes:
    """The public key of a seed of 32 bytes."""
    return _pack(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    r = _hash(prefix, message) % L
    head = _pack(_times(r, _BASE))
    return head + ((r + _hash(head, public(seed), message) * a) % L).to_bytes(32, "little")


def verified(key: bytes | None, message: bytes | None, signature: bytes | None, often: bool = False) -> bool:
    """Did the key's owner sign the message? A malformed key or signature is no. A key that is met often gets a table."""
    if key is None or message is None or signature is None or len(signature) != 64 or len(key) != 32:
        return False
    s = int.from_bytes(signature[32:], "little")
    known = _negated(key) if often else _negative(key)
    if s >= L or known is None:
        return False
    n = _hash(signature[:32], key, message) % L
    return _pack(_times(s, _BASE, _times(n, known) if often else _once(n, known))) == signature[:32]


def spread(rows: DataFrame) -> DataFrame:
    """rows over several tasks a core, since a signature costs far more than the bytes that tell tasks apart."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def checked(rows: DataFrame, key: str, message: str, signature: str, to: str) -> DataFrame:
    """rows with a boolean column: is the signature (binary) the key's (binary) over the message (binary)? Null is no."""
    at, schema = [rows.columns.index(c) for c in (key, message, signature)], StructType([*rows.schema.fields, StructField(to, BooleanType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, *rest = (batch.column(k).to_pylist() for k in at)
            met = Counter(keys)
            good = [verified(k, m, s, met[k] >= OFTEN) for k, m, s in zip(keys, *rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good, pa.bool_())], names)

    return rows.mapInArrow(run, schema)


def receipts(rows: DataFrame, keys: DataFrame, epochs: DataFrame) -> DataFrame:
    """rows (receipt, key_id, message, signature, fencing_epoch, authority_epoch) with a status.

    keys (key_id, public_key) are the allowlisted evaluators, epochs is one row (fencing, authority). In
    this order a receipt is of an unknown key, not signed, stale, or accepted.
    """
    known = rows.join(keys, "key_id", "left").crossJoin(F.broadcast(epochs))  # epochs: one row
    found = checked(spread(known), "public_key", "message", "signature", "signed")
    stale = F.coalesce((F.col("fencing_epoch") < F.col("fencing")) | (F.col("authority_epoch") < F.col("authority")), F.lit(True))
    status = F.when(F.col("public_key").isNull(), "unknown key").when(~F.col("signed"), "not signed").when(stale, "stale").otherwise("accepted")
    return found.select("receipt", status.alias("status"))
