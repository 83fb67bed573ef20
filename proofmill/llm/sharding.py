"""Operator 8: reproducible shuffle into shards by a Feistel permutation of global row numbers.

Every step is a DataFrame or SQL function. Row numbers come without a global sort: rows are
numbered inside hash buckets, and the buckets' counts, a table of at most ``buckets`` rows, give
each bucket's first number. The permutation then works on numbers alone, so the place of a row
follows from (row number, number of rows, key), and ``place_of`` computes it on its own.

Law: ``rows``. Row number r gets place p = permutation(r); shard p mod n, slot p div n. Counts of
shards differ by one at most and slots have no gaps.

Cases: a null text has no bytes (size 16, crc32 0); rows alike in all of doc_id and text are
interchangeable, each gets a place; a null doc_id is an ordinary value; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Buckets of row numbering for each so many rows, within these bounds.
ROWS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 9, 1 << 14
ROUNDS, STEPS, CHUNK = 6, 64, 4096
_M = (1 << 31) - 1


def _round_key(key: int, i: int) -> int:
    return (key * 1_000_003 + i * 7_919 + 12_345) % _M


def _mix(x: int, k: int) -> int:
    """A function of numbers below 2**31 that needs no more than 63 bits; the SQL form is in _mix_sql."""
    for m in (48_271, 69_621, 16_807):
        x = ((x % _M) * m + k) % _M
        x ^= x >> 15
    return x


def sides(n: int) -> tuple[int, int]:
    """The halves' sizes a and b: a * b is n or slightly more."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(x: int, n: int, key: int = 0) -> int:
    """The place of number x among n: a Feistel network on Z_a x Z_b, walked along its cycle until below n."""
    a, b = sides(n)
    while True:
        left, right = x // b, x % b
        for i in range(ROUNDS):
            k = _round_key(key, i)
            if i % 2 == 0:
                left = (left + _mix(right, k)) % a
            else:
                right = (right + _mix(left, k)) % b
        x = left * b + right
        if x < n:
            return x


def place_of(row: int, n_rows: int, n_shards: int, key: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number, without a look at the table."""
    p = permute(row, n_rows, key)
    return p % n_shards, p // n_shards


def _mix_sql(x: str, k: int) -> str:
    """_mix as nested let-bindings: aggregate() over the three multipliers."""
    return (
        f"aggregate(array(48271L, 69621L, 16807L), {x}, (v, m) -> "
        f"aggregate(array(((v % {_M}L) * m + {k}L) % {_M}L), 0L, (u, w) -> w ^ shiftright(w, 15)))"
    )


def permuted(number: str, n: int, key: int = 0) -> Column:
    """The same permutation as a SQL expression over a number column.

    The walk has STEPS steps; a number that is still outside after them stops the job rather than
    get a wrong place. Fewer than sqrt(n) + 1 of the a * b numbers are outside, so this needs n
    below 4096 to be thinkable, and for those the walk gets as many steps as there are outside numbers.
    """
    a, b = sides(n)
    step = "named_struct('l', x div {b}L, 'r', x % {b}L)".format(b=b)
    for i in range(ROUNDS):
        k = _round_key(key, i)
        if i % 2 == 0:
            new = f"named_struct('l', (s.l + {_mix_sql('s.r', k)}) % {a}L, 'r', s.r)"
        else:
            new = f"named_struct('l', s.l, 'r', (s.r + {_mix_sql('s.l', k)}) % {b}L)"
        # one-element transform binds s once
        step = f"transform(array({step}), s -> {new})[0]"
    once = f"transform(array({step}), s -> s.l * {b}L + s.r)[0]"
    # y counts as outside while it is not negative; inside numbers are kept as -1 - place
    walk = (
        f"aggregate(sequence(1, {max(STEPS, a * b - n + 1) if n < 4096 else STEPS}), {number}, "
        f"(y, i) -> IF(y < 0, y, transform(array(transform(array(y), x -> {once})[0]), z -> IF(z < {n}L, -1L - z, z))[0]), "
        f"y -> IF(y < 0, -1L - y, raise_error('the cycle walk did not end')))"
    )
    return F.expr(f"CAST({walk} AS BIGINT)")


def bucket_count(n_rows: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, n_rows // ROWS_A_BUCKET))


def numbered(rows: DataFrame, by: list[str], n_rows: int, to: str) -> DataFrame:
    """Rows of these columns with global row numbers from 0: by hash bucket, then by the columns.

    Rows that are alike are counted before they are shuffled and numbered as one; beyond CHUNK of them they
    are dealt to several tasks, so a table of copies is no single task's.
    """
    buckets = bucket_count(n_rows)
    kinds = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    kinds = Scratch(rows.sparkSession).keep(kinds)
    counts = kinds.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))
    first = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_first"))
    before = F.coalesce(F.sum("_copies").over(Window.partitionBy("_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most MOST_BUCKETS rows of two numbers
    placed = kinds.withColumn("_before", before).join(F.broadcast(first), "_bucket").select(*by, "_copies", (F.col("_first") + F.col("_before")).alias("_at"))
    count = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), upto.cast("long") - 1))
    one = placed.filter(F.col("_copies") <= CHUNK).withColumn("_k", count(F.col("_copies")))
    many = placed.filter(F.col("_copies") > CHUNK).withColumn("_chunk", count(F.ceil(F.col("_copies") / CHUNK))).repartition(*by, "_chunk")
    many = many.withColumn("_k", count(F.least(F.lit(CHUNK), F.col("_copies") - F.col("_chunk") * CHUNK))).withColumn("_k", F.col("_k") + F.col("_chunk") * CHUNK)
    return one.unionByName(many.drop("_chunk")).select(*by, (F.col("_at") + F.col("_k")).alias(to))


def shard(docs: DataFrame, n_shards: int, key: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row; texts stay where they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    n = slim.count()
    if n == 0:
        return slim.withColumns({"row_number": F.lit(None).cast("long"), "shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    out = numbered(slim, ["doc_id", "text_crc32", "size"], n, "row_number").withColumn("_place", permuted("row_number", n, key))
    return out.select("doc_id", "size", "text_crc32", "row_number", F.pmod("_place", F.lit(n_shards)).cast("int").alias("shard"), F.expr(f"_place div {int(n_shards)}").cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
