"""Operator 10: near-duplicate documents by MinHash with tensored banding.

Words are runs of bytes other than white space after lower-casing A-Z; each is hashed by SipHash. A
document's set holds the hashes of its distinct shingles of SHINGLE words; a shorter text is one
shingle as a whole. Documents with equal sets form a class; only classes are compared. Two collections
of SIDE tuples of ROWS minhashes are computed, and every pair of a tuple of the one and a tuple of the
other keys a table: SIDE * SIDE tables from 2 * SIDE * ROWS minhashes instead of 2 * SIDE * SIDE * ROWS.
At a similarity of 0.8 a pair shares a table with a probability of 0.9993, at 0.9 of over 0.9999.

Tuples are dealt first, and tables made only of those that several classes have. Table entries are dealt
and sorted by key once; a run of several classes is a bucket. Classes of a
bucket are compared with its leader on their full sets, another leader follows in a second round. Of
buckets that then still hold several components, all pairs are compared that can be similar enough:
of two such sets, ordered by the frequency of shingles in these buckets, the first shingle that both
have stands early enough in each to leave room for the threshold. Only pairs that pass this exact
bound, are not in one component yet and share a table are linked. So a group of copies costs a
comparison per member, and a passage that many otherwise different documents share costs none.

Cases: null and empty texts and those of white space alone have no set and stand alone; a null doc_id
is a row like others, never the smallest id unless its component holds nothing else; repeated rows are
one class; of components with the same smallest doc_id each keeps its row; a text of any length is one
set, in memory while it is read; an empty table gives no rows; extra columns are not read by
``near_duplicates`` and kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, buffers, clean_text, mix, slices, unused, word_hashes
from .graph import components

SHINGLE, SIDE, ROWS, LEADERS = 5, 11, 3, 2
#: Members that are compared with one copy of a leader's set.
SALT_ROWS = 512
#: Counters of shingles, 8 bytes each.
COUNTERS = 1 << 20
#: Bits of a sketch of keys, sent as at most a 64th as many rows.
SLOTS = 1 << 24
#: Hashes of shingles that are worked on at a time, and pairs of one shingle.
CHUNK, PAIRS = 1 << 15, 1 << 21
_SEEDS = mix(np.arange(1, 2 * SIDE * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS) | U64(1)


def shingles(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text): each text's distinct shingle hashes in ascending order."""
    word, count, _ = word_hashes(texts)
    begin = np.cumsum(count) - count
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    offsets = np.append(0, np.cumsum(n))
    text = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(text)) + np.repeat(begin - offsets[:-1], n)
    value = np.zeros(len(at), U64)
    for k in range(size):
        there = k < count[text]
        value = mix(value + np.where(there, word[np.where(there, at + k, 0)], U64(k + 1))) if len(at) else value
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[offsets[:-1][n > 0]] = True
    return value[new], np.append(0, np.cumsum(new))[offsets]


def set_ids(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A 128-bit name of each set of shingles; none is empty."""
    if not len(starts):
        return []
    both = [np.add.reduceat(mix(values ^ U64(seed)), starts) for seed in (0, 0x5851F42D4C957F2D)]
    whole = np.stack(both, axis=1).astype(">u8").tobytes()
    return [whole[k : k + 16] for k in range(0, len(whole), 16)]


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set 2 * SIDE tuples of ROWS minhashes, a hash of each tuple; no set is empty."""
    low = np.full((len(_SEEDS), len(starts)), np.iinfo(U64).max, U64)
    for begin in range(0, len(values), CHUNK):
        part = values[begin : begin + CHUNK]
        a = int(np.searchsorted(starts, begin, "right")) - 1
        b = int(np.searchsorted(starts, begin + len(part)))
        cut = np.maximum(starts[a:b] - begin, 0)
        for k in range(len(_SEEDS)):
            low[k, a:b] = np.minimum(low[k, a:b], np.minimum.reduceat((part ^ _SEEDS[k]) * _FACTORS[k], cut))
    out = np.zeros((len(starts), 2 * SIDE), U64)
    for k in range(ROWS):
        out = mix(out + low[k::ROWS].T + U64(k + 1))
    return out


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets = shingles(batch.column(1).to_pylist(), size)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            ids, signs = [None] * len(n), [None] * len(n)
            tables = signatures(values, offsets[full])
            for row, name, sign in zip(full.tolist(), set_ids(values, offsets[full]), tables):
                ids[row], signs[row] = name, sign.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "name", "n_shingles", "set_id", "sign"])

    return run


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, sign): a row per tuple, with its number."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 4096):
            part = batch.slice(begin, 4096)
            sign = buffers(part.column(1))[0].view(U64).reshape(-1, 2 * SIDE)
            key = mix(sign * U64(0x9FB21C651E98DF25) + np.arange(2 * SIDE, dtype=U64))
            node = np.repeat(part.column(0).to_numpy(), 2 * SIDE)
            number = np.tile(np.arange(2 * SIDE), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node, pa.int64()), pa.array(number, pa.int64())], ["key", "node", "items"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, sign, items, shared): a row per table whose two tuples are among the shared ones: the pair that it is keyed by."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 4096):
            part = batch.slice(begin, 4096)
            sign = buffers(part.column(1))[0].view(U64).reshape(-1, 2 * SIDE)
            table = np.arange(SIDE * SIDE, dtype=U64)
            key = mix(np.repeat(sign[:, :SIDE], SIDE, axis=1) * U64(0x9FB21C651E98DF25) + np.tile(sign[:, SIDE:], (1, SIDE)) + table)
            has = (part.column(3).to_numpy()[:, None] >> np.arange(2 * SIDE)) & 1 > 0
            both = (np.repeat(has[:, :SIDE], SIDE, axis=1) & np.tile(has[:, SIDE:], (1, SIDE))).ravel()
            node, items = (np.repeat(part.column(k).to_numpy(), SIDE * SIDE)[both] for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()[both].view(np.int64)), pa.array(node, pa.int64()), pa.array(items, pa.int64())], ["key", "node", "items"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, items) in this order those of keys with several nodes, with the key's first node and its items."""
    held = None  # the last row with its key's first node and items, and whether it was given out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, items = (c.to_numpy() for c in batch.columns)
        if held:
            key, node, items = (np.append(h, c) for h, c in zip(held, (key, node, items)))
        new = np.append(True, key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        first, first_items = node[head], items[head]
        many = ~new
        many[:-1] |= ~new[1:]
        out = many
        if held:
            run = int(new[1:].argmax()) + 1 if new[1:].any() else len(key)
            first[:run], first_items[:run] = held[3], held[4]
            many[0] |= held[5]
            out = many.copy()
            out[0] &= not held[5]
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, node, items, first, first_items)], ["key", "node", "items", "leader", "na"])
        held = key[-1], node[-1], items[-1], first[-1], first_items[-1], bool(many[-1])


def _checked(percent: int):
    """Leader rows (null b) come before their members: yields the linked pairs that share a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tuples = None, None, None
        for batch in batches:
            out = []
            for a, salt, b, values, sign in zip(*(batch.column(k).to_pylist() for k in range(5))):
                values = np.frombuffer(values, U64)
                if b is None:
                    at, held, tuples = (a, salt), values, np.frombuffer(sign, U64)
                elif at == (a, salt):
                    place = np.searchsorted(held, values)
                    common = int((held[np.minimum(place, len(held) - 1)] == values).sum())
                    if 100 * common >= percent * (len(values) + len(held) - common):
                        same = np.frombuffer(sign, U64) == tuples
                        if same[:SIDE].any() and same[SIDE:].any():
                            out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def likely(rows: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """The rows whose key is in of, and a few others: those that a sketch of SLOTS bits can't tell from them.

    A join on the key is to follow; the sketch spares it the shuffle of most other rows, and is all that
    is sent to the workers.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    words = of.select(slot.alias("slot")).distinct().groupBy(F.expr("slot div 64").alias("word_")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits_"))
    found = rows.withColumn("slot_", slot).withColumn("word_", F.expr("slot_ div 64")).join(F.broadcast(words), "word_")
    return found.filter("getbit(bits_, cast(slot_ % 64 AS int)) = 1").select(*rows.columns)


def buckets(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """key, node, items, leader, na: the tables' buckets of several of the classes (node, sign, items).

    Classes of a bucket share both tuples that key it. So tuples are dealt first, 2 * SIDE a class, and of its
    SIDE * SIDE tables only those are made whose tuples other classes have too.
    """
    kind, found = "key long, node long, items long", "key long, node long, items long, leader long, na long"
    alike = classes.select("node", "sign").mapInArrow(_tuples, kind).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_buckets, found)
    shared = alike.groupBy("node").agg(F.expr("bit_or(shiftleft(1L, cast(items AS int)))").alias("shared"))
    shared = scratch.keep(shared.filter(f"shared & {(1 << SIDE) - 1} > 0 AND shared >= {1 << SIDE}"))
    entries = likely(classes, "node", shared).join(shared, "node").select("node", "sign", "items", "shared").mapInArrow(_entries, kind)
    out = scratch.keep(entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_buckets, found))
    scratch.drop(shared)
    return out


def parts(pairs: DataFrame) -> DataFrame:
    """(node, parts): where the set of each node of pairs (a, b) is compared; a's set goes once to each SALT_ROWS partners."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    members = pairs.join(load, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b")
    heads = load.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    return heads.unionAll(members).groupBy("node").agg(F.collect_list(F.struct("a", "salt", "b")).alias("parts"))


def verified(sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, of sets with the parts that they take."""
    dealt = sets.select(F.explode("parts").alias("p"), "values", "sign").select("p.a", "p.salt", "p.b", "values", "sign")
    dealt = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return dealt.mapInArrow(_checked(percent), "a long, b long")


def early(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """token, node, root, items, place: each set's rarest shingles, one of which any similar set has too.

    Shingles are ordered by how many sets have one of the same COUNTERS-th of all hashes, then by hash;
    the counters are all that is sent to the driver and the workers.
    """
    given = likely(sets.select("node", "values"), "node", nodes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            slot = buffers(batch.column(0))[0].view(U64) % U64(COUNTERS)
            total += np.bincount(slot.astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)  # once a task
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["slot", "n"])

    table = np.zeros(COUNTERS, np.int64)
    counted = given.select("values").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(table)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                values, starts, stops = buffers(part.column(1))
                values, n = values.view(U64), (stops - starts) // 8
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((values, shared.value[(values % U64(COUNTERS)).astype(np.int64)], owner))
                place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                chosen = place < np.repeat(n - -(-percent * n // 100) + 1, n)
                rows = owner[chosen]
                columns = [pa.array(values[order][chosen].view(np.int64)), part.column(0).take(pa.array(rows)), pa.array(n[rows]), pa.array(place[chosen])]
                yield pa.RecordBatch.from_arrays(columns, ["token", "node", "items", "place"])

    found = given.mapInArrow(heads, "token long, node long, items long, place long")
    return found.join(nodes, "node").select("token", "node", "root", "items", "place")


def partners(node: np.ndarray, root: np.ndarray, items: np.ndarray, place: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets with a shingle in common that may be similar enough and have other roots; items ascend.

    What two sets have in common from this shingle on is at most what follows in the shorter rest. So
    the smaller set allows partners up to a size of its own, and its partner must allow it.
    """
    most = (items - place) * (100 + percent) // percent - items  # the largest partner that leaves room
    size = np.bincount(np.unique(root, return_inverse=True)[1])
    if len(size) < 2:
        return
    names = np.unique(root)
    main = root == names[size.argmax()]
    for own, others in ((np.flatnonzero(~main), np.arange(len(node))), (np.flatnonzero(main), np.flatnonzero(~main))):
        own = own[most[own] >= items[own]]
        if not len(own) or not len(others):
            continue
        low = np.searchsorted(others, own, "right")
        high = np.searchsorted(items[others], most[own], "right")
        count = np.maximum(high - low, 0)
        cuts = np.searchsorted(np.cumsum(count), np.arange(PAIRS, int(count.sum()) + PAIRS, PAIRS)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
            n = count[a:b]
            i = np.repeat(own[a:b], n)
            j = others[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            good = (root[i] != root[j]) & (most[j] >= items[i])
            i, j = i[good], j[good]
            if len(i):
                yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])


def _partners(percent: int):
    """Rows (token, node, root, items, place) by token, then items: pairs to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)

        def close(rows: np.ndarray):
            start = np.append(0, np.flatnonzero(np.diff(rows[0])) + 1)
            size = np.diff(np.append(start, rows.shape[1]))
            able = ((rows[3] - rows[4]) * (100 + percent) // percent - rows[3] >= rows[3]).astype(np.int8)
            # several roots, and a set that another of its size or more can be similar to
            open_ = (np.minimum.reduceat(rows[2], start) != np.maximum.reduceat(rows[2], start)) & (np.maximum.reduceat(able, start) > 0)
            for a, n in zip(start[open_].tolist(), size[open_].tolist()):
                for x, y in partners(*rows[1:, a : a + n], percent):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            yield from close(rows[:, :last]) if last else ()
            held = rows[:, last:]
        yield from close(held) if held.shape[1] else ()

    return run


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_id, head and name (MD5 of the text) of every row."""
    scratch, kind = Scratch(docs.sparkSession), dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", clean_text()).withColumn("name", F.md5("text"))
    rows = scratch.keep(slim.mapInArrow(_sets(size), f"doc_id {kind}, name string, n_shingles long, set_id binary, sign binary"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("one")
    classes = rows.filter("set_id is not null").groupBy("set_id").agg(one, F.first("sign").alias("sign"), F.first("n_shingles").alias("items"))
    classes = classes.select("set_id", F.col("one.doc_id").alias("first"), F.col("one.name").alias("name"), "sign", "items")
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))
    found = buckets(scratch, classes.select("node", "sign", "items"))
    # buckets with the same members are one
    bucket = found.groupBy("key").agg(F.min("leader").alias("leader"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    bucket = bucket.groupBy("leader", "n", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = scratch.keep(found.join(bucket, "key"))
    scratch.drop(found)
    near = f"100 * least(items, na) >= {percent} * greatest(items, na)"  # sizes that allow the threshold

    def paired(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))

    tested = scratch.keep(members.filter(f"node <> leader and {near}").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    # one text of each class; it is told by its MD5, and by its doc_id from most of its copies
    named = likely(classes.select("node", F.xxhash64("first", "name").alias("at"), "name", "sign"), "node", members.select("node"))
    wanted = scratch.keep(members.select("node").distinct().join(parts(tested), "node", "left").join(named, "node"))
    texts = slim.filter("name is not null").select(F.xxhash64("doc_id", "name").alias("at"), "name", "text")
    texts = likely(texts, "at", wanted).join(wanted, ["at", "name"])
    # both steps deal by the same columns, so texts are shuffled once, and sets not at all
    texts = texts.dropDuplicates(["at", "name"]).select("node", "sign", "parts", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets = shingles(batch.column(3).to_pylist(), size)
            lists = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(pa.binary()), batch.column(1), batch.column(2)], ["node", "values", "sign", "parts"])

    sets = scratch.keep(texts.mapInArrow(whole, "node long, values binary, sign binary, parts array<struct<a: long, salt: long, b: long>>"))
    scratch.drop(wanted)
    links = scratch.keep(verified(sets, percent))
    sets_of = sets.drop("parts")
    label = components(scratch, links)
    for turn in range(1, LEADERS + 1):
        named = members.select("key", "node", "items").join(label, "node", "left").select("key", "node", "items", F.coalesce("root", "node").alias("root"))
        mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        named = scratch.keep(named.join(mixed, "key"))
        if named.isEmpty():
            break
        if turn < LEADERS:
            head = named.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("items").alias("na"))).alias("head")).select("key", "head.a", "head.ra", "head.na")
            pairs = named.join(head, "key").filter(f"root <> ra and {near}").select("a", F.col("node").alias("b")).distinct()
        else:
            heads = early(scratch.keep(named.select("node", "root").distinct()), sets, percent)
            heads = heads.repartition("token").sortWithinPartitions("token", "items", "node")
            pairs = heads.mapInArrow(_partners(percent), "a long, b long").distinct()
        pairs = pairs.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).join(paired(tested), ["low", "high"], "left_anti")
        pairs = scratch.keep(pairs.select("a", "b"))
        tested = tested.unionAll(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        links = links.unionAll(scratch.keep(verified(likely(sets_of, "node", ends).join(parts(pairs), "node"), percent)))
        scratch.drop(named)
        label = components(scratch, links)
    named = classes.select("set_id", "first", "node").join(label, "node", "left").select("set_id", "first", F.coalesce("root", "node").alias("root"))
    # of classes with the same smallest doc_id, or none, the smallest by name stands for the component
    lowest = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", F.col("set_id").alias("head"))).alias("m"))
    result = scratch.keep(named.join(lowest, "root").select("set_id", F.col("m.first").alias("component"), F.col("m.head").alias("head")))
    scratch.drop(sets, members, classes)
    out = rows.select("doc_id", "n_shingles", "set_id", "name").join(result, "set_id", "left")
    out = out.withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "set_id", "head", "name")


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One row of each group, with all its columns: of the smallest doc_id, of repeats any one.

    Rows without words all stay. Of several texts of the smallest doc_id in a component, the one of the
    smallest name stays.
    """
    found = near_duplicates(docs, size, percent)
    bare = found.filter("set_id is null").select("doc_id", "name", F.lit(False).alias("one"))
    heads = found.filter("kept and set_id = head").groupBy("doc_id", "set_id").agg(F.min("name").alias("name")).select("doc_id", "name", F.lit(True).alias("one"))
    name, key, text, one = unused(docs.columns, "text_name", "kept_id", "kept_name", "one_row")
    chosen = bare.distinct().unionAll(heads).toDF(key, text, one)
    rows = docs.withColumn(name, F.md5(F.col("text").cast("binary")))
    rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col(key)) & F.col(name).eqNullSafe(F.col(text)))
    first = rows.filter(F.col(one)).dropDuplicates(["doc_id", name])
    return first.unionAll(rows.filter(~F.col(one))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), 4).drop("set_id", "head", "name")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_first(docs)
