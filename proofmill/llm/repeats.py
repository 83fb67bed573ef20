"""Operator 5: removal of repeated byte strings by suffix arrays.

A byte of a document goes if a string of LENGTH bytes covers it that also starts earlier: in a document
with a smaller doc_id, or in the same one before. Equal whole texts are one text, the smallest doc_id's;
a copy of it loses every byte if it is long enough.

Each string of LENGTH bytes names an anchor, the smallest hash of its substrings of GRAM bytes, so equal
strings name equal anchors wherever they stand. Consecutive strings with the same anchor place are a
segment, at most SPAN strings. Texts never travel for this: a segment is a row of four numbers, its
anchor, the SipHash of its bytes, the text's name and where it stands. Rows are dealt by anchor once,
and those whose anchor occurs once are done. Of equal segments all but the earliest are repeated. Only
where different segments share an anchor their bytes are fetched, one segment of each kind, concatenated
and indexed: two-stage sorting sorts directly the suffixes that are smaller than their successors and
induces the others by scans of the buckets of first bytes. Adjacent suffixes with a common prefix of
LENGTH bytes are equal strings. Arrays hold all segments of one anchor; anchors shared by over GROUP
kinds of segments (2.5 MB, for which an array takes 100 MB of memory) are resolved by string hashes that
are aggregated before the shuffle, so that no task holds an unbounded group.

Cases: a null text is empty; texts under LENGTH bytes stay as they are; very long texts are cut into
pieces of PIECE strings that overlap; a null doc_id comes after all others; rows with the same doc_id
and text are one document and get the same result; of rows with the same doc_id and other texts the one
with the smaller SHA-256 is earlier; an empty table gives no rows; extra columns are not read by
``find`` and kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, buffers, clean_text, map_rows, mix, prefix_hash, slices, span_hash, unused
from .suffixes import suffix_array, windows

LENGTH, GRAM, GROUP = 100, 50, 1 << 14
SPAN = LENGTH - GRAM + 1
#: Bytes of segments after which an array is closed; it holds one anchor's segments at least.
ARRAY_BYTES = 1 << 18
#: Strings whose anchors are found at a time.
PIECE = 1 << 20
#: A segment's place in one number: 25 bits of the text's name, 31 of the start, 1 if an equal one stands before it in the same text, 6 of the number of strings.
TAG, START, AGAIN, COUNT = 38, 7, 6, 63


def text_name(text: bytes | None) -> bytes:
    return hashlib.sha256(text or b"").digest()[:16]


def name_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)), 1, 16)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, number of strings, text) of the segments of all texts in data."""
    found = []
    for begin in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
        part = data[begin : begin + PIECE + LENGTH - 1]
        n = len(part) - LENGTH + 1
        at = np.arange(len(part) - GRAM + 1)
        value = span_hash(prefix_hash(part), at, at + GRAM)
        low = sliding_min((value & ~U64((1 << 22) - 1)) | at.astype(U64), SPAN)
        # strings that stand in one text
        a = int(np.searchsorted(stops, begin, "right"))
        b = int(np.searchsorted(starts, begin + n))
        first = np.maximum(starts[a:b], begin) - begin
        room = np.maximum(np.minimum(stops[a:b] - LENGTH + 1, begin + n) - begin - first, 0)
        owner = np.repeat(np.arange(a, b), room)
        string = np.arange(len(owner)) + np.repeat(first - (np.cumsum(room) - room), room)
        place = (low[string] & U64((1 << 22) - 1)).astype(np.int64)
        new = np.ones(len(string), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        found.append((value[place[head]].view(np.int64), string[head] + begin, np.diff(np.append(head, len(string))), owner[head]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found))


def repeated(parts: list[bytes]) -> np.ndarray:
    """Per segment, earliest first: bits of its strings that an earlier segment holds too."""
    size = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"".join(p.translate(_UP) + b"\0" for p in parts), np.uint8)
    owner = np.repeat(np.arange(len(parts)), size)
    ends = np.cumsum(size)
    keys = windows(text)
    order = suffix_array(text, LENGTH, keys)
    order = order[ends[owner[order]] - 1 - order >= LENGTH]  # strings within a segment
    masks = np.zeros(len(parts), np.int64)
    if len(order):
        # is the common prefix of adjacent suffixes long enough?
        same = np.append(False, np.ones(len(order) - 1, bool))
        for d in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            key = keys[order + d]
            same[1:] &= key[1:] == key[:-1]
        group = np.cumsum(~same) - 1
        low = np.full(group[-1] + 1, len(parts))
        np.minimum.at(low, group, owner[order])
        late = order[owner[order] > low[group]]
        np.bitwise_or.at(masks, owner[late], np.int64(1) << (late - (ends - size)[owner[late]]))
    return masks


#: Bytes plus one, so that 0 separates; 255 never occurs in UTF-8.
_UP = bytes(min(b + 1, 255) for b in range(256))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, text): each text's segments as (key, seg, short, at), once per task."""
    seen: set[bytes] = set()
    for batch in slices(batches):
        names = batch.column(0).to_pylist()
        fresh = np.array([not (n in seen or seen.add(n)) for n in names], bool)
        batch = batch.filter(pa.array(fresh))
        if not batch.num_rows:
            continue
        data, starts, stops = buffers(batch.column(1))
        anchor, first, count, owner = segments(data, starts, stops)
        if not len(anchor):
            continue
        whole = data.tobytes()
        parts = np.empty(len(first), object)
        parts[:] = [whole[a:b] for a, b in zip(first.tolist(), (first + count + (LENGTH - 1)).tolist())]
        seg = pd.util.hash_array(parts, categorize=False)
        name = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(-1, 2).astype(U64)
        short, tag = name[owner, 0], name[owner, 1] >> U64(64 - 25)
        # equal segments in one text: all but the first are repeated whatever stands elsewhere
        order = np.lexsort((first, seg, anchor, owner))
        again = np.zeros(len(first), bool)
        x, y = order[1:], order[:-1]
        again[x] = (seg[x] == seg[y]) & (anchor[x] == anchor[y]) & (owner[x] == owner[y])
        start = (first - starts[owner]).astype(U64)
        at = (tag << U64(TAG)) | (start << U64(START)) | (again.astype(U64) << U64(AGAIN)) | count.astype(U64)
        key = np.where(again, mix(short + start), anchor.view(U64))
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (key, seg, short, at)], ["key", "seg", "short", "at"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, seg, short, at) in this order those that share a key, without repeats, and those that are repeated anyway."""
    held, given = np.zeros((4, 0), np.int64), False
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns]) if batch.num_rows else np.zeros((4, 0), np.int64)
        again = (rows[3] >> AGAIN & 1) == 1
        out = [rows[:, again]]
        rows = np.concatenate([held, rows[:, ~again]], axis=1)
        new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)) if rows.shape[1] else np.zeros(0, bool)
        rows = rows[:, new]
        if rows.shape[1]:
            same = rows[0, 1:] == rows[0, :-1]
            many = np.append(False, same) | np.append(same, False)
            if held.shape[1]:
                many[0] |= given
            show = many.copy()
            show[0] &= not (held.shape[1] and given)
            out.append(rows[:, show])
            held, given = rows[:, -1:], bool(many[-1])
        rows = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["key", "seg", "short", "at"])


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, seg, ord, at) in this order: with null key and seg those that are repeated, with them the earliest of each kind where a key has several."""
    last, wait = None, np.zeros((4, 0), np.int64)  # key and seg of the last row; the only kind of its key so far
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns])
        again = (rows[3] >> AGAIN & 1) == 1
        late, rows = rows[:, again], rows[:, ~again]
        kinds = rows[:, :0]
        if rows.shape[1]:
            before = np.concatenate([[last[0] if last else rows[0, 0]], rows[0, :-1]]), np.concatenate([[last[1] if last else rows[1, 0]], rows[1, :-1]])
            new_key = rows[0] != before[0]
            new = new_key | (rows[1] != before[1])
            if not last:
                new_key[0], new[0] = True, True
            run = np.cumsum(new_key)  # 0: the last batch's last key goes on
            n = np.bincount(run, new, minlength=run[-1] + 1).astype(np.int64)
            open_ = last is not None
            n[0] += open_
            kinds = rows[:, new & (n[run] > 1)]
            if wait.shape[1] and n[0] > 1:
                kinds = np.concatenate([wait, kinds], axis=1)
            if run[-1]:
                wait = rows[:, new & (run == run[-1])] if n[-1] == 1 else wait[:, :0]
            elif n[0] > 1:
                wait = wait[:, :0]
            late = np.concatenate([late, rows[:, ~new]], axis=1)
            last = rows[0, -1], rows[1, -1]
        none = pa.nulls(late.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(kinds[0]), none]), pa.concat_arrays([pa.array(kinds[1]), none]), pa.array(np.append(kinds[2], late[2])), pa.array(np.append(kinds[3], late[3]))], ["key", "seg", "ord", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, text, wanted): the segments' bytes."""
    for batch in slices(batches):
        out = []
        for number, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            for w in wanted:
                start, count = w["at"] >> START & 0x7FFFFFFF, w["at"] & COUNT
                out.append((w["key"], number, w["at"], text[start : start + count - 1 + LENGTH]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "ord", "at", "bytes"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ord, at, bytes) in this order: the bits of strings that are earlier elsewhere."""
    held: list[tuple] = []
    size = 0

    def close(rows: list[tuple]) -> pa.RecordBatch:
        masks = repeated([r[3] for r in rows])
        some = np.flatnonzero(masks)
        return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in some], pa.int64()), pa.array([rows[k][2] for k in some], pa.int64()), pa.array(masks[some])], ["ord", "at", "mask"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:3] == row[:3]:  # of repeated rows
                continue
            if size > ARRAY_BYTES and held[-1][0] != row[0]:
                yield close(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield close(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            rows = zip(*(c.to_pylist() for c in batch.slice(begin, 1024).columns))
            flat = [(hashlib.blake2b(b[k : k + LENGTH], digest_size=16).digest(), o, at, k) for o, at, b in rows for k in range(len(b) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32()))], ["string", "ord", "at", "bit"])


def covered(n: int, found: list) -> list[int]:
    """Removed byte spans [start, end, ...] from (at, mask) of a text's segments; a null mask is all of them."""
    gone = np.zeros(n + 1, np.int64)
    at = np.array([f["at"] for f in found], np.int64)
    start, count = at >> START & 0x7FFFFFFF, at & COUNT
    mask = np.array([-1 if f["mask"] is None else f["mask"] for f in found], np.int64)
    whole = mask == -1
    np.add.at(gone, start[whole], 1)
    np.add.at(gone, (start + count + (LENGTH - 1))[whole], -1)
    if not whole.all():
        bits = (mask[~whole, None] >> np.arange(SPAN)) & 1
        string = (start[~whole, None] + np.arange(SPAN))[bits == 1]
        np.add.at(gone, string, 1)
        np.add.at(gone, string + LENGTH, -1)
    step = np.diff(np.concatenate([[0], (np.cumsum(gone)[:-1] > 0).astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1).ravel().tolist()


def left(text: bytes, found: list | None) -> tuple[list[int], bytes]:
    """Removed spans and what is left of a text."""
    cut = covered(len(text), found) if found else []
    edges = [0, *cut, len(text)]
    return cut, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if cut else text


def removals(docs: DataFrame) -> DataFrame:
    """first (smallest doc_id), name and found (segments with repeated strings, or null) of every distinct text."""
    scratch = Scratch(docs.sparkSession)
    slim = docs.select("doc_id", clean_text()).withColumn("name", name_of(F.col("text")))
    texts = slim.groupBy("name").agg(F.min("doc_id").alias("first")).orderBy(F.col("first").isNull(), "first", "name")
    word = F.conv(F.hex(F.substring("name", 1, 8)), 16, -10).cast("long")
    tag = F.conv(F.hex(F.substring("name", 9, 4)), 16, 10).cast("long")
    texts = scratch.keep(texts.select("name", "first", F.monotonically_increasing_id().alias("ord"), word.alias("short"), F.shiftright(tag, 7).alias("tag")))
    rows = slim.filter(F.octet_length("text") >= LENGTH).select("name", "text").mapInArrow(_rows, "key long, seg long, short long, at long")
    dealt = rows.repartition("key").sortWithinPartitions("key", "seg", "short", "at")
    shared = scratch.keep(dealt.mapInArrow(_shared, "key long, seg long, short long, at long"))
    known = shared.withColumn("tag", F.shiftright("at", TAG)).join(texts.select("short", "tag", "ord"), ["short", "tag"]).select("key", "seg", "ord", "at")
    known = known.repartition("key").sortWithinPartitions("key", "seg", "ord", "at")
    marked = scratch.keep(known.mapInArrow(_earliest, "key long, seg long, ord long, at long"))
    scratch.drop(shared)
    kinds = marked.filter("key is not null").select("key", "ord", "at")
    wanted = kinds.groupBy("ord").agg(F.collect_list(F.struct("key", "at")).alias("wanted")).join(texts.select("ord", "first", F.col("name").alias("text_name")), "ord")
    cut = slim.join(wanted, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("name") == F.col("text_name"))).select("ord", "text", "wanted")
    parts = scratch.keep(cut.mapInArrow(_cut, "key long, ord long, at long, bytes binary"))
    big = scratch.keep(kinds.groupBy("key").count().filter(F.col("count") > GROUP).select("key"))
    small = parts.join(big, "key", "left_anti").repartition("key").sortWithinPartitions("key", "ord", "at")
    masks = scratch.keep(small.mapInArrow(_arrays, "ord long, at long, mask long"))
    found = marked.filter("key is null").select("ord", "at", F.lit(None).cast("long").alias("mask")).unionAll(masks)
    if not big.isEmpty():
        strings = scratch.keep(parts.join(big, "key", "left_semi").select("ord", "at", "bytes").mapInArrow(_strings, "string binary, ord long, at long, bit int"))
        place = F.struct("ord", "at", "bit")
        low = strings.groupBy("string").agg(F.min(place).alias("low"))
        late = strings.withColumn("own", place).join(low, "string").filter("own > low").groupBy("ord", "at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        found = found.unionAll(scratch.keep(late))
        scratch.drop(strings)
    scratch.drop(parts, big)
    found = found.groupBy("ord").agg(F.collect_list(F.struct("at", "mask")).alias("found"))
    done = scratch.keep(texts.join(found, "ord", "left").select("first", "name", "found"))
    scratch.drop(marked, masks, texts)
    return done


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    done = removals(docs).select("first", F.col("name").alias("text_name"), "found", F.lit(True).alias("own"))
    rows = docs.select("doc_id", clean_text()).withColumn("name", name_of(F.col("text")))
    rows = rows.join(done, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("name") == F.col("text_name")), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, found, own in zip(*(c.to_pylist() for c in batch.columns[1:])):
                text = text or b""
                cut, kept = left(text, found) if own or len(text) < LENGTH else ([0, len(text)], b"")
                out.append((len(text), len(text) - len(kept), len(cut) // 2, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", "found", "own").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without repeated strings; a row of which nothing is left goes, one that was empty stays.

    A UTF-8 character that a cut splits goes as a whole.
    """
    name, first, text_name, found, own = unused(docs.columns, "name", "first", "text_name", "found", "own")
    done = removals(docs).select(F.col("first").alias(first), F.col("name").alias(text_name), F.col("found").alias(found), F.lit(True).alias(own))
    rows = docs.withColumn(name, name_of(F.col("text")))
    rows = rows.join(done, F.col("doc_id").eqNullSafe(F.col(first)) & (F.col(name) == F.col(text_name)), "left")
    rows = rows.filter(F.col(own) | (F.coalesce(F.octet_length("text"), F.lit(0)) < LENGTH))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    place = docs.columns.index("text") if "text" in docs.columns else next(k for k, c in enumerate(docs.columns) if c.lower() == "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, docs_text):
            texts, stay = batch.column(place).to_pylist(), np.ones(batch.num_rows, bool)
            for k, segments_ in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if segments_:
                    cut, kept = left(texts[k].encode(), segments_)
                    if cut:
                        texts[k], stay[k] = kept.decode("utf-8", "ignore"), bool(kept)
            out = batch.columns[:-1]
            out[place] = pa.array(texts, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(out, batch.schema.names[:-1]).filter(pa.array(stay))

    docs_text = docs.columns[place]
    return map_rows(rows.select(*columns, F.col(found)), put, docs.columns, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return find(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus."""
    return deduplicated(docs)
