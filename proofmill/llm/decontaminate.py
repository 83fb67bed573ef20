"""Operator 3: benchmark decontamination by suffix arrays over the training texts.

Words are runs of letters, digits and non-ASCII bytes after lower-casing A-Z, known by their SipHash.
The training texts' shards are slices of a partition's rows: each gets a suffix array of all its word
positions, and every suffix of every benchmark item is searched in it by bisection, word by word. A
window is WINDOW consecutive item words (a shorter item is one window as a whole), so a suffix that
reaches WINDOW words has all places of its window as a range of the array; their words are compared as
bytes. Windows that follow each other both in the document and in the item are one longest verbatim
match, with its length and its place in either. A document's words inside matches are hit.

Training texts are never shuffled. The benchmark is read in blocks of at most BLOCK_BYTES of text (or
one item) and one block is broadcast at a time. With more than one block, each block is a pass over the
texts whose hits are written before the next block is read, and the passes' hits are merged by row.

Cases: null and empty texts have no words; a null item_id is an item that is named by an empty string;
items without words have no windows; of longest matches the earliest in the document, then the smallest
item_id counts; repeated rows are judged each; a very long text is a shard of its own; empty tables give
no rows or no hits; extra columns are not read by ``find`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, clean_text, map_rows, slices, word_hashes
from .suffixes import bisect

WINDOW, BLOCK_BYTES = 10, 4 << 20
#: Bytes of a shard: so many times the block's, within these bounds.
SHARD, LEAST, MOST = 8, 2 << 20, 16 << 20
#: Bytes that part words.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, longest_at long, longest_from long, spans array<int>"
_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_item", "longest_at", "longest_from", "spans"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]


class Words:
    """The words of several texts: hashes, bytes, number of the text and first place by text."""

    def __init__(self, texts: list[bytes | None]):
        self.hash, self.count, words = word_hashes(texts, SEPARATORS)
        self.hash |= U64(1)  # 0 is beyond a text
        self.bytes = np.empty(len(words), object)
        self.bytes[:] = words
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        self.begin = np.cumsum(self.count) - self.count
        self.end = (self.begin + self.count)[self.owner]

    def at(self, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.where(places < ends, self.hash[np.minimum(places, len(self.hash) - 1)], U64(0))


def suffix_array(words: Words, depth: int) -> np.ndarray:
    """Word positions in the order of the first depth words from there within their text; a word more at a time of those that still tie."""
    order = np.argsort(words.hash)
    now = words.hash[order]
    if not len(order):
        return order
    tied, group = np.arange(len(order)), np.append(0, np.cumsum(now[1:] != now[:-1]))
    for d in range(1, depth):
        many = (np.bincount(group, minlength=group[-1] + 1)[group] > 1) & (now > 0)
        tied, group = tied[many], group[many]
        if not len(tied):
            break
        part = order[tied]
        now = words.at(part + d, words.end[part])
        by = np.lexsort((now, group))
        order[tied] = part[by]
        now, group = now[by], group[by]
        group = np.append(0, np.cumsum((group[1:] != group[:-1]) | (now[1:] != now[:-1])))
    return order


class Items:
    """A block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.ids = window, [i for i, _ in items]
        self.bytes = sum(len(t or b"") for _, t in items)
        self.words = w = Words([t for _, t in items])
        # words that a window from each place has; 0 where none begins
        place = np.arange(len(w.hash))
        n = w.count[w.owner] if len(place) else place
        self.length = np.where(w.end - place >= window, window, np.where((place == w.begin[w.owner]) & (n < window), n, 0)) if len(place) else place

    def search(self, texts: Words) -> tuple[np.ndarray, np.ndarray]:
        """All (item place, text place) of windows in a shard."""
        none = np.zeros(0, np.int64)
        mine = self.words
        if not len(texts.hash) or not len(mine.hash):
            return none, none
        order = suffix_array(texts, self.window)
        place = np.arange(len(mine.hash))
        low, high = np.zeros(len(place), np.int64), np.full(len(place), len(order))
        found = []
        alive = place
        for d in range(self.window):
            want = mine.at(alive + d, mine.end[alive])
            alive, want = alive[want > 0], want[want > 0]
            column = texts.at(order + d, texts.end[order])
            a = bisect(column, want, low[alive], high[alive], False)
            high[alive] = bisect(column, want, a, high[alive], True)
            low[alive] = a
            alive = alive[low[alive] < high[alive]]
            found.append(alive[self.length[alive] == d + 1])
            if not len(alive):
                break
        found = np.concatenate(found)
        count = high[found] - low[found]
        item = np.repeat(found, count)
        text = order[np.repeat(low[found] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        right = np.ones(len(item), bool)
        for d in range(self.window):  # equal hashes, equal words?
            inside = np.flatnonzero(self.length[item] > d)
            right[inside] &= mine.bytes[item[inside] + d] == texts.bytes[text[inside] + d]
        return item[right], text[right]

    def matches(self, texts: Words) -> list[np.ndarray]:
        """Longest verbatim matches: text, place in the text, item, place in the item, words."""
        item, text = self.search(texts)
        order = np.lexsort((text, text - item))
        item, text = item[order], text[order]
        new = np.ones(len(item), bool)
        new[1:] = (text[1:] != text[:-1] + 1) | (item[1:] != item[:-1] + 1) | (self.words.owner[item[1:]] != self.words.owner[item[:-1]]) | (texts.owner[text[1:]] != texts.owner[text[:-1]])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(item))) - 1 + self.length[item[head]]
        at, number = texts.owner[text[head]], self.words.owner[item[head]]
        return [at, text[head] - texts.begin[at], number, item[head] - self.words.begin[number], size]


def merged(spans_: list[int]) -> list[int]:
    """Overlapping and touching spans as one."""
    out: list[int] = []
    for a, b in sorted(zip(spans_[::2], spans_[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def shard_hits(items: Items, texts: list[bytes | None]) -> tuple[np.ndarray, dict[int, list[tuple]]]:
    """Number of words by text, and for texts with matches these as (place, words, item_id, place in the item)."""
    words = Words(texts)
    found: dict[int, list[tuple]] = {}
    for text, at, item, start, size in zip(*(c.tolist() for c in items.matches(words))):
        found.setdefault(text, []).append((at, size, items.ids[item], start))
    return words.count, found


def summary(n: int, found: list[tuple] | None) -> tuple:
    if not found:
        return (n, 0, 0, _NO_ITEMS, False, 0, None, None, None, [])
    spans = merged([x for at, size, _, _ in found for x in (at, at + size)])
    ids = sorted({i for _, _, i, _ in found})
    at, size, item, start = min(found, key=lambda m: (-m[1], m[0], m[2], m[3]))
    return (n, sum(spans[1::2]) - sum(spans[::2]), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), True, size, item, at, start, spans)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items, block by block, repeated rows once; a block holds block_bytes of text on average at most."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        found = part.toArrow()
        if found.num_rows or not k:
            yield sorted(zip(*(found.column(c).to_pylist() for c in ("item_id", "text"))))


def _shards(items: Items, batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    return slices(batches, column, min(max(SHARD * items.bytes, LEAST), MOST))


MATCH = "array<struct<at: int, size: int, item: string, start: int>>"
_MATCH = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("item", pa.string()), ("start", pa.int32())]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the longest match (longest, longest_item, longest_at, longest_from) and spans of hit words of every row."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", clean_text())
    every = blocks(benchmark, block_bytes)
    first, second = next(every), next(every, None)
    if second is None:
        shared = spark.sparkContext.broadcast(Items(first, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _shards(shared.value, batches):
                n, found = shard_hits(shared.value, batch.column(1).to_pylist())
                rows = [summary(w, found.get(k)) for k, w in enumerate(n.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], ["doc_id", *_NAMES])

        return slim.mapInArrow(run, f"doc_id {kind}, {RESULT}")
    scratch = Scratch(spark)
    slim = slim.withColumn("name", F.sha2(F.coalesce("text", F.lit(b"")), 256))
    passes: list[DataFrame] = []
    block: list | None = first
    while block is not None:
        shared = spark.sparkContext.broadcast(Items(block, window))

        def hits(batches: Iterator[pa.RecordBatch], shared=shared, every_row=not passes) -> Iterator[pa.RecordBatch]:
            for batch in _shards(shared.value, batches):
                n, found = shard_hits(shared.value, batch.column(1).to_pylist())
                rows = [[dict(zip(("at", "size", "item", "start"), m)) for m in found.get(k, [])] for k in range(batch.num_rows)]
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(rows, _MATCH)], ["doc_id", "name", "n_words", "matches"])
                yield out if every_row else out.filter(pa.array([bool(r) for r in rows], pa.bool_()))

        passes.append(scratch.keep(slim.mapInArrow(hits, f"doc_id {kind}, name string, n_words long, matches {MATCH}")))
        shared.destroy()
        block, second = (second, None) if second is not None else (next(every, None), None)
    # a row may be repeated; the first pass has all of them, the others one of each text and doc_id at least
    more = reduce(DataFrame.unionAll, passes[1:]).dropDuplicates(["doc_id", "name", "matches"])
    more = more.groupBy("doc_id", "name").agg(F.flatten(F.collect_list("matches")).alias("more")).toDF("other_id", "other_name", "more")
    joined = passes[0].join(more, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("name") == F.col("other_name")), "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [summary(r["n_words"], [tuple(m.values()) for m in (r["matches"] or []) + (r["more"] or [])]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], ["doc_id", *_NAMES])

    return joined.select("doc_id", "n_words", "matches", "more").mapInArrow(finish, f"doc_id {kind}, {RESULT}")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without a hit, with all their columns; block after block, each but the last in a pass that is written."""
    spark, scratch, kept = docs.sparkSession, None, []
    every = blocks(benchmark, block_bytes)
    block, later = next(every), next(every, None)
    place = next(k for k, c in enumerate(docs.columns) if c.lower() == "text")
    while True:
        shared = spark.sparkContext.broadcast(Items(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in _shards(shared.value, batches, "text"):
                _, found = shard_hits(shared.value, batch.column(place).cast(pa.binary()).to_pylist())
                yield batch.filter(pa.array([k not in found for k in range(batch.num_rows)], pa.bool_()))

        docs = map_rows(docs, run, docs.columns, docs.schema)
        if later is None:
            return docs
        scratch = scratch or Scratch(spark)
        docs = scratch.keep(docs)
        scratch.drop(*kept)
        kept = [docs]
        shared.destroy()
        block, later = later, next(every, None)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", *_NAMES[:5])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    from .common import table

    return clean(docs, table(spark, sf_dir, "benchmark"))
