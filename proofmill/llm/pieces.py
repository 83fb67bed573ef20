"""Operator 9: SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into words, a run of space marks and what follows it, as no piece reaches
beyond one; this is checked when a vocabulary is read. The batch's distinct words that the worker has
not encoded before are concatenated, other occurrences take the same ids. The concatenated text is
indexed by a suffix array in blocks of at most BLOCK bytes, every piece of the vocabulary is found in
it by binary search as a range of occurrences, and the occurrences are sorted by position as edges
over the words. The vocabulary is of the merging kind, so edges are relaxed in the order of the
pieces' scores, leftmost first: an edge is taken if just two symbols fill it at that time. All words
of a block are relaxed in lockstep, one edge of each a round. A symbol without a piece becomes its
bytes' pieces. Decoding joins pieces and bytes and takes the first space mark off.

The vocabulary file is read on the driver and broadcast; its size does not depend on the data. Words
that a worker has encoded before are remembered, until they are more than REMEMBERED.

Cases: a null text has null ids; an empty one has none; a space mark in a text decodes to a space;
bytes that are not UTF-8 count as replacement characters; a very long text is a batch of its own; a
word of over LONG characters is relaxed alone with a heap, which takes about 300 bytes a byte of it;
of edges with the same score the leftmost comes first; repeated rows are encoded each; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import clean_text, slices
from .suffixes import Patterns, suffix_array, windows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 600_000
#: Bytes of words that one suffix array covers, characters of words that are relaxed at a time, and characters of a word that is relaxed in lockstep.
BLOCK, TOGETHER, LONG = 1 << 20, 1 << 18, 128
#: Bytes of text that are encoded at a time.
TEXT_BYTES = 4 << 20
MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_UP = bytes(min(b + 1, 255) for b in range(256))
_NONE = np.iinfo(np.int64).max


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), starts[1], ..."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Vocabulary:
    """A model file's pieces, scores and byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.texts = [model.id_to_piece(i) for i in ids]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        self.bytes = {int(self.texts[i][3:5], 16): i for i in ids if model.is_byte(i)}
        usable = [i for i in ids if not special[i] and not model.is_byte(i)]
        if len(self.bytes) != 256 or not all(_WORD.fullmatch(self.texts[i]) for i in usable):
            raise ValueError("needs a vocabulary with byte pieces and without pieces of several words")
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.special = {i for i in ids if special[i]}
        coded = sorted((self.texts[i].encode().translate(_UP), i) for i in usable)
        self.ids = np.array([i for _, i in coded])
        self.patterns = Patterns([c for c, _ in coded])
        self.chars = np.array([len(self.texts[i]) for i in self.ids])
        self.widest = int(self.chars.max())
        self.scores = np.array([model.get_score(i) for i in ids])
        # pieces by falling score; equal scores share a place, so that the leftmost edge comes first
        self.place = np.unique(-self.scores[self.ids], return_inverse=True)[1]
        self.byte_ids = np.array([self.bytes[b] for b in range(256)])
        # what each id decodes to
        said = [b"" if i in self.special else self.byte_of.get(i) or self.texts[i].replace(MARK, " ").encode() for i in ids]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_n = np.array([len(s) for s in said], np.int64)
        self.said_at = np.cumsum(self.said_n) - self.said_n
        self.names = [str(i) for i in ids]

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece's number in ids) of all occurrences in words joined by 0, sorted by position."""
        depth, starts, pieces = self.patterns.depth, [], []
        for begin in range(0, len(text), BLOCK):  # what begins in a block may end in the next one
            part = np.append(text[begin : begin + BLOCK + depth], np.uint8(0))
            keys = windows(part)
            order = suffix_array(part, depth + 1, keys)
            low, high = self.patterns.find(keys, order)
            count = high - low
            start, piece = order[ragged(low, count)], np.repeat(np.arange(len(count)), count)
            inside = start < BLOCK
            # one number an edge: numbers sort faster than places do
            both = np.sort((start[inside] << 32) | piece[inside])
            starts.append((both >> 32) + begin)
            pieces.append(both & 0xFFFFFFFF)
        return np.concatenate(starts), np.concatenate(pieces)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids by word); each word gets a mark in front."""
        raw = np.frombuffer((MARK + MARK.join(words)).encode(), np.uint8)
        head = (raw & 0xC0) != 0x80
        byte_at = np.flatnonzero(head)
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(n) - n
        size = np.diff(np.append(byte_at[first], len(raw)))
        # a 0 after each word, all other bytes one higher
        place = np.arange(len(raw)) + np.repeat(np.arange(len(words)), size)
        text, start_of = np.zeros(len(raw) + len(words), np.uint8), np.zeros(len(raw) + len(words), np.int64)
        text[place] = raw + np.uint8(1)
        start_of[place] = np.cumsum(head) - 1
        byte_at = np.append(byte_at, len(raw))
        start, piece = self.edges(text)
        edge_char = start_of[start]
        cut = np.append(0, np.cumsum(np.bincount(edge_char, minlength=len(byte_at) - 1)))
        # the boundary after each symbol: characters per symbol, 0 where none begins
        taken = np.zeros(len(byte_at) - 1, np.int64)
        found = np.full(len(byte_at) - 1, -1, np.int64)
        by = np.argsort(n, kind="stable")
        lengths = n[by]
        lo = 0
        while lo < len(by):
            length = int(lengths[lo])
            hi = int(np.searchsorted(lengths, length, "right"))
            if length > LONG:
                for w in by[lo:hi].tolist():
                    a, b = cut[first[w]], cut[first[w] + length]
                    self._relax_long(int(first[w]), length, edge_char[a:b], piece[a:b], taken, found)
            else:
                step = max(1, TOGETHER // length)
                for k in range(lo, hi, step):
                    self._relax(first[by[k : min(k + step, hi)]], length, cut, edge_char, piece, taken, found)
            lo = hi
        symbol = np.flatnonzero(taken)
        known = found[symbol] >= 0
        # a symbol without a piece is one character: its bytes' pieces
        count = np.where(known, 1, byte_at[symbol + 1] - byte_at[symbol])
        at = ragged(byte_at[symbol], count)
        ids = np.where(np.repeat(known, count), self.ids[np.repeat(found[symbol], count)], self.byte_ids[raw[at]])
        total = np.append(0, np.cumsum(count))[np.searchsorted(symbol, np.append(first, len(byte_at) - 1))]
        return ids, np.diff(total)

    def _relax(self, first: np.ndarray, length: int, cut: np.ndarray, edge_char: np.ndarray, piece: np.ndarray, taken: np.ndarray, found: np.ndarray) -> None:
        """Relaxes words of the same number of characters in lockstep; writes where symbols begin, their length and piece."""
        words, wide = len(first), min(self.widest, length) + 1
        # edges as a table: by place in the word, word and number of characters
        low, high = cut[first], cut[first + length]
        rows = ragged(low, high - low)
        owner = np.repeat(np.arange(words), high - low)
        which = np.full((length, words, wide), -1, np.int32)
        which[edge_char[rows] - first[owner], owner, self.chars[piece[rows]]] = piece[rows]
        after = np.repeat(np.arange(1, length + 2, dtype=np.int32)[:, None], words, axis=1)  # where the next symbol begins
        before = np.repeat(np.arange(-1, length, dtype=np.int32)[:, None], words, axis=1)
        # of the symbol that begins here and the next one: their edge's place and where it stands
        best = np.full((length, words), _NONE, np.int64)
        if wide > 2:
            best[:-1] = self._rank(which[:-1, :, 2], np.arange(length - 1)[:, None])
        live = np.arange(words)
        for _ in range(length - 1):
            least = best.min(axis=0)
            go = least < _NONE
            if not go.any():
                break
            if 2 * np.count_nonzero(go) < len(go):  # words that are done stay behind
                self._settle(first[live[~go]], length, after[:, ~go], which, live[~go], taken, found)
                best, after, before, live, least = best[:, go], after[:, go], before[:, go], live[go], least[go]
                go = np.ones(len(live), bool)
            w = np.flatnonzero(go)
            at = least[w] & 0xFFFF
            middle = after[at, w]
            end = after[middle, w]
            after[at, w] = end
            best[middle, w] = _NONE
            before[end, w] = at
            best[at, w] = _NONE
            right = end < length
            a, e, x = at[right], end[right], w[right]
            best[a, x] = self._edge(which, a, after[e, x] - a, live[x], wide)
            left = at > 0
            e, x = end[left], w[left]
            a = before[at[left], x]
            best[a, x] = self._edge(which, a, e - a, live[x], wide)
        self._settle(first[live], length, after, which, live, taken, found)

    def _rank(self, piece: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, (self.place[piece] << 16) | at, _NONE)

    def _edge(self, which: np.ndarray, at: np.ndarray, chars: np.ndarray, word: np.ndarray, wide: int) -> np.ndarray:
        return self._rank(np.where(chars < wide, which[at, word, np.minimum(chars, wide - 1)], -1), at)

    @staticmethod
    def _settle(first: np.ndarray, length: int, after: np.ndarray, which: np.ndarray, live: np.ndarray, taken: np.ndarray, found: np.ndarray) -> None:
        at, word = np.zeros(len(first), np.int64), np.arange(len(first))
        while len(word):
            end = after[at, word]
            place = first[word] + at
            taken[place] = end - at
            found[place] = which[at, live[word], end - at]
            more = end < length
            at, word = end[more], word[more]

    def _relax_long(self, first: int, length: int, edge_char: np.ndarray, piece: np.ndarray, taken: np.ndarray, found: np.ndarray) -> None:
        cut = np.searchsorted(edge_char, np.arange(first, first + length + 1))
        chars, place = self.chars[piece], self.place[piece]
        end, before = np.arange(1, length + 2), np.arange(-1, length)

        def edge(a: int, b: int) -> int:
            inside = np.flatnonzero(chars[cut[a] : cut[a + 1]] == b - a)
            return int(cut[a] + inside[0]) if len(inside) else -1

        two = np.flatnonzero(chars == 2)
        heap = list(zip(place[two].tolist(), (edge_char[two] - first).tolist(), (edge_char[two] - first + 2).tolist()))
        heapq.heapify(heap)

        def offer(a: int, b: int) -> None:
            if b - a <= self.widest and (k := edge(a, b)) >= 0:
                heapq.heappush(heap, (int(place[k]), a, b))

        while heap:
            _, a, b = heapq.heappop(heap)
            middle = int(end[a])
            if middle <= a or middle >= b or end[middle] != b:
                continue
            end[a], end[middle] = b, -1
            if b < length:
                before[b] = a
                offer(a, int(end[b]))
            if a:
                offer(int(before[a]), b)
        a = 0
        while a < length:
            b = int(end[a])
            taken[first + a], found[first + a] = b - a, -1
            if (k := edge(a, b)) >= 0:
                found[first + a] = piece[k]
            a = b

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, number of bytes by id)."""
        count = self.said_n[ids]
        return self.said[ragged(self.said_at[ids], count)], count


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes texts and remembers words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.flat, self.count, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def words(text: str) -> list[str]:
        """Words without their first mark."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids by text)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [self.words(t) if t else [] for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if new := self.known.new:
            ids, count = self.vocabulary.learn(new)
            self.known.new = []
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.count = np.concatenate([self.count, count])
            self.start = np.cumsum(self.count) - self.count
        count = self.count[which]
        ids = self.flat[ragged(self.start[which], count)]
        total = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(n))]
        return ids, np.diff(total)


def decoded_text(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of one row's ids."""
    said, count = vocabulary.decoded(ids)
    # bytes that are not UTF-8 stand alone between pieces
    text = said.tobytes().decode("utf-8", "replace")
    return text.removeprefix(" ")


def _same(vocabulary: Vocabulary, texts: list[str | None], ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Does each text equal what its ids decode to?"""
    said, size = vocabulary.decoded(ids)
    begin = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
    whole = said.tobytes()
    out = np.ones(len(texts), bool)
    for k, text in enumerate(texts):
        if text:
            got = whole[begin[k] : begin[k + 1]]
            out[k] = got[:1] == b" " and got[1:] == text.encode()
    return out


def _encoded(shared, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        names = shared.value.names
        for batch in slices(batches, limit=TEXT_BYTES):
            texts = [None if t is None else t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            ids, count = encoder.encode(texts)
            gone = np.array([t is None for t in texts], bool)
            same = pa.array(_same(shared.value, texts, ids, count), mask=gone)
            stop = np.cumsum(count)
            if not digests:
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(gone))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, same], ["doc_id", "ids", "round_trip"])
                continue
            said = list(map(names.__getitem__, ids.tolist()))
            shas = [None if g else hashlib.sha256(",".join(said[a:b]).encode()).hexdigest() for g, a, b in zip(gone.tolist(), (stop - count).tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(shas, pa.string()), same], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids and round_trip (does the decoded text equal the text?) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return docs.select("doc_id", clean_text()).mapInArrow(_encoded(shared, False), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [None if i is None else decoded_text(shared.value, np.array(i, np.int64)) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the comma-joined ids) and round_trip of every row, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return docs.select("doc_id", clean_text()).mapInArrow(_encoded(shared, True), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digests(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, which decode to their texts."""
    return encode(docs)
