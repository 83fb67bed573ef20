"""Operator 2: language identification by interpolated Kneser-Ney character models.

For every language of a labelled row that has a text an interpolated Kneser-Ney model of order ORDER
is estimated from a bounded sample: at most SAMPLE texts per language, chosen by a hash of doc_id
whatever their length; a text of over SAMPLE_BYTES bytes counts with whole pieces that stand evenly
over all of it. A language whose texts have no doc_id is learned from its shortest ones: the shortest
and further ones up to LONG_BYTES together. Languages are learned and
scored in blocks; the models of a block share one sorted array of n-gram hashes per order, with a
row of log probabilities, and one of context hashes with back-off weights. All blocks share one
alphabet, so that their scores compare. A whole text's score per language is its cross-entropy in
nats per character; the lowest wins. A text is rejected if that lowest exceeds the language's
threshold, calibrated on sample texts kept out of the estimates (of fewer than five texts none is
kept out), or if it has no letter.

Characters: lower-cased letters; everything else is one separator, and a run of separators counts
once. Inputs of a prediction are the text alone.

Cases: null or empty text, or one without a letter: ``und``, score 0, rejected; no labelled row: all
``und``; two languages with equal cross-entropy: the first by name; repeated rows are predicted each;
an empty table gives no rows; extra columns are not read by ``identify``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, buffers, clean_text, map_rows, mix, slices, spread

ORDER, SAMPLE, SAMPLE_BYTES, PIECE, LONG_BYTES = 4, 200, 1 << 16, 1 << 10, 1 << 20
#: Languages of a block, and bytes of their samples beyond which it ends; they bound what is in memory at once.
BLOCK, BLOCK_BYTES = 32, 8 << 20
PAD = ORDER - 1
_BASE = U64(0x100000001B3)
RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


class Alphabet:
    """Code point to character number: 0 separator, 1 a letter not seen in training."""

    def __init__(self, texts: list[str]):
        table = np.zeros(0x110000, np.uint32)
        letters = [c for c in range(0x110000) if chr(c).isalpha()]
        table[letters] = 1
        seen = {c.lower() for t in texts for c in set(t) if c.isalpha() and len(c.lower()) == 1}
        number = {c: i for i, c in enumerate(sorted(seen), 2)}
        for c in letters:
            if (low := chr(c).lower()) in number:
                table[c] = number[low]
        self.table, self.size = table, len(number) + 2


def grams(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Character numbers of all texts, each after PAD separators; positions that count; their text; letters per text.

    data are UTF-8 bytes; characters that are no valid UTF-8 count as separators.
    """
    n = len(starts)
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(points) == int(((data & 0xC0) != 0x80).sum()):
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        starts, stops = before[starts], before[stops]
    else:  # invalid UTF-8: text by text
        each = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for a, b in zip(starts, stops)]
        stops = np.cumsum([len(x) for x in each])
        starts, points = stops - [len(x) for x in each], np.concatenate(each) if each else points
    ids = table[points]
    letters = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(ids > 0, out=letters[1:])
    letters = letters[stops] - letters[starts]
    out = np.zeros(len(ids) + PAD * n, np.uint32)
    owner = np.repeat(np.arange(n), stops - starts)
    out[np.arange(len(ids)) + PAD * (owner + 1)] = ids
    owner = np.repeat(np.arange(n), stops - starts + PAD)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] > 0) | (out[:-1] > 0)
    head = starts + PAD * np.arange(n)
    counts = np.zeros(len(out), bool)
    for k in range(PAD):
        keep[head + k] = True
    counts[:] = keep
    for k in range(PAD):
        counts[head + k] = False
    out, counts, owner = out[keep], counts[keep], owner[keep]
    return out, np.flatnonzero(counts), owner[counts], letters


def hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each position."""
    out = np.zeros(len(at), U64)
    for k in range(n - 1, -1, -1):
        out = out * _BASE + (ids[at - k].astype(U64) + U64(1))
    return mix(out + U64(n))


class HashArray:
    """Sorted hashes with a row of values each; the leading bits say where to begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)).astype(np.int32)
        self.keys = np.concatenate([self.keys, np.full(1, 0xFFFFFFFFFFFFFFFF, U64)])
        self.values = np.concatenate([self.values, np.zeros((1, values.shape[1]), values.dtype)])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or that of the last, empty row."""
        at = self.first[(h >> U64(64 - self.bits)).astype(np.int64)]
        behind = np.flatnonzero(self.keys[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < h[behind]]
        return np.where(self.keys[at] == h, at, len(self.keys) - 1)


class Model:
    """Interpolated Kneser-Ney models of a block of languages over the same arrays."""

    def __init__(self, samples: dict[str, list[str]], alphabet: Alphabet | None = None):
        self.languages = sorted(samples)
        self.alphabet = alphabet or Alphabet([t for ts in samples.values() for t in ts])
        parts = []
        for lang in self.languages:
            raw = [t.encode() for t in samples[lang]]
            ends = np.cumsum([len(r) for r in raw])
            ids, at, _, _ = grams(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends, self.alphabet.table)
            parts.append(self._estimate(ids, at))
        self.grams, self.contexts = [], []
        lower: HashArray | None = None
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([p[n]["key"] for p in parts]))
            pick = {}
            for p in parts:
                for k in ("context", "suffix"):
                    pick.setdefault(k, np.zeros(len(keys), U64))[np.searchsorted(keys, p[n]["key"])] = p[n][k]
            own, weights = np.zeros((len(keys), len(parts))), np.ones((len(keys), len(parts)))
            contexts = np.unique(np.concatenate([p[n]["contexts"] for p in parts]))
            back = np.ones((len(contexts), len(parts)))
            for j, p in enumerate(parts):
                own[np.searchsorted(keys, p[n]["key"]), j] = p[n]["own"]
                back[np.searchsorted(contexts, p[n]["contexts"]), j] = p[n]["back"]
            weights = back[np.searchsorted(contexts, pick["context"])]
            under = np.full((len(keys), len(parts)), 1 / self.alphabet.size) if lower is None else np.exp(lower.values[lower.find(pick["suffix"])].astype(float))
            lower = HashArray(keys, np.log(own + weights * under).astype(np.float32))
            self.grams.append(lower)
            self.contexts.append(HashArray(contexts, np.log(back).astype(np.float32)))
        empty = self.contexts[0].values[0]
        self.unseen = (empty - np.log(self.alphabet.size)).astype(np.float32)
        self.limits = np.full(len(parts), np.inf)

    @staticmethod
    def _estimate(ids: np.ndarray, at: np.ndarray) -> dict:
        """By order: hash of each seen n-gram, of its context and of its suffix, discounted probability; hash and weight of contexts."""
        out, count, place = {}, None, None
        for n in range(ORDER, 0, -1):
            key = hashes(ids, at, n)
            if n == ORDER:
                seen, first, count = np.unique(key, return_index=True, return_counts=True)
            else:  # continuation counts: distinct n-grams of the order above that end in this one
                longer = place
                seen, first, count = np.unique(hashes(ids, longer, n), return_index=True, return_counts=True)
                first = longer[first]
            place = at[first] if n == ORDER else first
            context = hashes(ids, place - 1, n - 1) if n > 1 else np.full(len(place), mix(np.zeros(1, U64))[0], U64)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, group = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(group, count), np.bincount(group)
            out[n] = {"key": seen, "context": context, "suffix": hashes(ids, place, n - 1) if n > 1 else context, "own": np.maximum(count - discount, 0) / total[group], "contexts": contexts, "back": discount * kinds / total}
        return out

    def entropies(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, characters that count, letters."""
        ids, at, owner, letters = grams(data, starts, stops, self.alphabet.table)
        n = np.bincount(owner, minlength=len(starts))
        score, found = self._scores(ids, at, ORDER)
        total = np.zeros((len(starts), len(self.languages)))
        if len(at):
            has = np.flatnonzero(n)
            total[has] = np.add.reduceat(score, (np.cumsum(n) - n)[has], axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n, letters

    def _scores(self, ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, None]:
        if n == 0:
            return np.broadcast_to(self.unseen, (len(at), len(self.languages))).copy(), None
        table = self.grams[n - 1]
        place = table.find(hashes(ids, at, n))
        out = table.values[place]
        rest = np.flatnonzero(place == len(table.keys) - 1)
        if len(rest):
            shorter, _ = self._scores(ids, at[rest], n - 1)
            if n > 1:
                weights = self.contexts[n - 1]
                shorter = shorter + weights.values[weights.find(hashes(ids, at[rest] - 1, n - 1))]
            out[rest] = shorter
        return out, None

    def calibrate(self, samples: dict[str, list[str]]) -> None:
        """Thresholds from texts kept out: the highest cross-entropy seen and a margin that short texts widen."""
        for j, lang in enumerate(self.languages):
            raw = [t.encode() for t in samples.get(lang, [])]
            ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
            if raw:
                h, n, letters = self.entropies(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
                if (good := letters > 0).any():
                    self.limits[j] = h[good, j].max() + max(0.5, 3 * h[good, j].std())


class Models:
    """The models of all languages: broadcast blocks in order of name, of which a worker holds one at a time."""

    def __init__(self, blocks: list[Broadcast]):
        self.blocks = blocks

    def each(self) -> Iterator[Model]:
        for block in self.blocks:
            yield block.value
            if len(self.blocks) > 1 and getattr(block, "_path", None) is not None:  # it can be loaded again
                vars(block).pop("_value", None)

    def predict(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        rows = np.arange(len(starts))
        lang, none, rejected = np.full(len(rows), "und", object), np.ones(len(rows), bool), np.ones(len(rows), bool)
        lowest, total = np.full(len(rows), 1e9), np.zeros(len(rows))
        for model in self.each():
            h, n, letters = model.entropies(data, starts, stops)
            best = h.argmin(axis=1)
            low, weight = h[rows, best], np.minimum(n, 64)
            both = np.minimum(low, lowest)
            total = total * np.exp(-(lowest - both) * weight) + np.exp(-(h - both[:, None]) * weight[:, None]).sum(axis=1)
            none = letters == 0
            wins = low < lowest
            lang[wins] = np.array(model.languages, object)[best[wins]]
            rejected[wins] = (low > model.limits[best] + 4 / np.sqrt(np.maximum(n, 1)))[wins]
            lowest = both
        lang[none] = "und"
        return lang.tolist(), np.where(none, 0, 1 / np.maximum(total, 1)), np.where(none, 0, lowest), rejected | none


def sample(docs: DataFrame, per_language: int = SAMPLE) -> tuple[list[list[str]], Callable[[list[str]], dict[str, list[str]]], Scratch | None]:
    """Blocks of languages in order of name, a call that fetches a block's texts, and where several blocks' texts are kept."""
    labelled = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_n", F.octet_length("text"))
    fits = F.col("doc_id").isNotNull()
    sizes = labelled.groupBy("lang").agg(F.count(F.when(fits, 1)).alias("fit"), F.avg(F.when(fits, F.least("_n", F.lit(SAMPLE_BYTES)))).alias("mean"), F.min("_n").alias("least")).collect()
    sizes.sort(key=lambda r: r.lang)
    blocks: list[list[str]] = []
    room = 0.0
    for r in sizes:
        size = min(r.fit, per_language) * r.mean if r.fit else max(r.least, LONG_BYTES)
        if not blocks or len(blocks[-1]) == BLOCK or size > room:
            blocks.append([])
            room = BLOCK_BYTES
        blocks[-1].append(r.lang)
        room -= size
    # ids first, then their texts; at most per_language ids a language
    fit = labelled.filter(fits)
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = fit.select("lang", "doc_id", F.xxhash64("doc_id").alias("_h")).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_language).select("doc_id").distinct()

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(t, SAMPLE_BYTES, PIECE).decode("utf-8", "ignore") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["lang", "doc_id", "text"])

    chosen = fit.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "doc_id", "text")
    rows = chosen.mapInArrow(shorten, chosen.schema)
    if long := [r.lang for r in sizes if not r.fit]:
        rest = labelled.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in long], "lang string")), "lang", "left_semi").withColumn("_h", F.xxhash64("text"))
        order = Window.partitionBy("lang").orderBy("_n", "_h")
        keys = rest.select("lang", "_n", "_h").distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_language)
        keys = keys.withColumn("_s", F.sum("_n").over(order)).filter((F.col("_r") == 1) | (F.col("_s") <= LONG_BYTES)).select("lang", "_h")
        texts = rest.join(F.broadcast(keys), ["lang", "_h"], "left_semi").groupBy("lang", "_h").agg(F.first("text").alias("text"))
        rows = rows.unionByName(texts.select("lang", F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "text"))
    scratch = Scratch(docs.sparkSession) if len(blocks) > 1 else None
    kept = scratch.keep(rows) if scratch else rows

    def fetch(block: list[str]) -> dict[str, list[str]]:
        table = (kept.filter(F.col("lang").isin(block)) if scratch else kept).toArrow()
        found: dict[str, list[str]] = {x: [] for x in block}
        for lang, _, text in sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "doc_id", "text")))):
            if len(found[lang]) < per_language:
                found[lang].append(text)
        return found

    return blocks, fetch, scratch


def learn(docs: DataFrame, per_language: int = SAMPLE) -> Models:
    """Four fifths of a language's sample make its model, the rest its threshold."""
    blocks, fetch, scratch = sample(docs, per_language)
    if not blocks:
        return Models([])
    texts: dict[str, list[str]] = {}
    letters: set[str] = set()
    for block in blocks:  # all letters first: the blocks' scores compare only over one alphabet
        texts = fetch(block)
        letters.update(*(t for ts in texts.values() for t in ts))
    alphabet, shared = Alphabet(["".join(letters)]), []
    for block in blocks:
        texts = fetch(block) if scratch else texts
        model = Model({k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in texts.items()}, alphabet)
        model.calibrate({k: v[::5] for k, v in texts.items()})
        shared.append(docs.sparkSession.sparkContext.broadcast(model))
    if scratch:
        scratch.drop(*scratch.tables)
    return Models(shared)


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 19):
            lang, score, entropy, rejected = models.predict(*buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", clean_text()).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {RESULT}")


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows whose language is not rejected, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 19):
            column = batch.column(batch.schema.get_field_index("text"))
            rejected = models.predict(*buffers(column))[3]
            yield batch.filter(pa.array(~rejected))

    return map_rows(docs, run, docs.columns, docs.schema)


def held_out(of: str, modulus: int, remainder: int):
    return F.pmod(F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(training(docs)))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the rejected ones go."""
    return keep_identified(docs, learn(training(docs)))
