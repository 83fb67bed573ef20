"""Operator 7: document quality by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector;
learned filters of WIDTH bytes slide over a chunk at every STRIDE-th byte, and each filter's highest
response in the chunk is kept. A document's chunks are combined by the mean and the maximum of these
responses, and a logistic layer makes one probability of them. Training is plain gradient descent
(Adam) over all chunks of a bounded sample: at most SAMPLE texts per class, chosen by a hash of doc_id
whatever their length; a text of over SAMPLE_BYTES bytes counts with whole chunks that stand evenly
over all of it. The intercept is then set back to the classes' true shares.

Inputs of a score are the text's bytes alone.

Cases: null and empty texts are one empty chunk and get a score like any other; without labels of
both classes the score is the labels' share of 1, or 0.5 without labels; repeated rows are scored
each; of chunks with the same highest response all share it; a text of any length is scored whole, in
memory at once; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, clean_text, slices, spread

CHUNK, OVERLAP, WIDTH, STRIDE, VECTOR, FILTERS = 512, 64, 8, 4, 8, 24
SAMPLE, SAMPLE_BYTES = 1200, 1 << 16
EPOCHS, BATCH, RATE = 10, 32, 0.01
THRESHOLD = 0.3
PADDING = 256


def chunk_starts(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every chunk, and the text it is of; an empty text has one empty chunk."""
    step = CHUNK - OVERLAP
    n = np.maximum(1, -(-(stops - starts - OVERLAP) // step))
    owner = np.repeat(np.arange(len(starts)), n)
    first = starts[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    return first, np.minimum(first + CHUNK, stops[owner]), owner


def chunk_bytes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row of CHUNK byte numbers per chunk, padded."""
    at = first[:, None] + np.arange(CHUNK)
    padded = np.append(data, np.uint8(0))
    return np.where(at < last[:, None], padded[np.minimum(at, len(data))].astype(np.int16), PADDING)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.share = 0.5
        self.trained = False
        self.p = {
            "vectors": r.normal(0, 0.5, (257, VECTOR)).astype(np.float32),
            "filters": r.normal(0, (2 / (WIDTH * VECTOR)) ** 0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "intercept": np.zeros(1, np.float32),
        }
        self.p["vectors"][PADDING] = 0

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest response of each filter in each chunk, and the position that has it."""
        x = self.p["vectors"][chunks].reshape(len(chunks), CHUNK // STRIDE, STRIDE * VECTOR)
        half = STRIDE * VECTOR
        out = x[:, :-1] @ self.p["filters"][:half] + x[:, 1:] @ self.p["filters"][half:] + self.p["bias"]
        at = out.argmax(axis=1)
        return np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0], 0), at

    @staticmethod
    def pool(pooled: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Mean and maximum over each text's chunks; owner is ascending and has every text."""
        begin = np.searchsorted(owner, np.arange(n))
        counts = np.bincount(owner, minlength=n)[:, None]
        return np.hstack([np.add.reduceat(pooled, begin, axis=0) / counts, np.maximum.reduceat(pooled, begin, axis=0)])

    def score(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        if not self.trained:
            return np.full(len(starts), self.share)
        first, last, owner = chunk_starts(starts, stops)
        pooled = np.concatenate([self.responses(chunk_bytes(data, first[k : k + 256], last[k : k + 256]))[0] for k in range(0, len(first), 256)])
        logit = self.pool(pooled, owner, len(starts)) @ self.p["out"] + self.p["intercept"][0]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))

    def train(self, texts: list[bytes], labels: np.ndarray, shares: tuple[int, int], seed: int = 7) -> None:
        """shares: how many rows have label 0 and 1 in all."""
        if sum(shares):
            self.share = shares[1] / sum(shares)
        if not len(labels) or labels.min() == labels.max():
            return
        r = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(texts))
            for begin in range(0, len(order), BATCH):
                step += 1
                gradient = self._gradient([texts[i] for i in order[begin : begin + BATCH]], labels[order[begin : begin + BATCH]])
                for k, g in gradient.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= RATE / (1 + epoch / 2) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                self.p["vectors"][PADDING] = 0
        self.trained = True
        drawn = np.bincount(labels.astype(int), minlength=2)
        self.p["intercept"] += np.float32(np.log(shares[1] / max(shares[0], 1)) - np.log(drawn[1] / drawn[0]))

    def _gradient(self, texts: list[bytes], y: np.ndarray) -> dict:
        ends = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        first, last, owner = chunk_starts(ends - [len(t) for t in texts], ends)
        chunks = chunk_bytes(data, first, last)
        pooled, at = self.responses(chunks)
        features = self.pool(pooled, owner, len(texts))
        p = 1 / (1 + np.exp(-np.clip(features @ self.p["out"] + self.p["intercept"][0], -30, 30)))
        d = ((p - y) / len(y)).astype(np.float32)
        back = d[:, None] * self.p["out"]
        counts = np.bincount(owner, minlength=len(texts))
        grad = back[owner, :FILTERS] / counts[owner, None]
        top = (pooled == features[owner, FILTERS:]).astype(np.float32)
        top /= np.add.reduceat(top, np.searchsorted(owner, np.arange(len(texts))), axis=0)[owner]
        grad = (grad + back[owner, FILTERS:] * top) * (pooled > 0)
        places = at[:, :, None] * STRIDE + np.arange(WIDTH)  # chunk, filter, byte
        read = np.take_along_axis(chunks[:, None, :], places.reshape(len(chunks), 1, -1).astype(np.int64), 2).reshape(places.shape)
        patches = self.p["vectors"][read].reshape(len(chunks), FILTERS, WIDTH * VECTOR)
        g_filters = np.einsum("cf,cfk->kf", grad, patches, optimize=True)
        g_patches = (grad[:, :, None] * self.p["filters"].T[None]).reshape(-1, VECTOR)
        g_vectors = np.zeros_like(self.p["vectors"])
        flat = read.reshape(-1)
        for k in range(VECTOR):
            g_vectors[:, k] = np.bincount(flat, g_patches[:, k], 257)
        return {"vectors": g_vectors, "filters": g_filters, "bias": grad.sum(0), "out": d @ features + 1e-4 * self.p["out"], "intercept": np.array([d.sum()], np.float32)}


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE) -> Network:
    """docs: doc_id, text; labels: doc_id and a 0/1 column, null for none."""
    marked = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_y"))
    shares = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    network, shares = Network(), (shares.get(0, 0), shares.get(1, 0))
    # at most 2 * per_class ids
    ids = [r for y in (0, 1) for r in marked.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not ids:
        return network
    chosen = docs.sparkSession.createDataFrame(list({r[0]: r for r in ids}.values()), "doc_id long, _y int")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(t, SAMPLE_BYTES, CHUNK) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], ["doc_id", "text", "_y"])

    drawn = docs.select("doc_id", clean_text()).filter("text is not null").join(F.broadcast(chosen), "doc_id")
    found = drawn.mapInArrow(shorten, f"doc_id {dict(docs.dtypes)['doc_id']}, text binary, _y int").toArrow()
    rows = sorted({i: (i, t, y) for i, t, y in sorted(zip(*(found.column(c).to_pylist() for c in ("doc_id", "text", "_y"))))}.values())
    network.train([t for _, t, _ in rows], np.array([y for _, _, y in rows], float), shares)
    return network


def classify(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(*buffers(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", clean_text()).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table
    from .language import held_out

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = learn(docs, labels.filter(~held_out("doc_id", 5, 0)))
    return classify(docs, network).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
