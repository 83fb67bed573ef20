import numpy as np

from proofmill.llm import quality
from proofmill.llm.common import spread


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 511, 512, 513, 960, 961, 5000):
        first, last, owner = quality.chunk_starts(np.array([10]), np.array([10 + n]))
        assert first[0] == 10 and last[-1] == 10 + n and (last - first <= quality.CHUNK).all()
        assert (first[1:] <= last[:-1]).all() and (np.diff(first) == quality.CHUNK - quality.OVERLAP).all()


def test_spread_covers_long_texts():
    text = bytes(k % 251 for k in range(200_000))
    short = spread(text, 1 << 16, 512)
    assert len(short) == 1 << 16 and short[:512] == text[:512] and short[-512:] == text[-512:] and spread(b"ab", 4, 2) == b"ab"
    places = [text.index(short[k : k + 300]) % 251 for k in range(0, len(short), 512)]
    assert len(set(places)) > 20


def test_scores_against_plain_loops():
    """The forward pass, byte by byte and filter by filter."""
    network = quality.Network(5)
    network.trained = True
    network.p["intercept"][0] = 0.3
    texts = [b"", b"a", b"hello plain world " * 3, bytes(range(256)) * 5, "é日本".encode() * 200]
    p = network.p
    want = []
    for t in texts:
        chunks = [t[k : k + quality.CHUNK] for k in range(0, max(len(t) - quality.OVERLAP, 1), quality.CHUNK - quality.OVERLAP)] or [b""]
        highest = []
        for c in chunks:
            padded = list(c) + [quality.PADDING] * (quality.CHUNK - len(c))
            row = []
            for f in range(quality.FILTERS):
                best = 0.0
                for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                    x = np.concatenate([p["vectors"][b] for b in padded[at : at + quality.WIDTH]])
                    best = max(best, float(x @ p["filters"][:, f] + p["bias"][f]))
                row.append(best)
            highest.append(row)
        h = np.array(highest)
        logit = np.concatenate([h.mean(axis=0), h.max(axis=0)]) @ p["out"] + 0.3
        want.append(1 / (1 + np.exp(-logit)))
    ends = np.cumsum([len(t) for t in texts])
    got = network.score(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
    assert np.allclose(got, want, atol=1e-5)


def test_gradient_matches_differences():
    network = quality.Network(3)
    for k, v in network.p.items():
        network.p[k] = v.astype(np.float64)
    texts, y = [bytes(range(65, 90)) * 30, b"xyz" * 50, b""], np.array([1.0, 0.0, 1.0])

    def loss():
        ends = np.cumsum([len(t) for t in texts])
        network.trained = True
        p = network.score(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    gradient = network._gradient(texts, y)
    for name, at in (("filters", (3, 5)), ("vectors", (70, 2)), ("vectors", (120, 1)), ("out", (30,)), ("bias", (2,)), ("intercept", (0,))):
        before = network.p[name][at]
        network.p[name][at] = before + 1e-5
        up = loss()
        network.p[name][at] = before - 1e-5
        down = loss()
        network.p[name][at] = before
        extra = 1e-4 * network.p[name][at] if name == "out" else 0
        assert abs((up - down) / 2e-5 + extra - gradient[name][at]) < 2e-4, name


def test_cases(spark):
    rows = [(i, "a good plain text of words " * 9 if i % 2 else "!!! ### $$$ " * 9) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "x"), (3, "again"), (202, "long words " * 30_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, None), (None, 1), (999, 1)], "doc_id long, quality int")
    got = quality.classify(docs, quality.learn(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 80 and r.doc_id != 3)
    assert quality.classify(docs, quality.learn(docs, labels.filter("quality = 1"))).first().score == 1
    assert quality.classify(docs.limit(0), quality.learn(docs.limit(0), labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.query(spark, d).join(labels, "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    low = [r.predicted == 0 for r in rows if r.quality == 0]
    high = [r.predicted == 1 for r in rows if r.quality == 1]
    print(np.mean(right), np.mean(low), np.mean(high))
    assert np.mean(low) > 0.8 and np.mean(high) > 0.95
