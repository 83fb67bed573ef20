"""Operator 6: URL verdicts by rules and, where none fits, by gradient-boosted trees on lexical features.

Host and path come from the url by SQL expressions. A rule (host, path) fits its host and all
subdomains if the url's path starts with the rule's path; the longest rule wins. Urls that a rule
judges are the labelled urls: boosted trees are trained on a bounded sample of about TRAIN_ROWS distinct
ones, those whose hash is under a threshold that follows from their number, and judge the others.
Features: lengths of url, host and path, depth, digit ratio, character entropy, parameter count,
hyphens, upper-case ratio, fragment, and suffix statistics: the smoothed share of blocked urls by the
host's last label, by the ending of the path's last segment and by the directory that the path ends in.
These shares are counted over all labelled rows, in SLOTS slots of hashed suffixes a kind, so their
size is fixed; a training row takes them without its own fold, so no label leaks into its features.

Cases: a null url, or one without ``://``, has empty host and path, no rule, and a score like any
other; without labelled urls every verdict of the method is allow; of splits with the same gain the
first feature's lowest cut is taken; a very long url is a row like others; repeated rows are judged each
and a url counts once in the sample; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers

TRAIN_ROWS, FOLDS, SLOTS, DRAWN_TO_MEAN = 20_000, 5, 1 << 12, 20
TREES, DEPTH, RATE, BINS, LEAST, L2 = 40, 3, 0.2, 32, 8, 1.0
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = ("length", "host_length", "path_length", "depth", "parameters", "host_labels", "last_length")
NAMES = (*SHAPE, "digit_ratio", "upper_ratio", "hyphens", "fragment", "entropy", "host_suffix_rate", "path_suffix_rate", "directory_rate")
KINDS = 3


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return pages.select("page_id", "url", host.alias("host"), F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruled (allow, block, or null), as one CASE over the rules, longest first."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, ruled = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return pages.withColumns({"rule": rule, "ruled": ruled})


def described(judged: DataFrame) -> DataFrame:
    """Adds shape (lengths and counts), slots (of its suffixes) and fold to rows of with_rule."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = F.split("path", "/")
    last = F.element_at(parts, -1)
    ending = F.when(F.col("path").endswith("/"), "/").when(last.contains("."), F.concat(F.lit("."), F.element_at(F.split(last, r"\."), -1))).when(last.rlike("[0-9]$"), "digits").when(last != "", "word").otherwise("")
    directory = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    shape = [F.length(url), F.length("host"), F.length("path"), count(F.col("path"), "/"), F.when(query == "", 0).otherwise(count(query, "&") + 1), F.when(F.col("host") == "", 0).otherwise(count(F.col("host"), ".") + 1), F.length(last)]
    suffixes = [F.element_at(F.split("host", r"\."), -1), ending, directory]
    slots = F.array(*[(F.pmod(F.xxhash64(F.lit(k), x), F.lit(SLOTS)) + k * SLOTS).cast("int") for k, x in enumerate(suffixes)])
    return judged.withColumns({"shape": F.array(*[x.cast("int") for x in shape]), "slots": slots, "fold": F.pmod(F.xxhash64(url, F.lit(7)), F.lit(FOLDS)).cast("int")})


class Rates:
    """Share of blocked labelled rows by slot and fold, drawn towards the share of all."""

    def __init__(self, slot: np.ndarray, fold: np.ndarray, n: np.ndarray, blocked: np.ndarray):
        self.n, self.blocked = (np.zeros((FOLDS, KINDS * SLOTS)) for _ in range(2))
        self.n[fold, slot], self.blocked[fold, slot] = n, blocked

    def of(self, slots: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        """Shares by row and kind; without a row's own fold if it is given."""
        n, blocked = self.n.sum(axis=0), self.blocked.sum(axis=0)
        overall = blocked[:SLOTS].sum() / max(n[:SLOTS].sum(), 1)
        n, blocked = n[slots], blocked[slots]
        if fold is not None:
            n, blocked = n - self.n[fold[:, None], slots], blocked - self.blocked[fold[:, None], slots]
        return (blocked + DRAWN_TO_MEAN * overall) / (n + DRAWN_TO_MEAN)


def features(batch: pa.RecordBatch | pa.Table, rates: Rates, own_fold: bool = False) -> np.ndarray:
    """Rows of NAMES from url, shape, slots and fold, as described gives them."""
    n, column = batch.num_rows, lambda c: batch.column(batch.schema.get_field_index(c))
    flat = lambda c, k: np.asarray((x.combine_chunks() if isinstance(x := column(c), pa.ChunkedArray) else x).flatten()).reshape(n, k)
    out = np.zeros((n, len(NAMES)), np.float32)
    if not n:
        return out
    out[:, : len(SHAPE)] = flat("shape", len(SHAPE))
    for begin in range(0, n, 2048):
        urls = column("url").slice(begin, 2048)
        data, starts, stops = buffers(urls.cast(pa.binary()))
        rows = len(starts)
        seen = np.bincount(np.repeat(np.arange(rows), stops - starts) * 256 + data, minlength=rows * 256).reshape(rows, 256)
        size = np.maximum(stops - starts, 1)
        share = seen / size[:, None]
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        out[begin : begin + rows, len(SHAPE) : -KINDS] = np.stack([share[:, 48:58].sum(axis=1), share[:, 65:91].sum(axis=1), seen[:, 45], seen[:, 35] > 0, entropy], axis=1)
    out[:, -KINDS:] = rates.of(flat("slots", KINDS), column("fold").to_numpy() if own_fold else None)
    return out


class Boosted:
    """Boosted regression trees for log loss; features are cut into BINS bins at training quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base, self.trees = -20.0, []
        if not len(y):
            return
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for depth in range(DEPTH):
                splits = [self._split(binned, cuts, gradient, weight, np.flatnonzero(node == k)) for k in range(1 << depth)]
                tree.append([(f, t) for f, t, _ in splits])
                right = np.zeros(len(y), bool)
                for k, (f, _, b) in enumerate(splits):
                    if b >= 0:
                        right |= (node == k) & (binned[f] > b)
                node = node * 2 + right
            leaf = RATE * np.bincount(node, gradient, 1 << DEPTH) / (np.bincount(node, weight, 1 << DEPTH) + L2)
            score += leaf[node]
            self.trees.append((tree, leaf))

    @staticmethod
    def _split(binned, cuts, gradient, weight, rows) -> tuple[int, float, int]:
        best, found = 1e-9, (0, np.inf, -1)
        g, w = gradient[rows], weight[rows]
        whole = g.sum() ** 2 / (w.sum() + L2)
        for f, cut in enumerate(cuts):
            if not len(cut) or len(rows) < 2 * LEAST:
                continue
            at = binned[f][rows]
            gs, ws, n = (np.cumsum(np.bincount(at, v, len(cut) + 1))[:-1] for v in (g, w, np.ones(len(rows))))
            gain = gs**2 / (ws + L2) + (g.sum() - gs) ** 2 / (w.sum() - ws + L2) - whole
            gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
            if gain.max() > best:
                best, b = gain.max(), int(gain.argmax())
                found = (f, float(cut[b]), b)
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in tree:
                f, t = np.array([s[0] for s in level]), np.array([s[1] for s in level])
                node = node * 2 + (x[np.arange(len(x)), f[node]] > t[node])
            total += leaf[node]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def labelled(judged: DataFrame) -> DataFrame:
    return judged.filter("ruled is not null").withColumn("blocked", (F.col("ruled") == "block").cast("int"))


def suffix_rates(judged: DataFrame) -> Rates:
    """Counts over all labelled rows; a fixed number of them reaches the driver."""
    rows = labelled(judged).select("fold", "blocked", F.explode("slots").alias("slot"))
    found = rows.groupBy("slot", "fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")).toArrow()
    return Rates(*(found.column(c).to_numpy() for c in ("slot", "fold", "n", "blocked")))


def sample(judged: DataFrame, rows: int = TRAIN_ROWS) -> pa.Table:
    """About so many distinct labelled urls, those with the smallest hashes; fewer if there are fewer."""
    known = labelled(judged)
    n = known.agg(F.approx_count_distinct("url", 0.01)).first()[0]
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 32)) < F.lit(int(rows / n * (1 << 32))))
    return known.groupBy("url").agg(*[F.first(c).alias(c) for c in ("shape", "slots", "fold", "blocked")]).orderBy("url").toArrow()


def train(judged: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Boosted, Rates]:
    """Trees and suffix rates from the urls of described rows that a rule judges."""
    rates, found = suffix_rates(judged), sample(judged, rows)
    return Boosted(features(found, rates, True), found.column("blocked").to_numpy().astype(float)), rates


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score (of the trees) and verdict of every row."""
    judged = described(with_rule(with_host_and_path(pages.select("page_id", "url")), rules))
    model, rates = train(judged)
    shared = pages.sparkSession.sparkContext.broadcast((model, rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rates = shared.value
        for batch in batches:
            score = model.score(features(batch, rates)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path", "rule", "ruled")] + [pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "ruled", "score"])

    out = judged.select("page_id", "url", "host", "path", "rule", "ruled", "shape", "slots", "fold").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, ruled string, score double")
    return out.select("page_id", "host", "path", "rule", "score", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
