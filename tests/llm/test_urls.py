import numpy as np

from proofmill.llm import urls


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def test_rules_and_cases(spark):
    texts = [None, "", "x", "http://", "http://A.Example.ORG/es/1?x", "HTTP://example.org", "http://example.org/en/12", "http://example.org/en/2", "http://badexample.org/es/", "ftp://q.com/de/#/fr/", "http://q.com?u=http://example.org/es/", "a://b://org/", "http://É.com/fr/" + "a" * 100_000, "http://org/", "http://com/fr/", "http://net/\nx"]
    rows = [(i, t, "<p>", "clash") for i, t in enumerate(texts)] * 2
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")).collect()}
    for i, t in enumerate(texts):
        host, path, rule, verdict = brute(t)
        assert got[i][:3] == (host, path, rule), t
        assert got[i][3] == verdict if verdict else got[i][3] in ("allow", "block")


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = urls.Boosted(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_features_against_plain_python(spark):
    texts = ["http://A.b.example.org/x/y-1.html?a=1&b=2#t", "https://q.com/", "x", None, "ftp://é.net/dir/é"]
    frame = urls.described(urls.with_rule(urls.with_host_and_path(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string"))))
    none = urls.Rates(*(np.zeros(0, np.int64) for _ in range(4)))
    got = urls.features(frame.orderBy("page_id").toArrow(), none)
    for row, t in zip(got, texts):
        t = t or ""
        raw = t.encode()
        share = [raw.count(b) / max(1, len(raw)) for b in set(raw)]
        host, path = brute(t)[:2]
        query = t.partition("#")[0].partition("?")[2]
        want = [len(t), len(host), len(path), path.count("/"), query.count("&") + 1 if query else 0, host.count(".") + 1 if host else 0, len(path.rpartition("/")[2]), sum(48 <= b < 58 for b in raw) / max(1, len(raw)), sum(65 <= b < 91 for b in raw) / max(1, len(raw)), raw.count(45), b"#" in raw, -sum(x * np.log2(x) for x in share), 0, 0, 0]
        assert np.allclose(row, want, atol=1e-4), t


def test_rates_leave_the_own_fold_out():
    rates = urls.Rates(np.array([3, 3, 5]), np.array([0, 1, 0]), np.array([10, 30, 60]), np.array([10, 0, 0]))
    slots = np.array([[3, 3, 3]] * 2)
    overall = 10 / 100
    assert np.allclose(rates.of(slots)[0], (10 + 20 * overall) / 60)
    assert np.allclose(rates.of(slots, np.array([0, 1]))[:, 0], [(0 + 20 * overall) / 50, (10 + 20 * overall) / 30])


def test_held_out_urls(spark):
    """Trees that never saw a fold, nor its labels in the rates, judge it better than its base rate does."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    judged = urls.described(urls.with_rule(urls.with_host_and_path(pages.select("page_id", "url"))))
    model, rates = urls.train(judged.filter("fold <> 0"))
    test = urls.sample(judged.filter("fold = 0"))
    y, p = test.column("blocked").to_numpy(), np.clip(model.score(urls.features(test, rates)), 1e-6, 1 - 1e-6)
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    print(len(y), y.mean(), ((p > 0.5) == y).mean(), loss(p), loss(np.full(len(y), y.mean())))
    assert ((p > 0.5) == y).mean() > max(y.mean(), 1 - y.mean()) + 0.1
    assert loss(p) < 0.7 * loss(np.full(len(y), y.mean()))


def test_no_labelled_url(spark):
    rows = urls.judge(spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")).collect()
    assert [r.verdict for r in rows] == ["allow", "allow"]


def test_query_and_empty(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    out = {r.page_id: r for r in urls.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == len(rows)
    for r in rows:
        host, path, rule, verdict = brute(r.url)
        o = out[r.page_id]
        assert (o.host, o.path, o.rule) == (host, path, rule) and (verdict is None or o.verdict == verdict) and 0 <= o.score <= 1
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
