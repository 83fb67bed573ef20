import numpy as np

from proofmill.llm import language
from proofmill.llm.language import Model


def plain(texts, query, size):
    """Interpolated Kneser-Ney in plain Python over dictionaries, for one language."""
    n = language.ORDER
    counts = {}
    for t in texts:
        t = " " * (n - 1) + t
        for i in range(n - 1, len(t)):
            counts[t[i - n + 1 : i + 1]] = counts.get(t[i - n + 1 : i + 1], 0) + 1
    orders = {n: counts}
    for k in range(n - 1, 0, -1):
        orders[k] = {}
        for g in orders[k + 1]:
            orders[k][g[1:]] = orders[k].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / size
        c = orders[len(g)]
        ones, twos = (sum(v == x for v in c.values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return p(g[1:])
        return max(c.get(g, 0) - d, 0) / total * (g in c) + d * len(after) / total * p(g[1:])

    t = " " * (n - 1) + query
    return -sum(np.log(p(t[i - n + 1 : i + 1])) for i in range(n - 1, len(t))) / len(query)


def test_against_plain_kneser_ney():
    texts = {"a": ["abra cadabra abra", "bad cab bad"], "b": ["zoo zebra zoo", "oz raze"]}
    model = Model(texts)
    for q in ("abra zoo", "cab", "zzz", "qabq"):
        raw = np.frombuffer(q.encode(), np.uint8)
        h, n, letters = model.entropies(raw, np.array([0]), np.array([len(raw)]))
        if "q" not in q:
            for j, lang in enumerate("ab"):
                assert abs(h[0, j] - plain(texts[lang], q, model.alphabet.size)) < 1e-4
        assert n[0] == len(q)


def test_cases(spark):
    english, german = "the cat and the hat of that one ", "der hund und die katze überall schön "
    rows = [(i, (english, german)[i % 2] * (1 + i % 7), ("en", "de")[i % 2]) for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", "en"), (103, "The CAT", None), (None, german, "de"), (103, "The CAT", None), (104, english * 20_000, "en"), (105, "漢字漢字漢字" * 9, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    model = language.learn(language.training(df))
    got = language.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("en", "de")[i % 2] and not by[i].rejected for i in range(60))
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == "en" and by[None].lang_pred == "de" and by[104].lang_pred == "en" and by[105].rejected
    assert language.keep_identified(df, model).columns == df.columns
    assert language.keep_identified(df, model).count() == sum(not r.rejected for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(df, language.learn(df)).count() == 0
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify(df, language.learn(df)).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = language.query(spark, d).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01


def invented(rng, n):
    """A language of so many random words over its own part of the alphabet."""
    own = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9, replace=False)
    return ["".join(rng.choice(own, rng.integers(2, 8))) for _ in range(n)]


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(5)
    names = [f"x{i:03}" for i in range(300)]
    words = {x: invented(rng, 30) for x in names}
    rows = [(i * 4 + k, " ".join(rng.choice(words[x], 60)), x) for i, x in enumerate(names) for k in range(3)]
    rows += [(5000 + k, "длинный редкий язык " * 4000, "long") for k in range(2)] + [(None, "ένα κείμενο χωρίς αριθμό " * 9, "noid")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language.learn(df)
    want = sorted((i if i is not None else -1, x) for i, _, x in rows)
    got = language.identify(df, models).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred) for r in got) == want
    assert not any(r.rejected for r in got)
    assert language.keep_identified(df, models).count() == len(rows)


def test_ties_go_to_the_first_name(spark):
    rows = [(i, "the same words in both of them " * 4, "ab"[i % 2] * 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(df, language.learn(df)).collect()} == {"aa"}


def test_long_texts_count(spark):
    """A language that only the middle of long texts shows."""
    long = ["zz zy " * 8000 + "мир и дом " * 6000 + "zz zy " * 8000, "мир и дом " * 12]
    rows = [(i, long[i % 2] if i < 8 else "plain words for all", "ru" if i < 8 else "en") for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(df, language.learn(df)).collect()}
    assert all(got[i] == ("ru" if i < 8 else "en") for i in range(16))


def test_blocks_score_like_one(spark, monkeypatch):
    rows = [(i, f"{'abcde'[i % 5]}xyz {'uvwst'[i % 5]}q {i * 7919 % 9}kz " * 5 + "olm nop"[i % 7 :], "abcde"[i % 5]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = {r.doc_id: r for r in language.identify(df, language.learn(df)).collect()}
    monkeypatch.setattr(language, "BLOCK", 2)
    models = language.learn(df)
    assert len(models.blocks) == 3
    for r in language.identify(df, models).collect():
        w = one[r.doc_id]
        assert (r.lang_pred, r.rejected) == (w.lang_pred, w.rejected)
        assert abs(r.score - w.score) < 1e-4 and abs(r.cross_entropy - w.cross_entropy) < 1e-4


def test_an_alphabet_of_all_letters():
    """Numbers of characters beyond 65,535 are not cut short."""
    letters = "".join(chr(c) for c in range(0x110000) if chr(c).isalpha() and len(chr(c).lower()) == 1)
    alphabet = language.Alphabet([letters])
    assert alphabet.size > 1 << 16
    raw = np.frombuffer(letters.encode(), np.uint8)
    ids, at, _, n = language.grams(raw, np.array([0]), np.array([len(raw)]), alphabet.table)
    assert n[0] == len(letters) and ids[at].tolist() == [int(alphabet.table[ord(c)]) for c in letters] and (ids[at] > 0).all()
