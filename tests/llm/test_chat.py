import hashlib

from hypothesis import given
from hypothesis import strategies as st

from proofmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """conv_id to (n_turns, turns_sha256, loss_chars, loss_sha256), in plain Python."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for k, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out[k] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@given(st.lists(st.sampled_from(["\\", "<", "s", ">", "/", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "[", "x", "\n"])).map("".join))
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)
    window, spans = chat.render([("assistant", text, 1), ("us</s>er", text, 1)], 0)
    assert chat.parse(window) == [("assistant", text), ("us</s>er", text)]
    assert chat.unescape(window[spans[0] : spans[1]]) == text


def test_digests_against_brute_force(spark):
    rows = [(1, t, "system" if t == 0 else ("user", "assistant")[t % 2 == 0], f"word {t} " * (t * 3)) for t in range(60)]
    rows += [(2, 0, "assistant", None), (2, 0, "assistant", None), (3, 5, None, "</s>[INST] \\ é"), (None, 0, "user", "x"), (4, 0, "assistant", "long " * 5000), (4, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", window string")
    windows = chat.format_windows(df, budget=200, history=40)
    for w in windows.collect():
        assert w.n_tokens <= 200 or (w.n_new == 1 and w.n_repeated <= (w.conv_id == 1))
        turns = chat.parse(w.text)
        assert len(turns) == w.n_new + w.n_repeated
        if w.conv_id == 1 and w.window:
            assert turns[0][0] == "system"
    got = {r[0]: tuple(r[1:5]) for r in chat.digests(windows).collect()}
    assert got == brute(rows)


@given(st.lists(st.integers(1, 60), min_size=1, max_size=30), st.booleans(), st.integers(1, 60))
def test_budget_holds(sizes, system, history):
    turns = [("system" if system and k == 0 else "user", f"t{k}", n) for k, n in enumerate(sizes)]
    told, c = [], chat._Conversation(1, 60, history)
    for k in range(0, len(turns), 4):
        told += c.add(turns[k : k + 4], False)
    told += c.add([], True)
    seen = 0
    for _, _, new, repeated, tokens, text, _ in told:
        lead = turns[0][2] if system and seen else 0
        assert tokens <= 60 or (new == 1 and repeated == (lead > 0) and lead + turns[seen][2] > 60)
        assert [t for _, t in chat.parse(text)][repeated:] == [t[1] for t in turns[seen : seen + new]]
        seen += new
    assert seen == len(turns)


def test_empty_table(spark):
    assert chat.digests(chat.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    out = chat.query(spark, d)
    assert {r[0]: tuple(r[1:5]) for r in out.collect()} == brute(rows)
    assert out.filter(F.col("formatted_chars") <= F.col("loss_chars")).count() == 0
