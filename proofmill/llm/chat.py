"""Operator 1: chat formatting in budgeted windows.

A conversation's turns stand in order of (turn, role, text). Prefix sums of their token counts
choose turn-aligned spans: each window takes the longest run of new turns that fits the budget, and
one turn at least. A leading system turn is retained in every window (a later one is a turn like
others), and the last turns before the span are repeated while they fit the history budget and leave
room for the next turn: the oldest go first, so only a turn that exceeds the budget with the system turn
alone makes a window that does. Only assistant texts among the new turns are
under the loss mask, so every assistant text is a target once.

Template: ``<s>`` and then, per turn, ``[INST]role[/INST]text</s>``. Inside roles and texts a
backslash is doubled and each control string gets a backslash after its first character, which
``unescape`` reverses exactly.

Rows are dealt by conversation and sorted inside the partition, so a worker reads them as a stream
and holds the turns of one window and its history, however long the conversation is. Digests of a
conversation are sequential by nature; they too run over that stream.

Cases: null text and null role are empty; repeated (conv_id, turn) rows are turns of their own; a
null conv_id is one conversation; a turn above the budget has a window of its own; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 256
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
WINDOWS = "conv_id long, window int, n_new int, n_repeated int, n_tokens long, text string, loss_spans array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str, int]], n_repeated: int) -> tuple[str, list[int]]:
    """The window's text, and start and end of each loss span in code points."""
    parts, spans, at = ["<s>"], [], 3
    for k, (role, text, _) in enumerate(turns):
        head, body = f"[INST]{escape(role)}[/INST]", escape(text)
        parts += [head, body, "</s>"]
        at += len(head)
        if k >= n_repeated and role == "assistant":
            spans += [at, at + len(body)]
        at += len(body) + 4
    return "".join(parts), spans


def parse(window: str) -> list[tuple[str, str]]:
    """Roles and texts of a window, read from its text alone."""
    out, at = [], len("<s>")
    while at < len(window):
        middle = window.index("[/INST]", at)
        end = window.index("</s>", middle + 7)
        out.append((unescape(window[at + 6 : middle]), unescape(window[middle + 7 : end])))
        at = end + 4
    return out


class _Conversation:
    """Turns of one conversation as they arrive."""

    def __init__(self, conv_id, budget: int, history: int):
        self.id, self.budget, self.history = conv_id, budget, history
        self.system: list = []
        self.before: list = []
        self.open: list = []
        self.window, self.seen = 0, 0

    def add(self, turns: list, last: bool) -> Iterator[tuple]:
        self.open += turns
        prefix = np.cumsum([0] + [t[2] for t in self.open])
        at = 0
        while at < len(self.open):
            head = [] if self.seen == 0 else self.system + self.before
            room = self.budget - sum(t[2] for t in head)
            while len(head) > len(self.system) and room < self.open[at][2]:  # the oldest history goes first
                room += head.pop(len(self.system))[2]
            end = max(int(np.searchsorted(prefix, prefix[at] + room, "right")) - 1, at + 1)
            if end >= len(self.open) and not last:
                break
            new = self.open[at:end]
            text, spans = render(head + new, len(head))
            yield (self.id, self.window, len(new), len(head), sum(t[2] for t in head + new), text, spans)
            if self.seen == 0 and new[0][0] == "system":
                self.system = new[:1]
            self._remember(new[1:] if self.seen == 0 and self.system else new)
            self.window, self.seen, at = self.window + 1, self.seen + len(new), end
        self.open = self.open[at:]

    def _remember(self, new: list) -> None:
        turns, total, keep = self.before + new, 0, 0
        for t in reversed(turns):
            total += t[2]
            if total > self.history:
                break
            keep += 1
        self.before = turns[len(turns) - keep :]


def _windows(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("n_new", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss_spans", pa.list_(pa.int32()))])
        now: _Conversation | None = None

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

        rows, size = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                ids, roles, texts, counts = (part.column(k).to_pylist() for k in range(4))
                turns = list(zip(roles, texts, counts, strict=True))
                cuts = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]] + [len(ids)]
                for a, b in zip(cuts, cuts[1:]):
                    if now is None or now.id != ids[a]:
                        rows += now.add([], True) if now else []
                        now = _Conversation(ids[a], budget, history)
                    for row in now.add(turns[a:b], False):
                        rows.append(row)
                        size += len(row[5])
                if size > 1 << 21 or len(rows) > 4096:
                    yield out(rows)
                    rows, size = [], 0
        rows += now.add([], True) if now else []
        if rows:
            yield out(rows)

    return run


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window, in order of (conv_id, window) inside each partition."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long"), "role", "text", F.greatest(F.regexp_count("text", F.lit(TOKEN)), F.lit(1)).cast("long").alias("tokens"))
    return rows.mapInArrow(_windows(budget, history), WINDOWS)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
    now, done = None, []

    def row(x: dict) -> tuple:
        return (x["id"], x["turns"], x["sha"].hexdigest(), x["chars"], x["loss"].hexdigest(), x["size"], x["windows"])

    for batch in batches:
        for w in batch.to_pylist():
            if now is None or w["conv_id"] != now["id"]:
                done += [row(now)] if now else []
                now = {"id": w["conv_id"], "turns": 0, "sha": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "windows": 0}
            for role, text in parse(w["text"])[w["n_repeated"] :]:
                now["sha"].update(f"{role}\n{text}\n".encode())
                now["turns"] += 1
            for a, b in zip(w["loss_spans"][::2], w["loss_spans"][1::2]):
                text = unescape(w["text"][a:b])
                now["loss"].update(text.encode())
                now["chars"] += len(text)
            now["size"] += len(w["text"])
            now["windows"] += 1
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema, strict=True)], schema=schema)
            done = []
    done += [row(now)] if now else []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema, strict=True)], schema=schema)


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from the windows' texts and masks as format_windows leaves them."""
    return windows.mapInArrow(_read_back, DIGESTS)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_windows(rows.unionByName(more)))

