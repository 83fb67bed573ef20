"""The task state machine as a stream with timers: events wait for gaps to fill, leases, grants and retention run out.

State is a row a task: phase, last sequence number, events that came too early, and three times. A task whose evidence was purged, or whose retention ran out, has no state any more, so state is
bounded by the tasks of one retention period.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.relations import RESUMABLE, TERMINAL
from .ingest import stepped

#: Seconds that a lease, a grant and idle evidence last: fixed values but for the lease, which is a choice.
LEASE, GRANT, RETENTION = 240, 24 * 3600, 30 * 24 * 3600
STATE = "phase string, seq long, prior string, waiting string, lease_ms long, grant_ms long, keep_ms long"
VERDICT = "task_id long, seq long, event string, phase string, verdict string"


class Task:
    """One task between two batches."""

    def __init__(self, state: tuple | None):
        self.phase, self.seq, self.prior, waiting, self.lease, self.grant, self.keep = state or ("INIT", -1, "", "[]", 0, 0, 0)
        self.waiting = {int(s): (e, t, at) for s, e, t, at in json.loads(waiting)}

    def state(self) -> tuple:
        return (self.phase, self.seq, self.prior, json.dumps([[s, *w] for s, w in sorted(self.waiting.items())]), self.lease, self.grant, self.keep)

    def take(self, seq: int, event: str, target: str | None, at_ms: int) -> Iterator[tuple]:
        """The verdicts that an event leads to: its own, and those of events that waited for it."""
        if seq <= self.seq or seq in self.waiting:
            yield seq, event, self.phase, "seen"
            return
        self.waiting[seq] = (event, target, at_ms)
        if seq != self.seq + 1:
            yield seq, event, self.phase, "waits"
        while self.seq + 1 in self.waiting:
            self.seq += 1
            name, to, at = self.waiting.pop(self.seq)
            found = stepped(self.phase, self.prior, name, to)
            if found is None:
                yield self.seq, name, self.phase, "illegal"
                continue
            self.phase, self.prior = found
            self.keep = max(self.keep, at + RETENTION * 1000)
            if self.phase in TERMINAL or self.phase in RESUMABLE:
                self.lease = 0
            else:
                self.lease = at + LEASE * 1000
            if self.phase in TERMINAL:
                self.grant = 0
            elif name in ("content_granted", "authority_renewed"):
                self.grant = at + GRANT * 1000
            yield self.seq, name, self.phase, "ok"

    def expire(self, now_ms: int) -> Iterator[tuple]:
        """The verdicts of timers that ran out, in the order of their times."""
        for name in sorted(("lease", "grant", "keep"), key=lambda n: getattr(self, n)):
            due = getattr(self, name)
            if not 0 < due <= now_ms:
                continue
            setattr(self, name, 0)
            if name == "grant" and self.phase not in TERMINAL and self.phase not in RESUMABLE:
                self.phase, self.prior, self.lease = "AUTH_STALE", self.phase, 0
            yield self.seq, f"{name}_expired", self.phase, "timer"

    def next(self) -> int:
        return min((t for t in (self.lease, self.grant, self.keep) if t), default=0)


def tasks(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Streams verdicts (task_id, seq, event, phase, verdict) of events (task_id, seq, event, target, ts, arrived).

    target is where a renewed authority leads. An event after a gap waits until the gap is filled, however
    old it is by then; one that was seen before changes nothing. Leases, grants and retention run from an
    event's time ts; they end once the watermark of arrival times has passed them, so a late event is not lost.
    """

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        task, out = Task(state.get if state.exists else None), []
        if state.hasTimedOut:
            out += task.expire(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(parts)).sort_values(["seq", "ts"])
            for seq, event, target, at in zip(rows["seq"], rows["event"], rows["target"], rows["ts"]):
                out += task.take(int(seq), event, target if isinstance(target, str) else None, int(at.timestamp() * 1000))
        if task.next():
            state.update(task.state())
            state.setTimeoutTimestamp(max(task.next(), state.getCurrentWatermarkMs() + 1))
        elif task.waiting or task.seq < 0:
            state.update(task.state())
        else:  # nothing is left to wait for
            state.remove()
        yield pd.DataFrame([(key[0], *v) for v in out], columns=["task_id", "seq", "event", "phase", "verdict"])

    return events.withWatermark("arrived", delay).groupBy("task_id").applyInPandasWithState(advance, VERDICT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
