"""Digests of whole groups in order, in one pass over sorted partitions; no group is held in memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def digests(rows: DataFrame, key: str, order: list[str], separator: str) -> DataFrame:
    """key, n and digest: the SHA-256 of each group's column ``line``, in order, joined by the separator.

    Such a digest is sequential by its definition, so a group is one task's; what the task holds does not
    grow with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, n, done = None, None, 0, []
        for batch in batches:
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != (k,):
                    if at:
                        done.append((at[0], n, state.hexdigest()))
                    at, state, n = (k,), hashlib.sha256(), 0
                state.update((separator if n else "").encode() + line.encode())
                n += 1
            if len(done) > 4096:
                yield out(done, batch.schema)
                done = []
        if at:
            yield out([*done, (at[0], n, state.hexdigest())], batch.schema)

    def out(done: list, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema.field(0).type), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], [key, "n", "digest"])

    dealt = rows.repartition(key).sortWithinPartitions(key, *order).select(key, "line")
    return dealt.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, n long, digest string")
