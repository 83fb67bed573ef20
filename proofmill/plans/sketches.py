"""Bitmaps of hashes, which tell most rows that can't meet a join before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sketch has 2 ** SLOT_BITS bits (8 MB) however many hashes it takes; a fuller one lets more rows pass. The least number of tasks that make one.
SLOT_BITS, TASKS = 26, 16


def sketch(hashes: DataFrame, slot_bits: int = SLOT_BITS) -> Broadcast:
    """A sketch of the 64-bit hashes in the only column, a long or an array of longs; sent to all workers.

    A task gives at most a row for each 64 bits, and twice as many tasks as cores (TASKS at least) take all
    of the input, so what is shuffled for it does not grow with the input.
    """
    context = hashes.sparkSession.sparkContext

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << slot_bits, bool)
        for batch in batches:
            column = batch.column(0)
            values = (column.flatten() if pa.types.is_list(column.type) else column).drop_null()
            seen[_slot(values.to_numpy(zero_copy_only=False).view(np.uint64), slot_bits)] = True
        packed = np.packbits(seen, bitorder="little").view(np.int64)
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(packed[used])], ["at", "bits"])

    found = hashes.coalesce(max(TASKS, 2 * context.defaultParallelism)).mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros((1 << slot_bits) // 64, np.int64)
    whole[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return context.broadcast(whole)


def known(values: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in a sketch; those that are not are surely not."""
    at = _slot(values, len(whole).bit_length() + 5)
    return whole.view(np.uint64)[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0


def _slot(values: np.ndarray, slot_bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - slot_bits)).astype(np.int64)
