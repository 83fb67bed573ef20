"""Prefix sums over rows in a global order, of any size and however few groups they have."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import Scratch


def _changes(column: pa.Array) -> np.ndarray:
    """Which rows but the first differ from the one before; null is like null."""
    left, right = column.slice(0, len(column) - 1), column.slice(1)
    same = np.asarray(pc.fill_null(pc.equal(left, right), False)) | (np.asarray(left.is_null()) & np.asarray(right.is_null()))
    return ~same


def _local(group: list[int], value: int, names: list[str]):
    """Adds the task's number, the run's number in it, and the sum of value before the row in its run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, total, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in group:
                new[1:] |= _changes(batch.column(k))
            new[0] = number < 0 or [batch.column(k)[0].as_py() for k in group] != last
            values = np.asarray(batch.column(value), np.int64)
            ends = np.cumsum(values)
            starts = np.flatnonzero(new)
            base = np.append(-total, (ends - values)[starts])
            run_of = np.cumsum(new)
            before = ends - values - base[run_of]
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array((number + run_of).astype(np.int64)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, names)
            number, total, last = number + len(starts), int(ends[-1] - base[-1]), [batch.column(k)[n - 1].as_py() for k in group]

    return run


def running(scratch: Scratch, rows: DataFrame, group: list[str], order: list, value: str, to: str) -> DataFrame:
    """rows, a kept table, with the sum of value over the rows before each one, in its group and order.

    The rows are range-sorted by group and order, so a group of any size is dealt over many tasks, and rows
    that are alike are told apart by where they stand in the table. Each task adds up its own rows; only a
    group that a task begins in the middle of needs what earlier tasks have of it, so the sums that are sent
    to all tasks are one row a task at most. value must not be null.
    """
    by = [*group, *order, "salt_"]
    dealt = rows.withColumn("salt_", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("salt_")
    out = StructType(list(dealt.schema.fields)).add("part_", IntegerType()).add("run_", LongType()).add(to, LongType())
    at = [dealt.columns.index(c) for c in (*group, value)]
    placed = scratch.keep(dealt.mapInArrow(_local(at[:-1], at[-1], out.names), out))
    first = placed.filter("run_ = 0").select(*group).distinct().toDF(*(f"{c}_first" for c in group))
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_first")) for c in group], F.lit(True))
    spans = placed.join(F.broadcast(first), alike, "left_semi") if group else placed
    sums = spans.groupBy("part_", *group).agg(F.sum(value).alias("sum_"))
    earlier = F.sum("sum_").over(Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part_", earlier.alias("offset_")).filter("offset_ is not null")
    whole = placed.join(F.broadcast(offsets), "part_", "left")
    return whole.withColumn(to, F.col(to) + F.when(F.col("run_") == 0, F.coalesce("offset_", F.lit(0))).otherwise(F.lit(0))).select(*rows.columns, to)
