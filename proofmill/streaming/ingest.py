"""Incremental ingest of append-only sources: each run takes what is new, once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.durable import cut
from ..plans.relations import ANYWHERE, RESUMABLE, TERMINAL, TRANSITIONS

STATE = "phase string, seq long, prior string"
VERDICT = "task_id long, seq long, phase string, verdict string"
_NAMED = {(f, e): to for f, e, to in TRANSITIONS}
_FREE = dict(ANYWHERE)


#: What the ledger knows of each source: how far it was read, and a digest over the prefix that was.
LEDGER = "source string, watermark long, prefix string, batch long"


def _prefix(rows: DataFrame) -> DataFrame:
    """(source, watermark, prefix, n) of rows (source, seq, line): the last seq and a digest over all lines with their places."""
    mark = F.sha2(F.concat_ws(":", F.col("seq").cast("string"), F.col("line")), 256)
    part = lambda k: F.sum(F.conv(F.substring(mark, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy("source").agg(F.max("seq").alias("watermark"), F.count("*").alias("n"), *[part(k).alias(f"s{k}") for k in range(4)])
    return sums.select("source", "watermark", F.concat_ws("-", *[F.col(f"s{k}").cast("string") for k in range(4)]).alias("prefix"), "n")


def verdicts(snapshot: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every source of a snapshot (source, seq, line) against the ledger: new, appended, same, edited or shortened."""
    known = ledger.select("source", F.col("watermark").alias("was"), F.col("prefix").alias("had"))
    seen = snapshot.join(known.select("source", "was"), "source", "left").filter("was is null or seq <= was").drop("was")
    now = _prefix(seen).select("source", F.col("watermark").alias("seen_to"), F.col("prefix").alias("has"))
    last = snapshot.groupBy("source").agg(F.max("seq").alias("watermark"))
    all_ = last.join(known, "source", "full_outer").join(now, "source", "left")
    status = (
        F.when(F.col("was").isNull(), "new").when(F.col("watermark").isNull() | (F.col("watermark") < F.col("was")), "shortened").when(~F.coalesce(F.col("has") == F.col("had"), F.lit(False)), "edited")
        .when(F.col("watermark") > F.col("was"), "appended").otherwise("same")
    )
    return all_.select("source", "watermark", "was", status.alias("status"))


def _ledger(spark: SparkSession, root: str, before: int) -> DataFrame:
    """The last entry of each source, of batches before one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger").filter(F.col("batch") < before).groupBy("source").agg(F.max_by(F.struct("watermark", "prefix", "batch"), F.struct("batch", "watermark")).alias("l")).select("source", "l.*")


def take(spark: SparkSession, snapshot: DataFrame, root: str, batch: int) -> DataFrame:
    """Writes a snapshot's rows past each source's watermark to root/rows, and the ledger; returns the verdicts.

    A source whose prefix was edited or shortened is left out as a whole. Rows of a batch stand in a folder
    of their own that is overwritten, and the ledger follows it, so a batch that is run again after a crash
    repeats nothing. What is kept between runs is a ledger row a source, whatever the number of its rows.
    """
    found = cut(verdicts(snapshot, _ledger(spark, root, batch)))
    go = found.filter("status in ('new', 'appended')").select("source", F.coalesce("was", F.lit(-1)).alias("was"))
    rows = snapshot.join(go, "source").filter("seq > was").drop("was")
    rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
    entry = _prefix(snapshot.join(go.select("source"), "source", "left_semi")).select("source", "watermark", "prefix", F.lit(batch).cast("long").alias("batch"))
    entry.write.mode("overwrite").parquet(f"{root}/ledger/at={batch}")
    return found


def taken(spark: SparkSession, root: str) -> DataFrame:
    """All rows that were taken."""
    return spark.read.parquet(f"{root}/rows")


def follow(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str) -> None:
    """Takes what is new in a growing folder of snapshots (source, seq, line), a micro-batch each, and ends.

    Every file is a snapshot of its sources. A batch that a crash cut off runs again under its number.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    each = lambda rows, number: take(rows.sparkSession, rows, root, number)
    stream.writeStream.foreachBatch(lambda rows, number: each(rows, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: list[str]) -> None:
    """Appends to sink the rows of source that no earlier run has taken, one per key, and ends.

    A batch's rows are compared with what the sink holds of their keys, so no state grows with the runs,
    and stand in a folder of their own that is overwritten if the batch runs again. Nothing is dropped for
    being late: a row that was appended meanwhile is the next run's.
    """

    def write(rows: DataFrame, number: int) -> None:
        session, path = rows.sparkSession, f"{sink}/batch={number}"
        known = session._jvm.org.apache.hadoop.fs.Path(sink)
        new = rows.dropDuplicates(key)
        if known.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(known):
            held = session.read.schema(f"{schema}, batch long").parquet(sink).filter(F.col("batch") < number).select(*key).distinct()
            new = new.join(held, key, "left_anti")
        new.write.mode("overwrite").parquet(path)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stepped(phase: str, prior: str, event: str, target: str | None = None) -> tuple[str, str] | None:
    """Phase and remembered phase after an event; None if the table has no such transition.

    A suspended task goes back to where it was left, one whose authority was renewed to target, the
    earliest invalidated phase; a suspended or finished task can't be suspended, a finished one not cancelled.
    """
    resting = phase in RESUMABLE
    if event in _FREE and phase not in TERMINAL and (event == "cancel" or not resting):
        return _FREE[event], prior if resting else phase
    to = _NAMED.get((phase, event))
    if to is None:
        return None
    return ((target or prior) if phase == "AUTH_STALE" else prior, "") if to == "+" else (to, prior)


def tasks(events: DataFrame) -> DataFrame:
    """Streams every task's events (task_id, seq, event) through the transition table; state is one row a task.

    An illegal event, one out of sequence or one of a finished task is answered by a verdict and changes
    nothing; an event that was seen before is skipped, so a replay is harmless.
    """

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, seq, prior = state.get if state.exists else ("INIT", -1, "")
        out = []
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            if row.seq <= seq:
                continue
            found = stepped(phase, prior, row.event) if row.seq == seq + 1 else None
            verdict = "gap" if row.seq != seq + 1 else "illegal" if found is None else "ok"
            if found is not None:
                (phase, prior), seq = found, int(row.seq)
            out.append((key[0], int(row.seq), phase, verdict))
        state.update((phase, seq, prior))
        yield pd.DataFrame(out, columns=["task_id", "seq", "phase", "verdict"])

    return events.groupBy("task_id").applyInPandasWithState(advance, VERDICT, STATE, "append", GroupStateTimeout.NoTimeout)


def late(rows: DataFrame, watermark: str = "watermark") -> DataFrame:
    """Splits rows at each source's watermark: read now, or left to the next run."""
    return rows.withColumn("run", F.when(F.col("seq") <= F.col(watermark), "now").otherwise("next"))
