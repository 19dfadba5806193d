"""Latency windows with watermarks, and folds whose state is a table that each batch carries on."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import folds as O

ALPHA = 0.1


def latency_windows(events: DataFrame, late: str = "1 hour", length: str = "1 hour") -> DataFrame:
    """start, event_type, n, mean, p95 of each window; events later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.percentile_approx("value", 0.95).alias("p95")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "p95")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's files below spark.checkpoint.dir; on one machine that has none, a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        base = tempfile.mkdtemp(prefix="quern-streams-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:8]}")


def fold_ewma(batch: DataFrame, state: DataFrame | None, key: str, seq: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """key, n, ewma after a batch of events: the state before it stands as a first event. Ranges of a key's events are folded apart, so no task holds a key's."""
    rows = batch.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.lit(1).alias("later"), F.col(seq).cast("long").alias("s"), F.col(value).cast("double").alias("x"), F.lit(1).cast("long").alias("n"))
    if state is not None:
        rows = rows.union(state.select(key, F.lit(0), F.lit(0).cast("long"), "ewma", "n"))
    rows = rows.withColumn("at", F.struct("later", "s"))
    counts = rows.groupBy("k").agg(F.sum("n").alias("n"))
    return O.ewma(rows, "k", "at", "x", alpha).join(counts, "k").select(F.col("k").alias(key), "n", "ewma")


def run_ewma(events: DataFrame, key: str = "event_type", seq: str = "event_id", value: str = "value", alpha: float = ALPHA) -> DataFrame:
    """key, n, ewma after all that the stream has now, batch by batch.

    Each batch writes the state after it to a folder with the batch's number, which a repeated batch writes anew from the one
    before; so the state survives what is lost, and is never on the driver.
    """
    spark = events.sparkSession
    path = folder(spark, "ewma")
    last: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        before = [n for n in last if n < number]
        state = batch.sparkSession.read.parquet(f"{path}/state/{before[-1]}") if before else None
        fold_ewma(batch, state, key, seq, value, alpha).write.mode("overwrite").parquet(f"{path}/state/{number}")
        last[:] = [*before, number]

    q = events.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if not last:
        return fold_ewma(spark.createDataFrame([], events.schema), None, key, seq, value, alpha)
    return spark.read.parquet(f"{path}/state/{last[-1]}")


def jaccard_steps(steps: DataFrame, least: float = 0.55, keep: int = 500) -> DataFrame:
    """key, n, mean, passes of the likeness of consecutive token sets (key, seq, tokens), over the last keep; passes from 20 samples. A key is a session; its steps in a batch are put in order in one task."""

    def step(k, frames, state):
        last, seen = state.get if state.exists else ([], [])
        last, seen = set(last), list(seen)
        rows = pd.concat(list(frames)).sort_values("seq")
        for tokens in rows["tokens"]:
            now = {int(t) for t in tokens}
            if last or seen:
                seen.append(len(last & now) / max(1, len(last | now)))
            last = now
        seen = seen[-keep:]
        state.update((sorted(last), seen))
        mean = sum(seen) / len(seen) if seen else 0.0
        yield pd.DataFrame({"key": [k[0]], "n": [len(seen)], "mean": [mean], "passes": [len(seen) >= 20 and mean >= least]})

    return steps.groupBy("key").applyInPandasWithState(step, "key string, n long, mean double, passes boolean", "last array<long>, seen array<double>", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream gives of all that is there now: each batch's rows are files of its own; in complete mode only the last batch's count."""
    spark = stream.sparkSession
    path, done = folder(spark, name), []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        done.append(number)

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(*[f"{path}/rows/{n}" for n in (sorted(set(done)) if mode != "complete" else [max(done)])])
