"""Structured Streaming over event tables: windows, late data, sessions, joins, versions, upserts, alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, ``ts`` as an instant."""
    from pyspark.sql.types import StructType

    s = schema if schema is not None else spark.read.parquet(path).schema
    r = spark.readStream.schema(s if isinstance(s, (str, StructType)) else s)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size)
    g = (df.withWatermark("ts", late) if df.isStreaming else df).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size, step)
    g = (df.withWatermark("ts", late) if df.isStreaming else df).groupBy(w.alias("w"))
    return g.agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "n")


def sessions(df: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    g = (df.withWatermark("ts", late) if df.isStreaming else df).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once; repeats within the watermark's delay are dropped: the streaming form of an idempotent upsert."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of a key where the right event comes at most ``within`` after the left one."""
    a = left.select(F.col(key).alias("k"), F.col("ts").alias("left_ts"), F.col("event_id").alias("left_id"))
    b = right.select(F.col(key).alias("k2"), F.col("ts").alias("right_ts"), F.col("event_id").alias("right_id"))
    if left.isStreaming:
        a, b = a.withWatermark("left_ts", late), b.withWatermark("right_ts", late)
    on = (F.col("k") == F.col("k2")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select("k", "left_id", "right_id")


def versions(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """Versions closed by the next event of a user: (user_id, event_id, valid_from, valid_to), in the order of events.

    A user's state is an ordered buffer of the events that the watermark hasn't passed, and the version that is open
    at it. Events may come in any order, ``late`` after others at most: only what the watermark has passed closes a
    version, and a timer at the first buffered event calls the user up when it does. Later ones are dropped, as late rows
    are everywhere. The last version of each user is open, and stays in the state.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        open_, held = json.loads(state.get[0]) if state.exists else (None, [])
        if not state.hasTimedOut:
            for pdf in frames:
                held += [[int(t), int(e)] for e, t in zip(pdf["event_id"], pdf["micros"])]
        passed = state.getCurrentWatermarkMs() * 1000
        held.sort()
        out = []
        done = 0
        for t, e in held:
            if t >= passed:
                break
            if open_ is not None:
                out.append((key[0], open_[1], open_[0], t))
            open_, done = [t, e], done + 1
        held = held[done:]
        state.update((json.dumps([open_, held]),))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, passed // 1000 + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "valid_from", "valid_to"])

    d = df.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("micros"))
    return d.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, valid_from long, valid_to long", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def alerts(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("value") >= threshold).select("event_id", "user_id", "event_type", "value", F.when(F.col("value") >= 2 * threshold, "high").otherwise("low").alias("severity"))


def upsert_batches(df: DataFrame, target: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch, reduced to the last row of each user, to ``target``; a batch that is
    repeated after a failure carries the same number, so the target can tell."""

    def batch(part: DataFrame, n: int) -> None:
        last = part.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("b")).select("user_id", "b.ts", "b.event_id", "b.value")
        target(last, n)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, into Parquet files."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
