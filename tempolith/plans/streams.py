"""Streaming operators: each query runs the same operator over the table as a stream, to the end of the data.

Windows at the end stay open behind the watermark in append mode, so the stream has a row of a far later time
appended to it, which closes them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import CORE
from ..sources.shared import scratch
from ..streaming import events as ev
from ..tables import load

q = CORE.query


def _input(spark: SparkSession, d: str, name: str) -> str:
    """The events, with one of a year later that closes all windows. File order doesn't matter within one run."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark, f"{name}-in")
    e.write.parquet(path)
    _end(e).write.mode("append").parquet(path)
    return path


def _end(events: DataFrame) -> DataFrame:
    """One event of a year after the last."""
    values = {"event_id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long"), "event_type": F.lit("end"), "value": F.lit(0.0), "props": F.lit("{}")}
    last = events.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))
    return last.select(*[c if c == "ts" else values[c].alias(c) for c in events.columns])


def _streamed(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    path = _input(spark, d, name)
    out = scratch(spark, f"{name}-out")
    s = make(ev.stream(spark, path))
    ev.run_to_table(s, out, scratch(spark, f"{name}-state"))
    return spark.read.schema(s.schema).parquet(out)


@q("STR-01", oracle="""
SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def str_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, "tumbling", lambda s: ev.tumbling(s, "6 hours", "30 days")).filter("event_type <> 'end'").withColumn("total", F.round("total", 2))


@q("STR-04", oracle="""
WITH w AS (SELECT event_id, event_type, epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS start FROM events),
m AS (SELECT epoch(max(ts)) - 86400 AS mark FROM events WHERE event_id % 2 = 0)
SELECT CAST(start AS BIGINT) AS start, event_type, count(*) AS n FROM w, m WHERE event_id % 2 = 0 OR start + 21600 > mark GROUP BY 1, 2""")
def str_late_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Events with odd ids come in a second run, so those more than a day behind the first run's last are too late."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path, out, state = (scratch(spark, f"late-{x}") for x in ("in", "out", "state"))
    for part in (e.filter("event_id % 2 = 0"), e.filter("event_id % 2 <> 0"), _end(e)):
        part.write.mode("append").parquet(path)
        s = ev.tumbling(ev.stream(spark, path), "6 hours", "1 day").select("start", "event_type", "n")
        ev.run_to_table(s, out, state)
    return spark.read.schema(s.schema).parquet(out).filter("event_type <> 'end'")


@q("STR-02", oracle="""
SELECT s AS start, count(*) AS n FROM (SELECT unnest([CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT), CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) - 21600]) AS s FROM events) GROUP BY 1""")
def str_sliding(spark: SparkSession, d: str) -> DataFrame:
    end = load(spark, d, "events").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("m"))
    r = _streamed(spark, d, "sliding", lambda s: ev.sliding(s, "12 hours", "6 hours", "30 days"))
    return r.crossJoin(F.broadcast(end)).filter("start <= m").drop("m")


@q("STR-03", oracle="""
WITH x AS (SELECT user_id, epoch_us(ts) AS t, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM x) SELECT user_id, min(t) AS start, max(t) + 7200000000 AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def str_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, "sessions", lambda s: ev.sessions(s, "2 hours", "30 days")).filter("user_id >= 0")


@q("STR-05", oracle="SELECT event_id, user_id FROM events")
def str_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """The events twice over; each comes out once."""
    def twice(s):
        return ev.deduplicated(s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), ["event_id"], "30 days").select("event_id", "user_id")

    return _streamed(spark, d, "dedup", twice).filter("event_id >= 0")


@q("STR-06", oracle="""
SELECT a.user_id AS k, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR""")
def str_interval_join(spark: SparkSession, d: str) -> DataFrame:
    path = _input(spark, d, "join")
    out = scratch(spark, "join-out")
    s = ev.interval_join(ev.stream(spark, path).filter("event_type = 'view'"), ev.stream(spark, path).filter("event_type = 'purchase'"), "user_id", "1 HOUR", "30 days")
    ev.run_to_table(s, out, scratch(spark, "join-state"))
    return spark.read.schema(s.schema).parquet(out)


@q("STR-07", "WN-03", oracle="""
SELECT user_id, event_id, epoch_us(ts) AS valid_from, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events QUALIFY valid_to IS NOT NULL""")
def str_versions(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, "versions", ev.versions)


@q("STR-08", "SRC-12", oracle="""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def str_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches merged into a keyed table by buckets of keys: a batch rewrites only the buckets that it touches."""
    from ..sources.writes import BucketedTable

    path = _input(spark, d, "upsert")
    table = BucketedTable(spark, scratch(spark, "upsert-table"), "user_id", "ts", "event_id")
    ev.upsert_batches(ev.stream(spark, path, files_per_trigger=1), table.merge, scratch(spark, "upsert-state")).awaitTermination()
    return table.read().filter("user_id >= 0").select("user_id", "event_id", "value")


@q("STR-09", oracle="SELECT event_id, user_id, event_type, value, CASE WHEN value >= 90 THEN 'high' ELSE 'low' END AS severity FROM events WHERE value >= 45")
def str_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, "alerts", lambda s: ev.alerts(s, 45.0))
