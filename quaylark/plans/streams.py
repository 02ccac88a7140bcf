"""Streaming queries: run over what there is, with the batch answer as oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaylark.plans.events import _STORY
from quaylark.plans.registry import query
from quaylark.streaming import streams as R


def _stream(spark, d):
    return R.event_stream(spark, d, pattern="events.parquet")


@query("SELECT CAST(date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 6 AS INTEGER)) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    rows = R.collected(R.tumbling(_stream(spark, d), "6 hours", "1 day", ["event_type"]), "tumbling", {}, "complete")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH x AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS start, value FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS k)) SELECT CAST(start AS VARCHAR) AS start, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1""")
def stream_sliding(spark, d):
    rows = R.collected(R.sliding(_stream(spark, d), "5 days", "1 day", "1 day", []), "sliding", {}, "complete")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(k AS BIGINT) AS burst, count(*) AS n FROM s GROUP BY 1, 2""")
def stream_bursts(spark, d):
    from pyspark.sql import Window

    rows = R.collected(R.bursts(_stream(spark, d), "2 hours", "1 day", ["user_id"]), "bursts", {}, "complete")
    return rows.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("session_window.start")).cast("long").alias("burst"), "n")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedup(spark, d):
    rows = R.collected(R.first_of_each(_stream(spark, d), "event_id", "1 day").select("event_id"), "dedup", {})
    return rows.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT user_id AS key, count(*) AS attempts, least(3, count(*)) AS allowed FROM events GROUP BY 1")
def stream_attempts(spark, d):
    rows = R.collected(R.attempts(_stream(spark, d).select(F.col("user_id").alias("key")), 3), "attempts", {})
    return rows.groupBy("key").agg(F.max("attempt").alias("attempts"), F.count_if("allowed").alias("allowed"))


@query("SELECT a.event_id, b.value > 50 AS outcome FROM events a JOIN events b ON b.event_id = a.event_id + 7 AND b.ts <= a.ts + INTERVAL 3 HOURS")
def stream_outcomes_later(spark, d):
    items = _stream(spark, d).select("event_id", "ts")
    later = _stream(spark, d).select((F.col("event_id") - 7).alias("event_id"), F.col("ts").alias("known_at"), (F.col("value") > 50).alias("outcome"))
    return R.collected(R.outcomes_later(items, later, "event_id", "3 hours", "1 day").select("event_id", "outcome"), "later", {})


@query(f"WITH stories AS ({_STORY}) SELECT id, root FROM stories")
def stream_stories(spark, d):
    """Stories by state over a stream; a test holds them against the batch operator."""
    rows = R.table_stream(spark, f"{d}/embeddings.parquet")
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.select(F.col("label").alias("key"), F.col("vec_id").alias("id"), F.timestamp_seconds("vec_id").alias("ts"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("l", norm)
    rows = rows.select("key", "id", "ts", F.transform("e", lambda x: x / F.col("l")).alias("vec"))
    return R.collected(R.assign_stories(rows, 72, 0.15), "stories", {}).select("id", "root")
