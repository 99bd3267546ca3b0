"""Structured Streaming runs over the tables, next to the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import engine as T
from .base import query


@query("SELECT epoch_us(date_trunc('hour', e.ts)) AS window_start, event_type, count(*) AS n, max(value) AS high FROM events e GROUP BY ALL")
def t2_stream_tumbling(spark, d):
    s = T.source(spark, d, "events")
    out = T.finish(T.tumbling(s, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.max("value").alias("high")]), "complete")
    return out.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", "high")


@query("SELECT DISTINCT user_id, event_type, epoch_us(date_trunc('day', ts)) AS day FROM events")
def t14_stream_dedup(spark, d):
    """The rows that the stream keeps: one of each user, type and day."""
    s = T.source(spark, d, "events").select("user_id", "event_type", F.date_trunc("day", "ts").alias("ts"))
    return T.finish(T.distinct(s, "ts", ["user_id", "event_type", "ts"], "60 days")).select("user_id", "event_type", F.unix_micros("ts").alias("day"))


@query("SELECT l.event_id AS left_id, r.event_id AS right_id FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'error' AND l.ts BETWEEN r.ts - INTERVAL 10 MINUTE AND r.ts + INTERVAL 10 MINUTE")
def j4_stream_join(spark, d):
    s = T.source(spark, d, "events").select("event_id", "event_type", "user_id", "ts")
    out = T.finish(T.join_within(s.where("event_type = 'click'"), s.where("event_type = 'error'"), "user_id", "10 MINUTES"))
    return out.select(F.col("left_event_id").alias("left_id"), F.col("right_event_id").alias("right_id"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= 3600000000000 THEN 1 ELSE 0 END AS new FROM p),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) // 1000 AS window_start, (max(ts) + 3600000000000) // 1000 AS window_end, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + 3600000000000 <= (SELECT max(ts) FROM p)""")
def t5_stream_sessions(spark, d):
    """Append mode: the sessions that the watermark has passed."""
    s = T.source(spark, d, "events")
    out = T.finish(T.session(s, "ts", "1 hour", ["user_id"], [F.count(F.lit(1)).alias("n")]))
    return out.select(F.unix_micros("window_start").alias("window_start"), F.unix_micros("window_end").alias("window_end"), "user_id", "n")


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE -1 END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(user_id, k, at_, begun, hit, ended) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, 0.0::DOUBLE, false, 0.0::DOUBLE FROM o UNION ALL
SELECT user_id, k, CASE WHEN s <> a THEN a WHEN a = 2 THEN 0 ELSE a + 1 END, CASE WHEN s = a AND a = 0 THEN t ELSE begun END, s = a AND a = 2, t
FROM (SELECT o.user_id, o.k, o.s, o.t, r.begun, CASE WHEN r.at_ > 0 AND o.t - r.begun > 86400 THEN 0 ELSE r.at_ END AS a FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
SELECT user_id AS key, round(begun, 3) AS begun, round(ended, 3) AS ended FROM r WHERE hit""")
def t23_stream_pattern(spark, d):
    step = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 2).otherwise(-1)
    s = T.source(spark, d, "events").withColumn("step", step)
    out = T.finish(T.sequence_stream(s, "user_id", "ts", "step", 3, 86_400.0))
    return out.select("key", F.round("begun", 3).alias("begun"), F.round("ended", 3).alias("ended"))


