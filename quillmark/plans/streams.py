"""Queries on event time; the streaming versions of these plans are in quillmark.streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query


def _events(t):
    # events.ts has no zone; windows need a timestamp, the session's zone is UTC
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(t):
    w = _events(t).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("""WITH x AS (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start FROM events) SELECT window_start, count(*) AS n FROM x GROUP BY 1""")
def sliding_window(t):
    w = _events(t).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""WITH x AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM x) SELECT user_id, session_no::BIGINT AS session_no, count(*) AS n, min(ts) AS first_ts FROM s GROUP BY ALL""")
def session_window(t):
    """Sessions of a user with gaps of at most six hours, numbered; session windows are merged per user."""
    s = _events(t).groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    w = Window.partitionBy("user_id").orderBy("first_ts")
    return s.select("user_id", F.row_number().over(w).cast("long").alias("session_no"), "n", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"))


@query("SELECT user_id, event_type, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY ALL")
def last_event(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
