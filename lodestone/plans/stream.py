"""Streaming queries. Each runs to the end of the table events and returns a table of its result.

Windows come in append mode: those that the watermark has closed, with their state dropped. stream_latest runs in complete mode.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.sources.shared import settings
from lodestone.sources.tables import table
from lodestone.streaming import keyed, runs


def _events(spark, sf_dir):
    return runs.event_stream(spark, f"{sf_dir}/events.parque[t]")  # a pattern, so that it may be one file


def _processor(spark, sf_dir):
    with settings(spark, runs.PROCESSOR_STORE):
        return runs.latest(runs.processed_totals(_events(spark, sf_dir)), "processor", "update", ["user_id"], "n")


#: The streams below read their rows in six micro-batches, up to twelve hours out of order, which the watermark of a day allows.
BATCHES, JITTER, LATE = 6, 12 * 3600, "1 day"


def _jittered(spark, sf_dir, *columns):
    rows = table(spark, sf_dir, "events").select("event_id", *columns).withColumn("ts", F.col("ts").cast("timestamp"))
    return keyed.stream_of(spark, keyed.in_batches(rows, "ts", BATCHES, JITTER, "event_id"), rows.schema)


def stream_idle_sessions(spark, sf_dir):
    """Users' sessions closed by timers: those that the watermark has passed."""
    with settings(spark, runs.PROCESSOR_STORE):
        found = runs.appended(keyed.idle_sessions(_jittered(spark, sf_dir, "user_id", "event_type", "ts"), 6 * 3600, LATE), "idle")
    return found.select("user_id", *[F.timestamp_millis(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n", "kinds")


def stream_balances(spark, sf_dir):
    """Cents of a user's events on top of an initial state: the user's number times a thousand."""
    users = table(spark, sf_dir, "events").where("user_id % 2 = 0").select("user_id", (F.col("user_id") * 1000).alias("total")).distinct()
    with settings(spark, runs.PROCESSOR_STORE):
        stream = _jittered(spark, sf_dir, "user_id", "value", "ts").select("user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
        return runs.latest(keyed.balances(stream, users), "balances", "update", ["user_id"], "n")


def stream_interval_join(spark, sf_dir):
    """Purchases with the same user's views of the two days before, and purchases without any; all but those of the last four days, for which the streams aren't over."""
    events = _jittered(spark, sf_dir, "user_id", "event_type", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("bought"))
    seen = _jittered(spark, sf_dir, "user_id", "event_type", "ts").where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"))
    found = runs.appended(keyed.interval_join(bought, seen, "user_id", "bought", "seen", "2 days", LATE), "interval")
    last = table(spark, sf_dir, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 4 days")).alias("_last"))
    return found.crossJoin(F.broadcast(last)).where("bought < _last").select("event_id", "user_id", "view_id")


QUERIES = {
    "stream_idle_sessions": stream_idle_sessions,
    "stream_balances": stream_balances,
    "stream_interval_join": stream_interval_join,
    "stream_tumbling": lambda s, d: runs.appended(runs.tumbling_counts(_events(s, d)), "tumbling"),
    "stream_sessions": lambda s, d: runs.appended(runs.session_counts(_events(s, d)), "sessions"),
    "stream_dedup": lambda s, d: runs.appended(runs.first_events(_events(s, d)), "dedup"),
    "stream_latest": lambda s, d: runs.latest(runs.tumbling_counts(_events(s, d)), "latest"),
    "stream_processor": _processor,
    "stream_stateful": lambda s, d: runs.latest(runs.running_totals(_events(s, d)), "stateful", "update", ["user_id"], "n"),
}

ORACLE_SQL = {
    "stream_idle_sessions": """
        WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, date_trunc('millisecond', min(ts)) AS start, date_trunc('millisecond', max(ts)) AS "end", count(*) AS n, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id, k
        HAVING date_trunc('millisecond', max(ts)) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""",
    "stream_balances": """
        SELECT user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) + CASE WHEN user_id % 2 = 0 THEN user_id * 1000 ELSE 0 END AS BIGINT) AS total FROM events GROUP BY user_id""",
    "stream_interval_join": """
        SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 2 DAY
        WHERE p.ts < (SELECT max(ts) - INTERVAL 4 DAY FROM events)""",
    "stream_tumbling": """
        SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM events GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    "stream_latest": """
        SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM events GROUP BY 1, 2""",
    "stream_sessions": """
        WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k
        HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_processor": "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1",
    "stream_stateful": "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1",
}
