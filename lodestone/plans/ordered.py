"""Ordered queries whose keys may hold any share of the rows: ranks, as-of joins and frames by sorted slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import slices
from lodestone.plans.batch import ORACLE_SQL as _BATCH
from lodestone.sources.tables import table


def sliced_ranks(spark, d):
    """ranking_windows without a task per priority, and the places in the whole table, which is one key."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    found = slices.ranks(orders, ["o_orderpriority"], ["o_orderdate"], tie="o_orderkey")
    quarter = slices.ntile(F.col("row_number"), F.col("n_rows"), 4).alias("quarter")
    return found.select("o_orderkey", F.col("rank").alias("r"), F.col("dense_rank").alias("dr"), quarter, F.col("cume_dist").alias("share"), F.col("percent_rank").alias("p"))


def sliced_total_ranks(spark, d):
    """Places of all lines by price: one key for the whole table, with ties."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").withColumn("k", F.lit("all"))
    found = slices.ranks(lines, ["k"], ["l_extendedprice"])
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("rank").alias("r"), F.col("dense_rank").alias("dr"), "n_rows")


def sliced_asof(spark, d):
    """For each purchase the latest view of anybody: all rows have one key (the type of the other side)."""
    events = table(spark, d, "events")
    sides = events.where("event_type = 'purchase'").withColumn("k", F.lit("view")), events.where("event_type = 'view'").withColumn("k", F.col("event_type"))
    found = slices.asof(*sides, ["k"], "ts", "ts", {"ts": "viewed", "value": "view_value"})
    return found.select("event_id", "user_id", "viewed", "view_value")


def sliced_frames(spark, d):
    """Frames over rows of a type, of which there are few and each has many rows."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value", "user_id")
    return slices.row_frames(e, ["event_type"], ["ts", "event_id"], 3, 2, {
        "before": lambda w: F.lag("value").over(w), "after2": lambda w: F.lead("user_id", 2, -1).over(w),
        "top4": lambda w: F.max("value").over(w.rowsBetween(-3, 0)), "users": lambda w: F.sum("user_id").over(w.rowsBetween(-2, 2)),
    }).select("event_id", "before", "after2", "top4", "users")


def sliced_range_sums(spark, d):
    """Events of a type within an hour before and half an hour after each, and their users' sum."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "user_id")
    found = slices.range_sums(e, ["event_type"], "at", 3600 * 10**6, 1800 * 10**6, "event_id", {"near": F.lit(1), "users": F.col("user_id")})
    return found.select("event_id", "near", "users")


QUERIES = {f.__name__: f for f in (sliced_ranks, sliced_total_ranks, sliced_asof, sliced_frames, sliced_range_sums)}

ORACLE_SQL = {
    "sliced_ranks": _BATCH["ranking_windows"],
    "sliced_total_ranks": """
        SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, (SELECT count(*) FROM lineitem) AS n_rows
        FROM lineitem WINDOW w AS (ORDER BY l_extendedprice)""",
    "sliced_asof": """
        WITH v AS (SELECT ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1)
        SELECT p.event_id, p.user_id, v.ts AS viewed, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.ts >= v.ts""",
    "sliced_frames": """
        SELECT event_id, lag(value) OVER w AS before, lead(user_id, 2, -1) OVER w AS after2,
          max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS top4,
          CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS users
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
    "sliced_range_sums": """
        SELECT event_id, count(*) OVER w AS near, CAST(sum(user_id) OVER w AS BIGINT) AS users FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 30 MINUTE FOLLOWING)""",
}
