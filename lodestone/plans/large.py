"""Queries over groups, keys and intervals of any size: quantiles, distinct counts, frequent items, overlaps, co-partitioned joins, variants, table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.functions.funnel import Funnel
from lodestone.operators.overlaps import overlap_join
from lodestone.operators.statistics import distinct_levels, frequent_items, quantiles
from lodestone.sources.tables import bucketed, table

DAYS = "CAST(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS BIGINT)"
SPAN = "1 + o_orderkey % 5 * (o_orderkey % 11)"


def exact_quantiles(spark, d):
    return quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "median": 0.5, "p99": 0.99, "top": 1.0})


def exact_median_of_all(spark, d):
    """The whole table is one group."""
    return quantiles(table(spark, d, "lineitem"), [], "l_extendedprice", {"first": 0.0, "median": 0.5})


def distinct_rollup(spark, d):
    """distinct_aggregates at every level of a roll-up, by bitmaps."""
    return distinct_levels(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"suppliers": "l_suppkey", "parts": "l_partkey", "orders": "l_orderkey"})


SHARE, TRACKED = 100, 4096


def frequent_words(spark, d):
    """Words that make a hundredth of a language's words or more: whether the sketch reports them, and keeps its bound."""
    words = table(spark, d, "documents").select("lang", "doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    found = frequent_items(words.select("lang", "doc_id", "word"), ["lang"], "word", 200, TRACKED, F.pmod("doc_id", F.lit(16)))
    exact = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = exact.groupBy("lang").agg(F.sum("n").alias("all"))
    heavy = exact.join(total, "lang").where(F.col("n") * SHARE >= F.col("all"))
    both = heavy.join(found, ["lang", "word"], "left")
    return both.select("lang", "word", "n", F.col("estimate").isNotNull().alias("reported"), (F.abs(F.col("estimate") - F.col("n")) <= F.col("bound")).alias("in_bound"))


DAYS_SHARED = {"days": "CAST(`end` - start AS BIGINT)"}


def overlapping_orders(spark, d):
    """Urgent and low orders whose periods (from the day of order, of lengths by their keys) overlap."""
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", day.alias("lo"), (day + F.expr(SPAN)).alias("hi"))
    side = lambda p: rows.where(F.col("o_orderpriority") == p)
    found = overlap_join(side("1-URGENT"), side("5-LOW"), "o_orderkey", "o_orderkey", "lo", "hi", 1.0, values=DAYS_SHARED)
    return found.select(F.col("left_id").alias("urgent"), F.col("right_id").alias("low"), "days")


def overlapping_orders_by_customer(spark, d):
    """Periods of one customer's orders of the two priorities."""
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", day.alias("lo"), (day + 30 * F.expr(SPAN)).alias("hi"))
    side = lambda p: rows.where(F.col("o_orderpriority") == p)
    found = overlap_join(side("1-URGENT"), side("5-LOW"), "o_orderkey", "o_orderkey", "lo", "hi", 30.0, ["o_custkey"], values=DAYS_SHARED)
    return found.select(F.col("left_id").alias("urgent"), F.col("right_id").alias("low"), "days")


def near_suppliers(spark, d):
    """self_join by cells: suppliers of one nation whose balances lie less than 500 apart, as overlaps of half-open windows of whole cents."""
    cents = S.cents("s_acctbal")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", cents.alias("lo"), (cents + 50_000).alias("hi"))
    found = overlap_join(rows, rows, "s_suppkey", "s_suppkey", "lo", "hi", 50_000.0, ["s_nationkey"])
    return found.where("left_id < right_id").select(F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("other"))


BUCKETS = 16


def co_partitioned_join(spark, d):
    """Orders with their lines, both in buckets of the order's key: join and aggregate need no exchange."""
    orders = bucketed(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), BUCKETS, "o_orderkey")
    lines = bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"), BUCKETS, "l_orderkey")
    return orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("n"), F.sum(S.revenue()).alias("revenue"))


def variant_rows(spark, d):
    """Each field of each event's variant as a row."""
    table(spark, d, "events").select("event_id", F.parse_json("props").alias("v")).createOrReplaceTempView("_variant_events")
    return spark.sql("SELECT event_id, x.pos, x.key, CAST(x.value AS BIGINT) AS value FROM _variant_events, LATERAL variant_explode(v) x")


def variant_schemas(spark, d):
    """The schema that all variants of a type fit."""
    return table(spark, d, "events").groupBy("event_type").agg(F.schema_of_variant_agg(F.parse_json("props")).alias("shape"), F.count("*").alias("n"))


STEPS = ("view", "click", "purchase")


def user_funnel(spark, d):
    """How far each user comes through view, click and purchase in this order, by a polymorphic table function."""
    spark.udtf.register("funnel", Funnel)
    table(spark, d, "events").createOrReplaceTempView("_funnel_events")
    return spark.sql(f"SELECT user_id, reached, n_rows FROM funnel(TABLE(_funnel_events), 'user_id', 'event_type', array({', '.join(map(repr, STEPS))}))")


QUERIES = {f.__name__: f for f in (exact_quantiles, exact_median_of_all, distinct_rollup, frequent_words, overlapping_orders, overlapping_orders_by_customer, near_suppliers, co_partitioned_join, variant_rows, variant_schemas, user_funnel)}

_OVERLAPS = "SELECT a.k AS urgent, b.k AS low, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS days FROM o a JOIN o b ON a.lo < b.hi AND b.lo < a.hi {} WHERE a.p = '1-URGENT' AND b.p = '5-LOW'"
ORACLE_SQL = {
    "exact_quantiles": "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.1) AS p10, quantile_disc(l_extendedprice, 0.5) AS median, quantile_disc(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS top FROM lineitem GROUP BY 1",
    "exact_median_of_all": "SELECT min(l_extendedprice) AS first, quantile_disc(l_extendedprice, 0.5) AS median FROM lineitem",
    "distinct_rollup": """
        SELECT l_returnflag, l_linestatus, CAST(2 - grouping(l_returnflag) - grouping(l_linestatus) AS INTEGER) AS level, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "frequent_words": f"""
        WITH w AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2)
        SELECT lang, word, n, true AS reported, true AS in_bound FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM c) WHERE n * {SHARE} >= t""",
    "overlapping_orders": f"WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, {DAYS} AS lo, {DAYS} + {SPAN} AS hi FROM orders) " + _OVERLAPS.format(""),
    "overlapping_orders_by_customer": f"WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, {DAYS} AS lo, {DAYS} + 30 * ({SPAN}) AS hi FROM orders) " + _OVERLAPS.format("AND a.c = b.c"),
    "near_suppliers": "SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(CAST(round(a.s_acctbal * 100) AS BIGINT) - CAST(round(b.s_acctbal * 100) AS BIGINT)) < 50000",
    "co_partitioned_join": """
        SELECT o_orderkey, max(o_orderstatus) AS status, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS revenue
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
    "variant_rows": "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY e.key) - 1 AS INTEGER) AS pos, e.key, CAST(e.value AS BIGINT) AS value FROM events, LATERAL json_each(props) e",
    "variant_schemas": "SELECT event_type, 'OBJECT<k: BIGINT>' AS shape, count(*) AS n FROM events GROUP BY 1",
    "user_funnel": """
        WITH v AS (SELECT user_id, min(event_id) AS a FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT user_id, min(event_id) AS b FROM events JOIN v USING (user_id) WHERE event_type = 'click' AND event_id > a GROUP BY 1),
        p AS (SELECT user_id, min(event_id) AS d FROM events JOIN c USING (user_id) WHERE event_type = 'purchase' AND event_id > b GROUP BY 1), u AS (SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1)
        SELECT user_id, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (d IS NOT NULL)::INT AS INTEGER) AS reached, n_rows FROM u LEFT JOIN v USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id)""",
}
