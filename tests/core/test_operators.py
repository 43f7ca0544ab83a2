"""Operators on odd rows, plans, and streams with late data."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators.joins import asof_join, range_counts, range_join, salted_join
from lodestone.plans import batch
from lodestone.streaming import runs


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_asof_join_with_nulls_and_ties(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 5, 3.0), ("b", None, 4.0), (None, 1, 5.0)], "k string, u int, v double")
    found = {r.id: r.w for r in asof_join(left, right, ["k"], "t", "u", {"v": "w"}).collect()}
    assert found == {1: 3.0, 2: None, 3: None, 4: None, 5: None}


def test_range_join_equals_nested_loop(spark):
    points = spark.range(200).select((F.col("id") * 7 % 101 - 50).cast("double").alias("p"))
    ranges = spark.range(60).select("id", (F.col("id") * 3 % 47 - 30).cast("double").alias("lo"), (F.col("id") * 5 % 61 - 25).cast("double").alias("hi"))
    found = sorted(map(tuple, range_join(points, ranges, "p", "lo", "hi", 10.0).select("p", "id").collect()))
    assert found == sorted(map(tuple, points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi"))).select("p", "id").collect()))


def test_range_join_with_ranges_of_any_width(spark):
    inf = float("inf")
    points = spark.createDataFrame([(1, -1e300), (2, -3.0), (3, 0.0), (4, 2.5), (5, 1e12), (6, None), (7, inf)], "id int, p double")
    ranges = spark.createDataFrame([("all", -inf, inf), ("wide", -1e13, 1e13), ("huge", -1e301, 5.0), ("narrow", 2.0, 3.0), ("empty", 3.0, 3.0), ("turned", 4.0, 1.0), ("none", None, 1.0)], "name string, lo double, hi double")
    found = sorted(map(tuple, range_join(points, ranges, "p", "lo", "hi", 1.0).select("id", "name").collect()))
    assert found == sorted(map(tuple, points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi"))).select("id", "name").collect()))
    assert range_join(points, ranges.limit(0), "p", "lo", "hi", 1.0).count() == 0


def test_range_counts_make_no_pairs(spark):
    """Ties, repeated keys, infinite and odd ranges; and a result of 10^12 pairs, counted."""
    inf, nan = float("inf"), float("nan")
    points = spark.createDataFrame([(x,) for x in [-inf, -3.0, -0.0, 0.0, 0.0, 2.5, 2.5, 1e12, None, inf, nan]], "p double")
    ranges = spark.createDataFrame([("all", -inf, inf), ("same", 0.0, 2.5), ("same", 0.0, 3.0), ("nan", -inf, nan), ("far", 7.0, 8.0), ("empty", 3.0, 3.0), ("turned", 4.0, 1.0), ("none", None, 1.0), (None, -5.0, -0.0)], "name string, lo double, hi double")
    found = {(r.name, r.n) for r in range_counts(points, ranges, "name", "p", "lo", "hi").collect()}
    assert found == {(r.name, r["count"]) for r in points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi"))).groupBy("name").count().collect()}
    assert range_counts(points, ranges.limit(0), "name", "p", "lo", "hi").count() == 0 == range_counts(points.limit(0), ranges, "name", "p", "lo", "hi").count()
    many = spark.range(1_000_000).select(F.col("id").alias("p"), (F.col("id") % 4).alias("k"), F.lit(0).alias("lo"), F.lit(1_000_000).alias("hi"))
    assert {tuple(r) for r in range_counts(many, many, "k", "p", "lo", "hi").collect()} == {(k, 250_000_000_000) for k in range(4)}


def test_salted_join_equals_plain(spark):
    facts, keys = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k")), spark.range(0, 500, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert sorted(map(tuple, salted_join(facts, keys, "k", 5).select("id", "k", "v").collect())) == sorted(map(tuple, facts.join(keys, "k").select("id", "k", "v").collect()))


def test_pushdown_and_strategies(spark, sf_dir):
    text = plan(batch.filter_project(spark, sf_dir))
    assert "GreaterThanOrEqual(l_shipdate" in text and "l_returnflag" not in text.split("ReadSchema")[1].splitlines()[0]
    assert "NestedLoop" not in plan(batch.range_join_prices(spark, sf_dir)) and "Cartesian" not in plan(batch.range_join_prices(spark, sf_dir))
    assert "WindowGroupLimit" in plan(batch.top_k_per_group(spark, sf_dir))
    assert "TakeOrderedAndProject" in plan(batch.top_k(spark, sf_dir))
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan(batch.partition_pruning(spark, sf_dir))
    assert plan(batch.asof_join_events(spark, sf_dir)).split("Initial Plan")[-1].count("(") and "Join" not in plan(batch.asof_join_events(spark, sf_dir))


@pytest.fixture()
def late_events(spark, tmp_path):
    """Files read one after the other; the last holds a row far earlier than the others."""
    start = datetime(2024, 1, 1)
    row = lambda i, days: (i, start + timedelta(days=days), 1, "click", 1.0, None)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for n, rows in enumerate(([row(1, 0), row(2, 5), row(3, 10)], [row(4, 9.5), row(6, 20)], [row(5, 1), row(7, 21)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{n}"))
    import time

    for n in range(3):  # files are taken in the order of their times
        for f in (tmp_path / f"{n}").glob("*.parquet"):
            f.rename(tmp_path / f"{n}.parquet")
            (tmp_path / f"{n}.parquet").touch()
        time.sleep(1.1)
    return str(tmp_path / "*.parquet")


def test_late_rows_are_dropped_by_the_watermark(spark, late_events):
    stream = runs.event_stream(spark, late_events)
    found = {r.start.day: r.n for r in runs.appended(runs.tumbling_counts(stream), "late").collect()}
    # the row of day 2 comes two batches after the watermark has passed it; windows the watermark hasn't passed aren't out yet
    assert found == {1: 1, 6: 1, 10: 1, 11: 1}
