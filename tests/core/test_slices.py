"""Ordered operators by slices against ordinary windows: one hot key, nulls, ties, empty tables, more slices than rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import slices
from lodestone.operators.joins import asof_join


def rows(found):
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    hot = [(i, "hot" if r.random() < 0.8 else r.choice(["a", "b", None]), r.choice([None, *range(12)]), r.randrange(1000)) for i in range(900)]
    return spark.createDataFrame(hot, "id long, k string, t int, v long").repartition(5)


@pytest.mark.parametrize("parts", [1, 3, 17, 120])
def test_ranks_equal_windows(table, parts):
    w = Window.partitionBy("k").orderBy("t")
    found = slices.ranks(table, ["k"], ["t"], parts, tie="id")
    names = [f.alias(n) for n, f in {
        "row_number": F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("long"), "rank": F.rank().over(w).cast("long"), "dense_rank": F.dense_rank().over(w).cast("long"),
        "cume_dist": F.cume_dist().over(w), "percent_rank": F.percent_rank().over(w), "n_rows": F.count("*").over(Window.partitionBy("k")),
    }.items()]
    assert rows(found) == rows(table.select("*", *names))
    tiles = [F.ntile(n).over(Window.partitionBy("k").orderBy("t", "id")).cast("long").alias(f"t{n}") for n in (1, 4, 7, 500)]
    assert rows(found.select("id", *[slices.ntile(F.col("row_number"), F.col("n_rows"), n).alias(f"t{n}") for n in (1, 4, 7, 500)])) == rows(table.select("id", *tiles))


def test_ranks_of_one_key_use_every_task_and_ties_are_split(spark):
    same = spark.range(4000).select(F.col("id"), F.lit("x").alias("k"), F.lit(1).alias("t"))
    found = slices.ranks(same, ["k"], ["t"], 8, tie="id")
    assert found.where("rank = 1 AND dense_rank = 1 AND cume_dist = 1.0 AND percent_rank = 0.0 AND row_number = id + 1").count() == 4000
    sizes = [r["count"] for r in slices.sliced(same, ["k", "t", "id"], 8).groupBy(slices.SLICE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_running_equals_windows(table, parts):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    odd = table.withColumn("o", F.when(F.col("v") % 5 == 0, F.col("v")))
    found = slices.running(odd, ["k"], ["t", "id"], {"s": ("o", slices.SUM), "lo": ("v", slices.LEAST), "hi": ("v", slices.GREATEST), "x": ("v", slices.XOR), "z": ("o", slices.LAST)}, parts)
    plain = odd.select("*", F.sum("o").over(w).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.bit_xor("v").over(w).alias("x"), F.last("o", True).over(w).alias("z"))
    assert rows(found) == rows(plain)


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_asof_equals_the_window_join(table, parts):
    left, right = table.where("id % 3 = 0"), table.where("id % 3 > 0").drop("id")
    args = (["k"], "t", "t", {"v": "w"})
    assert rows(slices.asof(left, right, *args, parts)) == rows(asof_join(left, right, *args))


@pytest.mark.parametrize(("block", "parts"), [(1, 3), (2, 30), (50, 4), (5000, 2)])
def test_row_frames_equal_windows(table, block, parts):
    columns = {
        "a": lambda w: F.lag("v").over(w), "b": lambda w: F.lead("v", 2, -1).over(w), "m": lambda w: F.max("v").over(w.rowsBetween(-3, 0)),
        "s": lambda w: F.sum("v").over(w.rowsBetween(-2, 2)), "l": lambda w: F.last("id").over(w.rowsBetween(0, 2)),
    }
    found = slices.row_frames(table, ["k"], ["t", "id"], 3, 2, columns, block, parts)
    w = Window.partitionBy("k").orderBy("t", "id")
    assert rows(found) == rows(table.select("*", *[f(w).alias(n) for n, f in columns.items()]))


@pytest.mark.parametrize("parts", [1, 7])
def test_range_sums_equal_windows(table, parts):
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-2, 3)
    found = slices.range_sums(table, ["k"], "t", 2, 3, "id", {"n": F.lit(1), "s": F.col("v")}, parts)
    assert rows(found) == rows(table.select("*", F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s")))


def test_empty_tables(table):
    none = table.where("false")
    assert slices.ranks(none, ["k"], ["t"]).count() == 0
    assert slices.running(none, ["k"], ["t"], {"s": ("v", slices.SUM)}).count() == 0
    assert slices.row_frames(none, ["k"], ["t", "id"], 1, 1, {"a": lambda w: F.lag("v").over(w)}).count() == 0
    assert slices.range_sums(none, ["k"], "t", 1, 1, "id", {"n": F.lit(1)}).count() == 0
    assert rows(slices.asof(table, none.drop("id"), ["k"], "t", "t", {"v": "w"})) == rows(table.withColumn("w", F.lit(None).cast("long")))
