"""Quantiles, distinct counts, frequent items, overlaps and table functions on odd rows, and their plans."""

import random

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestone.operators import overlaps
from lodestone.operators.statistics import distinct_levels, frequent_items, quantiles
from lodestone.plans import large
from lodestone.sources.tables import bucketed
from tests.core.test_operators import plan

INF, NAN = float("inf"), float("nan")


def discrete(values, p):
    """NaN sorts last; ranks from 1."""
    values = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    return repr(values[max(1, -int(-len(values) * p // 1)) - 1]) if values else "None"


@pytest.mark.parametrize("bins", [64, 1024])
def test_quantiles(spark, bins):
    r = random.Random(2)
    groups = {
        "even": [r.random() for _ in range(400)], "ties": [r.choice([1.0, 2.0, 2.5]) for _ in range(300)], "one": [7.0], None: [3.0, None, 1.0], "none": [None, None],
        "odd": [INF, -INF, NAN, NAN, 0.0, 1e308, -1e308, 5e-324, 1.0, INF], "steep": [10.0**i for i in range(-40, 40)], "zero": [0.0, -5e-324, 5e-324],
    }
    rows = [(k, v, 1) for k, vs in groups.items() for v in vs]
    r.shuffle(rows)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    found = quantiles(spark.createDataFrame(rows, "k string, v double, n int"), ["k"], "v", shares, bins)
    assert {x.k: [repr(x[n]) for n in shares] for x in found.collect()} == {k: [discrete(vs, p) for p in shares.values()] for k, vs in groups.items()}


def test_quantiles_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert quantiles(none, ["k"], "v", {"m": 0.5}).count() == 0
    assert list(map(tuple, quantiles(none, [], "v", {"m": 0.5}).collect())) == [(None,)]


def test_distinct_levels(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice(["x", None]), r.choice([None, r.randrange(-5, 90000)]), r.randrange(3)) for _ in range(500)] + [("c", "y", None, 1)]
    df = spark.createDataFrame(rows, "g string, h string, i long, j long")
    found = {(x.g, x.h, x.level): (x.n, x.m) for x in distinct_levels(df, ["g", "h"], {"n": "i", "m": "j"}).collect()}
    want = {}
    for level in range(3):
        for row in rows:
            key = (row[0] if level > 0 else None, row[1] if level > 1 else None, level)
            sets = want.setdefault(key, (set(), set()))
            for s, v in zip(sets, row[2:], strict=True):
                s |= {v} - {None}
    assert found == {k: (len(a), len(b)) for k, (a, b) in want.items()}
    assert list(map(tuple, distinct_levels(df.where("false"), ["g"], {"n": "i"}).collect())) == [(None, 0, 0)]


def test_frequent_items_keep_their_bound(spark):
    """More items than are tracked, in one hot group; the parts' sketches are combined."""
    r = random.Random(4)
    items = ["hot"] * 3000 + ["warm"] * 1500 + [f"i{r.randrange(5000)}" for _ in range(6000)] + [None] * 50
    r.shuffle(items)
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate(items)], "g string, v string, n long")
    found = {x.v: x for x in frequent_items(df, ["g"], "v", 20, 256, F.col("n") % 7).collect()}
    for name, n in (("hot", 3000), ("warm", 1500)):
        assert abs(found[name].estimate - n) <= found[name].bound
    assert None not in found and frequent_items(df.where("false"), ["g"], "v", 5, 64).count() == 0


@pytest.mark.parametrize("sweep", [3, 1000])
def test_overlap_join(spark, sweep):
    """Lengths of many scales, touching, equal, empty and turned intervals, nulls, infinite ones, repeated rows, negative places."""
    r = random.Random(5)

    def side(n):
        rows = [(i, r.choice(["a", "a", "b", None]), float(r.randrange(-50, 50)), None) for i in range(n)]
        rows = [(i, k, lo, lo + r.choice([0.0, -3.0, 1.0, 2.0, 0.25, 7.0, 300.0, 5000.0])) for i, k, lo, _ in rows]
        return rows + [(n, "a", None, 5.0), (n + 1, "a", -INF, INF), (n + 2, "b", 0.0, INF), (n + 3, "a", 1e17, 2e17), (None, "a", 0.0, 1.0), rows[0], rows[0]]

    a, b = side(70), side(60)
    schema = "i long, k string, lo double, hi double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    ok = lambda x: None not in (x[0], x[2], x[3]) and x[2] < x[3]
    for by in (["k"], []):
        found = sorted(map(tuple, overlaps.overlap_join(left, right, "i", "i", "lo", "hi", 1.0, by, sweep).collect()))
        want = sorted((x[0], y[0], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if ok(x) and ok(y) and x[2] < y[3] and y[2] < x[3] and (not by or (x[1] == y[1] and x[1] is not None)))
        assert found == want
    assert overlaps.overlap_join(left, right.where("false"), "i", "i", "lo", "hi", 1.0).count() == 0


def test_equal_intervals_are_swept_once(spark):
    """Nine million pairs of two intervals leave the sweep as lists, in few rows; Spark unfolds them."""
    rows = spark.range(3000).select("id", F.lit(1).alias("lo"), F.lit(3).alias("hi"))
    found = overlaps.overlap_join(rows, rows, "id", "id", "lo", "hi", 1.0)
    assert "FlatMapCoGroups" not in plan(found)
    assert tuple(found.agg(F.count("*"), F.sum("left_id"), F.min("start"), F.max("end")).first()) == (9_000_000, 3000 * 2999 * 3000 // 2, 1.0, 3.0)
    table = pa.table({"cell": pa.array([0] * 8), "side": pa.array([0] * 4 + [1] * 4), "id": list(range(8)), "lo": [1.0] * 8, "hi": [3.0] * 8, "first": [0] * 8, "home": [True] * 8})
    made = [b for b in overlaps._sweep(["cell"])(iter(table.to_batches())) if b.num_rows]
    assert [b.to_pylist() for b in made] == [[{"left_ids": [0, 1, 2, 3], "right_ids": [4, 5, 6, 7], "start": 1.0, "end": 3.0}]]


def test_equal_intervals_stay_in_one_block(spark, monkeypatch):
    """Blocks of a crowded cell don't part equal intervals: a pair of intervals leaves the sweeps once, with all its ids; very many equal ones are parted."""
    made, unfold = [], overlaps._unfolded
    monkeypatch.setattr(overlaps, "_unfolded", lambda pairs, *more: made.append(pairs) or unfold(pairs, *more))
    rows = spark.range(600).selectExpr("id", "id % 2 AS k", "id % 6 AS lo", "id % 6 + 8 AS hi")
    for by, pairs in (([], 36), (["k"], 18)):
        for equal in (1024, 10):
            monkeypatch.setattr(overlaps, "EQUAL", equal, raising=False)
            found = overlaps.overlap_join(rows, rows, "id", "id", "lo", "hi", 10.0, by, 200)
            assert tuple(found.agg(F.count("*"), F.sum("left_id"), F.sum(F.col("end") - F.col("start"))).first()) == (pairs * 10_000, pairs * 10_000 * 599 // 2, 10_000 * sum(8 - abs(i - j) for i in range(6) for j in range(6) if not by or i % 2 == j % 2))
            assert made[-1].count() == pairs if equal > 100 else made[-1].count() > pairs
    monkeypatch.setattr(overlaps, "MANY", 1, raising=False)
    found = overlaps.overlap_join(rows, rows, "id", "id", "lo", "hi", 10.0, [], 200, values={"length": "CAST(`end` - start AS INT)"})
    assert found.columns == ["left_id", "right_id", "length"] and found.agg(F.sum("length")).first()[0] == 10_000 * sum(8 - abs(i - j) for i in range(6) for j in range(6))


def test_many_small_keys_are_swept_together():
    """A sweep takes a batch's groups at once, however many, and a group that goes on over batches whole."""
    n = 5000
    table = pa.table({"by": [i // 2 for i in range(2 * n)], "side": pa.array([i % 2 for i in range(2 * n)]), "id": list(range(2 * n)), "lo": [float(i % 7) for i in range(2 * n)], "hi": [float(i % 7 + 2) for i in range(2 * n)], "first": [0] * 2 * n, "cell": [0] * 2 * n, "home": [True] * 2 * n})
    want = [([i], [i + 1]) for i in range(0, 2 * n, 2) if i % 7 != 6]
    for rows, most in ((2 * n, 4), (3, 4 * n)):
        made = list(overlaps._sweep(["by"])(iter(table.to_batches(rows))))
        assert sorted((r["left_ids"], r["right_ids"]) for b in made for r in b.to_pylist()) == want
        assert len(made) <= most


def test_keys_of_few_intervals_are_not_copied(spark, monkeypatch):
    """A key with few intervals is one sweep: no cells are counted for it, and each interval goes there once; crowded keys have theirs."""
    tags, write = [], overlaps.materialise
    monkeypatch.setattr(overlaps, "materialise", lambda df, tag: tags.append(tag) or write(df, tag))
    left = spark.range(400).selectExpr("id", "id % 40 AS k", "id AS lo", "id + IF(id % 3 = 0, 1, 900) AS hi")
    want = sorted((i, j) for i in range(400) for j in range(400) if i % 40 == j % 40 and i < j + (1 if j % 3 == 0 else 900) and j < i + (1 if i % 3 == 0 else 900))
    assert sorted((x.left_id, x.right_id) for x in overlaps.overlap_join(left, left, "id", "id", "lo", "hi", 1.0, ["k"]).collect()) == want
    assert "cells" not in tags
    tags.clear()
    more = spark.range(400, 405).selectExpr("id", "7L AS k", "2000L AS lo", "2001L AS hi")
    found = overlaps.overlap_join(left.unionAll(more), left, "id", "id", "lo", "hi", 1.0, ["k"], 12).collect()
    assert sorted((x.left_id, x.right_id) for x in found) == want and "cells" in tags


def test_plans(spark, sf_dir):
    for f in (large.overlapping_orders, large.near_suppliers):
        text = plan(f(spark, sf_dir))
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert "Expand" not in plan(large.distinct_rollup(spark, sf_dir))
    assert "Exchange" not in plan(large.co_partitioned_join(spark, sf_dir))


def test_bucketed_join_with_nulls_and_ties(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (3, "w")], "k long, v string")
    b = spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "k2 long, n int")
    joined = bucketed(a, 4, "k").hint("merge").join(bucketed(b, 4, "k2"), F.col("k") == F.col("k2"))
    assert sorted(map(tuple, joined.select("v", "n").collect())) == [("x", 5), ("x", 6), ("y", 5), ("y", 6)]
    assert bucketed(a.where("false"), 4, "k").count() == 0


def test_funnel_on_odd_rows(spark):
    spark.udtf.register("funnel", large.Funnel)
    rows = [(1, "a", "view"), (2, "a", "view"), (3, "a", "click"), (1, "b", "click"), (2, "b", None), (3, "b", "view"), (1, None, "view"), (2, None, "click"), (3, None, "purchase")]
    spark.createDataFrame(rows, "event_id long, who string, event_type string").createOrReplaceTempView("_odd")
    call = "SELECT * FROM funnel(TABLE({}), '{}', 'event_type', array('view', 'click', 'purchase'))"
    assert sorted(map(tuple, spark.sql(call.format("_odd", "who")).collect()), key=repr) == sorted([("a", 2, 3), ("b", 1, 3), (None, 3, 3)], key=repr)
    spark.sql("SELECT * FROM _odd WHERE false").createOrReplaceTempView("_none")
    assert spark.sql(call.format("_none", "who")).count() == 0
    with pytest.raises(AnalysisException, match="no column"):
        spark.sql(call.format("_odd", "nobody")).collect()
