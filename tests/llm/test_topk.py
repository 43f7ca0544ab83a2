import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import topk


def brute(queries, candidates, k):
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in candidates.items() if c != q)
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows,k", [(1, 5), (4, 5), (120, 5), (50, 1)])
def test_equals_brute_force(spark, rows, k):
    rng = np.random.default_rng(rows)
    vectors = {i: [int(x) for x in rng.integers(-3, 4, 6) * rng.integers(0, 2, 6)] for i in range(rows)}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<long>").repartition(3)
    found = topk.top_k(df.where("id % 3 = 0"), df, k, block_rows=16, query_rows=7).collect()
    assert sorted(map(tuple, found)) == brute({i: v for i, v in vectors.items() if i % 3 == 0}, vectors, k)


def test_odd_rows(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (100, None), (150, [0.1, math.nan]), (200, [math.inf, 0.0]), (1, [None, 1.0]), (2, [-0.001, 0.0]), (3, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")
    good = topk.quantised(df, "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    assert {r.id: list(r.v) for r in good.collect() if r.id is not None} == {0: [128, 64], 50: [128, 64], 2: [-1, 0], 3: []}
    found = topk.top_k(good.where("id % 50 = 0"), good, 5)
    assert [tuple(r) for r in found.where("query_id = 0").orderBy("rank").collect()] == [(0, 1, 50, 20480), (0, 2, 3, 0), (0, 3, 2, -128)]
    assert topk.top_k(good.limit(0), good, 5).count() == 0 == topk.top_k(good, good.limit(0), 5).count()


@pytest.mark.parametrize("size,number", [(100, np.float32), (1 << 20, np.float64), (1 << 29, np.int64)])
def test_queries_are_scored_together_and_exactly(spark, size, number):
    """Weights of any size, dense and sparse dimensions, many ties: the type that is used holds each score exactly."""
    rng = np.random.default_rng(size)
    rows = rng.integers(-size, size + 1, (90, 6))
    rows[:, 3:] *= rng.integers(0, 2, (90, 3))
    rows[:, 0] |= 1
    rows[:60, 5] = 0
    rows[40:70] = rows[40]
    vectors = {i: v.tolist() for i, v in enumerate(rows)}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<long>").repartition(2)
    found = topk.top_k(df, df, 5, block_rows=32, query_rows=80).collect()
    assert sorted(map(tuple, found)) == brute(vectors, vectors, 5)
    ids, at = np.repeat(np.arange(90), 6), np.tile(np.arange(6), 90)
    assert topk._number(rows.ravel(), ids, rows.ravel()) is number
    some = rows.ravel() != 0
    lists = topk._postings(90, ids[some], at[some], rows.ravel()[some].astype(number))
    assert all(isinstance(lists[d][0], slice) for d in range(5))  # zeros don't make a list sparse, but where few are left
    assert (topk._accumulated(lists, 90, 90, ids, at, rows.ravel(), number).astype(np.int64) == rows @ rows.T).all()


def test_no_block_is_joined_or_broadcast(spark, monkeypatch):
    """The copies of the queries' blocks go to lanes by a shuffle, however small Spark takes the queries for; lanes follow the candidates' number, and groups of queries theirs."""
    rows = spark.range(400).selectExpr("id", "array(id % 7, id % 11, 3L) AS v")
    vectors = {r.id: list(r.v) for r in rows.collect()}
    for share in (64, 1):
        monkeypatch.setattr(topk, "SHARE", share, raising=False)
        found = topk.top_k(rows.where("id % 3 = 0"), rows, 5, block_rows=20, query_rows=10)
        assert sorted(map(tuple, found.collect())) == brute({i: v for i, v in vectors.items() if i % 3 == 0}, vectors, 5)
        text = found._jdf.queryExecution().toString()
        assert "Join" not in text and "Broadcast" not in text
    scores = np.array([[5, 9, 9, 1, 7, 7], [3, 3, 3, 3, 3, 3]])
    for number in (np.float32, np.float64, np.int64):
        bar = np.array([0, topk.LOWEST])
        query, place = topk._best_of(scores.astype(number), np.array([6, 5, 4, 3, 2, 1]), np.array([4, 9]), 2, bar)
        assert (query.tolist(), place.tolist(), bar.tolist()) == ([0, 0, 1, 1], [1, 5, 5, 4], [7, 3])
        query, place = topk._best_of(scores.astype(number), np.array([6, 5, 4, 3, 2, 1]), np.array([4, 9]), 2, np.array([8, 4]))
        assert (query.tolist(), place.tolist()) == ([0], [1])
