import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.water_fill([10, 1000, 1000], [5, 2, 1]) == pytest.approx([30, 1320, 660])
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 0], [5, 2]) == [0, 0]
    assert mixing.water_fill([0, 8], [5, 2]) == [0, 8]


def test_pivot_keeps_mass_and_expectation():
    taken = [0.0] * 7
    for seed in range(4000):
        rows = [[i, float(3 + 5 * i), 0.3] for i in range(7)]
        before = sum(m * p for _, m, p in rows)
        mixing.pivot(rows, seed, False)
        assert sum(m * p for _, m, p in rows) == pytest.approx(before)
        assert sum(0 < p < 1 for _, _, p in rows) <= 1
        mixing.pivot(rows, seed, True)
        assert all(p in (0, 1) for _, _, p in rows)
        for i, r in enumerate(rows):
            taken[i] += r[2] / 4000
    assert taken == pytest.approx([0.3] * 7, abs=0.04)


def test_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = mixing.op9_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    sizes, taken, targets, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in found:
        d = docs[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) and r.taken in [i * r.size for i in range(4)]
        sizes[d.source] += r.size
        taken[d.source] += r.taken
        targets[d.source] = r.target
        longest[d.source] = max(longest[d.source], r.size)
    order = sorted(sizes)
    assert [targets[s] for s in order] == pytest.approx(mixing.water_fill([sizes[s] for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))]))
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in order)
    assert sorted(map(tuple, mixing.op9_mixing(spark, sf_dir).repartition(7).collect())) == sorted(map(tuple, found))


def test_many_groups_and_odd_rows(spark):
    rows = [(i, f"{'w ' * (1 + i % 40)}", None if i % 3 == 0 else "b") for i in range(3000)] + [(7, None, "a"), (7, None, "a"), (None, "x y", "a"), (1, "w w ", "b"), (1, "w w ", "b")]
    df = spark.createDataFrame([(a, t, s, 0, 0) for a, t, s in rows], "doc_id long, text string, source string, copies int, n_words int")
    size = F.regexp_count("text", F.lit(mixing.WORD))
    found = mixing.mix(df, "doc_id", "source", size).collect()
    assert sum(r.n_rows for r in found) == len(rows)
    for s in (None, "a", "b"):
        own = [r for r in found if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 40
    kept = mixing.mixed(df, "doc_id", "source", "text")
    assert kept.columns == df.columns and abs(kept.count() - sum(r.copies for r in found)) <= 20
    assert mixing.mix(df.limit(0), "doc_id", "source", size).count() == 0


def test_targets_equal_water_fill(spark):
    """Sources in code point order, null last; bounds that one round leads to the next."""
    for sizes in ([10, 1000, 1000], [5, 0, 7, 100_000, 3, 2], [1, 1, 1], [0, 0], []):
        names = sorted(["b", "a", "é", "Z", "\U0001f600", "\uffee"][: max(0, len(sizes) - 1)]) + [None] * bool(sizes)
        found = mixing.targets_of(spark.createDataFrame(list(zip(names, sizes, strict=True))[::-1], "source string, size long")).collect()
        by = {r.source: (r["rank"], r.target) for r in found}
        expected = mixing.water_fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
        assert [by[n][0] for n in names] == list(range(len(names))) and [by[n][1] for n in names] == pytest.approx(expected)


def test_repeated_rows_take_their_share(spark, tmp_path):
    """A thousand equal rows get as many words as their source's target asks for, not all or nothing."""
    rows = [(None, "a", "word")] * 1000 + [(i, "b", "word") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = mixing.op9_mixing(spark, str(tmp_path)).collect()
    for key in (True, False):
        own = [r for r in found if (r.doc_id is None) == key]
        assert len(own) == 1000 and abs(sum(r.taken for r in own) - own[0].target) < 1 and max(r.taken for r in own) <= 3
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = mixing.mixed(docs, "doc_id", "source", "text").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in kept} == pytest.approx({"a": 1429, "b": 571}, abs=1)


def test_targets_and_copies_by_brute_force(spark, sf_dir):
    """Words counted by Python, targets by bisection of the common unit in place of rounds; copies are the rate rounded down or up."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sums = {}
    for r in rows:
        sums[r.source] = sums.get(r.source, 0) + size[r.doc_id]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 3.0 * sum(sums.values())
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(3 * sums[s], unit * weight[s]) for s in order) < sum(sums.values()) else (low, unit)
    target = {s: min(3 * sums[s], high * weight[s]) for s in order}
    source, taken = {r.doc_id: r.source for r in rows}, dict.fromkeys(order, 0)
    found = mixing.op9_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(size)
    for r in found:
        s = source[r.doc_id]
        rate = target[s] / sums[s] if sums[s] else 0
        assert (r.size, r.source_size) == (size[r.doc_id], sums[s]) and abs(r.target - target[s]) <= 1e-6 * max(1, target[s])
        assert r.taken in (math.floor(rate + 1e-9) * r.size, math.ceil(rate - 1e-9) * r.size)
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size[d] for d in size if source[d] == s)


def test_source_of_one_giant_document(spark):
    """It is taken a whole number of times, at most three; the other sources still come within one document of their targets."""
    df = spark.createDataFrame([(0, "a", "w " * 200000)] + [(i, "b", "x y z") for i in range(1, 400)], "doc_id long, source string, text string")
    size = F.regexp_count("text", F.lit(mixing.WORD))
    found = mixing.mix(df, "doc_id", "source", size, "text").collect()
    assert {r.copies for r in found if r.source == "a"} <= {0, 1, 2, 3} and sum(r.source == "a" for r in found) == 1
    assert abs(sum(r.size * r.copies for r in found if r.source == "b") - next(r.target for r in found if r.source == "b")) <= 3
