import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, most):
    b = list(text)
    for _ in range(rng.randint(0, most)):
        kind, i = rng.randint(0, 2), rng.randint(0, max(0, len(b) - 1))
        if kind == 0:
            b.insert(i, rng.choice("abcé"))
        elif b and kind == 1:
            b.pop(i)
        elif b:
            b[i] = rng.choice("abcé")
    return "".join(b)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edit_distance(spark, k):
    rng = random.Random(k)
    rows = [(a, edited(rng, a, k + 2)) for a in ("".join(rng.choices("abé", k=rng.randint(0, 30))) for _ in range(300))]
    found = spark.createDataFrame(rows, "x string, y string").select("x", "y", F.expr(lines.edit_distance("x", "y", k)).alias("d")).collect()
    assert all(min(r.d, k + 1) == min(distance(r.x, r.y), k + 1) for r in found if abs(len(r.x) - len(r.y)) <= k)


def connected(pairs, n):
    """For each of n nodes the smallest that it is connected to."""
    root = list(range(n))
    while True:
        new = list(root)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("k", [1, 2])
def test_links_equal_brute_force(spark, k):
    rng = random.Random(k)
    texts = set()
    for _ in range(40):
        base = "".join(rng.choices("abcdef ", k=rng.randint(6, 40)))
        texts.update(edited(rng, base, 3) for _ in range(6))
    rows = list(enumerate(sorted(texts)))
    df, expected = spark.createDataFrame(rows, "row long, line string"), {(i, j) for i, a in rows for j, b in rows if i < j and min(len(a), len(b)) >= 5 and distance(a, b) <= k}
    found = {tuple(sorted(r)) for r in lines.edit_links(df, k, 5).collect()}
    assert found == expected
    some = {tuple(sorted(r)) for r in lines.edit_links(df, k, 5, spanning=True).collect()}
    assert some <= expected and connected(some, len(rows)) == connected(expected, len(rows))


LONG = "this is a line of some length, with words"
ODD = [(1, f"{LONG}\n\nshort\n{LONG}!"), (2, f"short\n{LONG.replace('some', 'sone')}\nnew"), (3, f"{LONG}\nshort"), (4, None), (5, ""), (6, "\n \n"), (None, "short"), (7, "x" * 30_000), (7, "x" * 30_000), (8, "x" * 29_999 + "y\nsharply")]


def odd(spark):
    return spark.createDataFrame([(i, t, 0, "s", len(t or "")) for i, t in ODD], "doc_id long, text string, line_no int, kept string, n_chars long")


def test_deduplicated_texts(spark):
    df = odd(spark)
    found = lines.deduplicate(df, "doc_id", "text")
    assert found.columns == df.columns
    expected = [(0, ""), (1, f"{LONG}\n\nshort"), (2, "new"), (4, ""), (5, ""), (6, "\n \n"), (7, "x" * 30_000), (7, "x" * 30_000), (8, "sharply")]
    rows = sorted((r.doc_id or 0, r.text or "") for r in found.collect())
    assert rows == expected[1:]
    assert all(r.n_chars == len(r.text or "") for r in found.collect())
    assert lines.deduplicate(df.limit(0), "doc_id", "text").count() == 0


def test_classes(spark):
    found = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in lines.line_classes(odd(spark), "doc_id", "text").collect()}
    assert found[(1, 3)] == found[(2, 1)] == found[(3, 0)] == (1, 0, False) and found[(1, 0)] == (1, 0, True)
    assert found[(2, 0)] == found[(3, 1)] == found[(None, 0)] == (1, 2, False) and found[(8, 1)] == (8, 1, True)


def test_main_path_is_native(spark, sf_dir):
    plan = lines.op1_lines(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_clashing_names(spark):
    df = odd(spark).withColumnsRenamed({"line_no": "dedup_id", "kept": "dedup_drop"})
    assert lines.deduplicate(df, "doc_id", "text").columns == df.columns


def test_short_lines(spark):
    """Lines of 2k + 1 code points are near others; shorter ones only equal."""
    df = spark.createDataFrame([(1, "abcde\nabcd"), (2, "abcxy\nabxy\nabcd")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in lines.deduplicate(df, "doc_id", "text").collect()} == {(1, "abcde\nabcd"), (2, "abxy")}


def test_a_shared_segment_makes_no_pairs_of_unlike_lines(spark):
    rng = random.Random(3)
    rows = [(i, "the same start of every line, " + "".join(rng.choices("abcdefghij ", k=60))) for i in range(300)]
    rows.append((300, rows[0][1][:-1] + "!"))
    assert [tuple(r) for r in lines.edit_links(spark.createDataFrame(rows, "row long, line string")).collect()] == [(0, 300)]
