"""The manifest against a tree of lists."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Levels of a tree of lists, fanout 8."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        i //= 8
    return out


def brute(rows):
    """rows: (group, order, leaf, new)."""
    groups = {}
    for g, o, leaf, new in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append((o, leaf, new))
    trees = {g: climb([leaf for _, leaf, _ in rs]) for g, rs in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for g, rs in groups.items():
        for i, (o, leaf, new) in enumerate(rs):
            path = siblings(trees[g], i) + siblings(top, order.index(g))
            now = new or leaf
            for at, others in path:
                now = h(*others[:at], now, *others[at:])
            out.append((g, o, leaf, trees[g][-1][0], top[-1][0], h(*[x for _, others in path for x in others]), now, now == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "g string, o long, leaf string, new string, i int, digest string").repartition(3)
    out = merkle.manifest(df, ["o"])
    assert out.columns == ["g", "o", "leaf", "i", "digest", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.drop("i", "digest").collect()), key=repr)




@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 1, "é": 1, "z": 1}, {"a": 8, "b": 9, None: 7}, {str(i): 1 + i % 3 for i in range(20)}, {"a": 600, "b": 2}])
def test_manifest(spark, sizes):
    """Lone leaves, full and cut runs, a group without siblings, more groups than a run has; ties, nulls and repeated rows."""
    r = random.Random(3)
    rows = [(g, r.choice([None, *range(9)]), h(str(r.randrange(400))), None) for g, n in sizes.items() for _ in range(n)]
    rows = [(g, o, leaf, h(leaf) if leaf < "8" else None) for g, o, leaf, _ in rows]
    assert found(spark, rows) == brute(rows)


def test_many_blocks(spark):
    """A group above one block, whose last block has a single node."""
    rows = [("big", i, h(str(i)), h("x") if i % 7 == 0 else None) for i in range(merkle.BLOCK * 2 + 1)] + [("one", 1, h("a"), None)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_leaf_of_nulls_and_long_texts(spark):
    rows = [(None, None), (5, ""), (6, "Ünï" * 40000)]
    df = spark.createDataFrame(rows, "a long, b string")
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert [r[0] for r in df.select(merkle.digest_of([F.col("a"), F.col("b")])).collect()] == [h(enc(a), enc(b)) for a, b in rows]


def test_query(spark, sf_dir):
    """Leaves recomputed in Python; exactly those of changed texts fail."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = {r.doc_id: r for r in merkle.op13_merkle(spark, sf_dir).collect()}
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = []
    for r in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        leaf, new = (h(*map(enc, (r.doc_id, r.source, r.lang, r.n_chars, t))) for t in (r.text, low))
        rows.append((r.lang, r.doc_id, leaf, new if zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else None))
    assert {r[1]: r[2:] for r in brute(rows)} == {i: tuple(r)[1:] for i, r in out.items()}
    assert {v for v in (r.verified for r in out.values())} == {True, False}
