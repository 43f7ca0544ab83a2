import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import jaccard
from lodestone.llm.common import components


def brute(texts, threshold=0.8):
    """class and links of {id: text}."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links, parent = defaultdict(int), {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (root(k), links[k]) for k in keys}


def variants(seed, groups, copies, words=120):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(rng.randint(3, words))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = "new" + str(rng.random())
            out.append(" ".join(text))
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("groups, copies", [(60, 6), (1, 420)])
def test_equals_brute_force(spark, groups, copies):
    """The second case has one group that the tree can't split: it is compared in blocks."""
    texts = variants(groups, groups, copies) if groups > 1 else dict(enumerate(list(variants(3, 1, 1).values()) * 3)) | {100 + i: t for i, t in enumerate(hot(420))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(df, "doc_id", "text").collect()}
    assert found == brute(texts)


def hot(n):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(150)] = f"x{rng.random()}"
        out.append(" ".join(text))
    return out


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "one two three"), (None, "one two"), (6, "w " * 50_000), (7, "w " * 20), (8, "a b c d e"), (8, "a b c d e"), (9, "a b c d e")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, class_id int, root int")
    found = sorted(((r.doc_id or 0, r.class_id or 0, r.n_links) for r in jaccard.near_duplicates(df, "doc_id", "text").collect()))
    assert found == [(0, 3, 2), (1, 1, 0), (2, 2, 0), (3, 3, 2), (4, 3, 2), (5, 5, 0), (6, 6, 1), (7, 6, 1), (8, 8, 2), (8, 8, 2), (9, 8, 2)]
    assert jaccard.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_recall_of_a_run():
    """Pairs at the threshold share a last-level node about as often as the analysis says."""
    rng, met = np.random.default_rng(1), 0
    for _ in range(300):
        a = rng.integers(0, 2**32, jaccard.POSITIONS, dtype=np.uint32)
        b = np.where(rng.random(jaccard.POSITIONS) < 0.8, a, a + 1).astype(np.uint32)
        x, y = jaccard.paths(np.stack([a, b]), 1, int(rng.integers(1 << 30)))
        met += bool(set(x[-1][1].tolist()) & set(y[-1][1].tolist()))
    assert abs(met / 300 - jaccard.survival()) < 0.12


def test_recall_of_the_roots_that_are_drawn():
    """With all first-level nodes split, pairs at the threshold meet as often as recall_of says, and often enough."""
    rng, met = np.random.default_rng(2), 0
    runs = jaccard.runs_for(0.99)
    assert jaccard.recall_of(runs) >= 0.99 > jaccard.recall_of(runs - 1)
    a = rng.integers(0, 2**32, (400, jaccard.POSITIONS), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype(np.uint32)
    for x, y in zip(jaccard.paths(a, runs), jaccard.paths(b, runs), strict=True):
        met += bool(set(x[-1][1].tolist()) & set(y[-1][1].tolist()))
    assert met / 400 >= 0.97


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: root(k) for a, b in edges if a != b for k in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_blocks(spark, monkeypatch):
    """A group with more sets than BLOCKS blocks of TILE hold: larger blocks, compared tile by tile."""
    monkeypatch.setattr(jaccard, "TILE", 20)
    monkeypatch.setattr(jaccard, "BLOCKS", 3)
    texts = dict(enumerate(hot(150)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(df, "doc_id", "text").collect()}
    assert found == brute(texts)


def test_blocks_of_one_group_repeat_no_edges():
    """A large group of near copies makes about an edge a set, into however many blocks it is cut."""
    rng, n, blocks = np.random.default_rng(1), 400, 8
    sketch = np.tile(rng.integers(0, 256, jaccard.POSITIONS, np.uint8), (n, 1))
    sketch[np.arange(n), rng.integers(0, jaccard.POSITIONS, n)] ^= 1
    sketch[: n // 2] ^= 255  # two groups that aren't alike
    made = []
    for pair, (i, j) in enumerate((i, j) for i in range(blocks) for j in range(i, blocks)):
        sets = np.flatnonzero(np.isin(np.arange(n) % blocks, (i, j)))
        rows = {"node": np.zeros(len(sets), np.int64), "pair": np.full(len(sets), pair), "side": sets % blocks, "set_id": sets, "sketch": [sketch[s].tobytes() for s in sets]}
        made += list(jaccard._compare_sketches(0.6)(iter([pa.RecordBatch.from_pydict(rows)])))
    edges = [e for b in made for e in zip(*b.to_pydict().values(), strict=True)]
    assert len(jaccard.spanning(edges)) == n - 2 and all((a < n // 2) == (b < n // 2) for a, b in edges)
    assert len(edges) <= n + 2 * blocks * blocks


def test_edges_across_connect_all_that_is_linked():
    rng = np.random.default_rng(2)
    for m in range(2, 40):
        links = rng.random((m, m)) < 1.2 / m
        links |= links.T
        near, n = lambda i, others, links=links: links[i, others], m // 2
        halves = [e for e in jaccard.forest(n, near)] + [(i + n, j + n) for i, j in jaccard.forest(m - n, lambda i, o, links=links, n=n: links[i + n, o + n])]
        found = jaccard.across(n, m, near)
        assert all(links[i, j] and i < n <= j for i, j in found)
        assert len(jaccard.spanning(halves + found)) == len(jaccard.spanning([tuple(e) for e in np.argwhere(links).tolist() if e[0] != e[1]]))
