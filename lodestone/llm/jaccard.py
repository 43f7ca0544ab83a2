"""N-gram Jaccard join by chosen paths.

A text is the set of its word 5-grams, embedded in fixed positions that each hold a min-hash: two sets
agree in a position with the probability of their Jaccard similarity. From a root, a node of the
chosen-path tree samples a few positions, the same for all sets that reach it, and splits its sets by
the values there. Small nodes are compared by brute force on sketches; large ones are split again, and
at the last level compared in blocks. Runs are repeated with other roots, until the positions that these
draw give the target recall. Loosely connected sets are then compared exactly, in blocks, which gives links and classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import components, discard, kgrams, materialise, mix64, python_batches, table, text_words

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.99
#: Positions of a set, levels of the tree, sets of a node for brute force, sets compared at a time.
POSITIONS, DEPTH, LIMIT, TILE = 128, 3, 100, 128
#: A group is cut into blocks of TILE sets, into BLOCKS of them at most unless a block would hold more than BLOCK_BYTES; each set goes to so many pairs of blocks.
BLOCKS, BLOCK_BYTES = 16, 16 << 20
_A = mix64(np.arange(1, POSITIONS + 1)) | np.uint64(1)
_B = mix64(np.arange(1001, POSITIONS + 1001))
#: A node samples a position with probability 1 / (threshold * positions).
SEED, _RATE, _PLACES = 7, np.uint64(int(2**64 / (THRESHOLD * POSITIONS))), mix64(np.arange(POSITIONS) + 5000)


def survival(depth: int = DEPTH) -> float:
    """Probability that a pair at the threshold still shares a node at this level of one run.

    A node that both reach samples a position with probability 1 / (threshold * positions), so that one
    shared position is expected: a critical branching process with Poisson children.
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def _roots(runs: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs' roots, and the (run, position) pairs that they sample: the same for all sets, as they are drawn once."""
    roots = mix64(np.arange(runs) + seed * 1000)
    return roots, *np.nonzero(mix64(roots[:, None] ^ _PLACES) < _RATE)


def recall_of(runs: int, seed: int = SEED) -> float:
    """Probability that runs with just these roots find a pair at the threshold, whatever the sizes of nodes.

    Of positions that the roots sample, each is shared with the probability of the threshold; a shared one
    leads on, in each run that samples it, with the probability that the levels below survive.
    """
    _, _, at = _roots(runs, seed)
    times = np.bincount(at, minlength=POSITIONS)
    return 1 - float(np.prod(1 - THRESHOLD + THRESHOLD * (1 - survival(DEPTH - 1)) ** times))


def runs_for(recall: float) -> int:
    return next(n for n in range(1, 10_000) if recall_of(n) >= recall)


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The set of hashes of the text's word n-grams; of all its words if there are fewer."""
    return np.unique(kgrams(text_words(text)[0], n))


def set_hash(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a hash of a set."""
    return tuple(int((mix64(grams ^ a).sum(dtype=np.uint64) + np.uint64(len(grams)) * b).astype(np.int64)) for a, b in ((_A[0], _B[0]), (_A[1], _B[1])))


def min_hashes(grams: np.ndarray) -> np.ndarray:
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(grams), 2048):
        part = (grams[i : i + 2048, None] * _A + _B) >> np.uint64(32)
        np.minimum(out, part.min(axis=0).astype(np.uint32), out=out)
    return out


def paths(values: np.ndarray, runs: int, seed: int = SEED) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each set (row of min-hashes), per level the nodes it reaches: (parents, nodes)."""
    n = len(values)
    roots, r, drawn = _roots(runs, seed)
    owner = np.repeat(np.arange(n), runs)
    node = np.tile(roots, n)
    levels = []
    for level in range(DEPTH):
        # the first level's nodes are the same for all sets: their positions are drawn once
        if level == 0:
            at = (np.arange(n)[:, None] * runs + r).ravel()
            i = np.tile(drawn, n)
        else:
            parts = [np.nonzero(mix64(node[a : a + 20_000, None] ^ _PLACES) < _RATE) for a in range(0, len(node), 20_000)] or [(np.empty(0, int), np.empty(0, int))]
            at = np.concatenate([p[0] + k * 20_000 for k, p in enumerate(parts)])
            i = np.concatenate([p[1] for p in parts])
        child = mix64(node[at] * _A[1] + mix64(values[owner[at], i].astype(np.uint64) * np.uint64(POSITIONS) + i.astype(np.uint64)))
        levels.append((owner[at], node[at].view(np.int64), child.view(np.int64)))
        owner, node = owner[at], child
    out = [[] for _ in range(n)]
    for own, parent, child in levels:
        cuts = np.searchsorted(own, np.arange(n + 1))
        for s in range(n):
            out[s].append((parent[cuts[s] : cuts[s + 1]], child[cuts[s] : cuts[s + 1]]))
    return out


def _signatures(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ids = np.empty((batch.num_rows, POSITIONS), np.uint32), []
            for i, t in enumerate(batch.column("text")):
                grams = shingles(t.as_py())
                values[i] = min_hashes(grams)
                ids.append(set_hash(grams) if len(grams) else (None, None))
            tree = paths(values, runs)
            columns = [*(batch.column(c) for c in ("doc_id", "t1", "t2")), *(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), pa.array([v.tobytes() for v in (values & 0xFF).astype(np.uint8)], pa.binary())]
            names = ["doc_id", "t1", "t2", "s1", "s2", "sketch"]
            for level in range(DEPTH):
                if level:
                    columns.append(pa.array([t[level][0] for t in tree], pa.list_(pa.int64())))
                    names.append(f"p{level}")
                columns.append(pa.array([t[level][1] for t in tree], pa.list_(pa.int64())))
                names.append(f"k{level}")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' bounds; rows are sorted by the first keys columns, which are longs."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table, ended: bool) -> tuple[pa.Table, np.ndarray, pa.Table | None]:
        marks = np.stack([rows.column(i).to_numpy() for i in range(keys)])
        at = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        bounds = np.concatenate(([0], at, [rows.num_rows]))
        if ended:
            return rows, bounds, None
        return rows.slice(0, bounds[-2]), bounds[:-1], rows.slice(bounds[-2])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = held[0], held[-1]
        if len(held) > 1 and all(first.column(i)[0] == last.column(i)[-1] for i in range(keys)):
            continue  # one group goes on
        done, bounds, rest = cut(pa.Table.from_batches(held), False)
        if done.num_rows:
            yield done, bounds
        held = rest.combine_chunks().to_batches()
    if held:
        done, bounds, _ = cut(pa.Table.from_batches(held), True)
        yield done, bounds


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n nodes. near(i, others): which of the others i is linked to; a node that was reached is not asked for again."""
    left, edges = np.arange(n), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            found = left[hit].tolist()
            left = left[~hit]
            edges += [(i, j) for j in found]
            todo += found
    return edges


def across(n: int, m: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges between the first n of m nodes and the others that connect what edges among either don't: one for each two parts that are linked."""
    one = np.arange(n), np.arange(n, m)
    inside = [(int(side[i]), int(side[j])) for side in one for i, j in forest(len(side), lambda i, left, side=side: near(int(side[i]), side[left]))]
    between = ((i, j) for i in range(n) for j in one[1][near(i, one[1])].tolist())
    return spanning([*inside, *between])[len(inside) :]


def _compare_sketches(cutoff: float):
    """Rows (node, pair, side, set_id, sketch), sorted by node and pair -> edges of likely links: a spanning forest of a block, and what connects two blocks' forests."""
    need = math.ceil(cutoff * POSITIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in groups(batches, 2):
            ids, side = rows.column("set_id").to_numpy(), rows.column("side").to_numpy()
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            same = np.count_nonzero(sketch[two] == sketch[two + 1], axis=1) >= need
            a, b = [ids[two[same]]], [ids[two[same] + 1]]
            for i in np.flatnonzero(sizes > 2):
                at = np.arange(bounds[i], bounds[i + 1])
                at = at[np.argsort(side[at], kind="stable")]
                own, names, first = sketch[at], ids[at], int(np.searchsorted(side[at], side[at[0]], side="right"))
                near = lambda i, left, own=own: np.count_nonzero(own[left] == own[i], axis=1) >= need
                if edges := forest(len(own), near) if first == len(own) else across(first, len(own), near):
                    x, y = np.array(edges).T
                    a.append(names[x])
                    b.append(names[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of hashes."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[at] > 1
    _, at = np.unique(at[keep], return_inverse=True)
    owner = owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(sets), len(sets)))
    width = 4096
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [start, start + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[a:b], at[a:b] - start] = 1
        out += dense @ dense.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _compare_sets(threshold: float):
    """Rows (root, pair, side, set_id, copies, grams), sorted by root and pair -> kind 0: a set and the rows it links to here; kind 1: edges.

    A group is compared tile by tile; if it has two sides, only pairs across them are its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in groups(batches, 2):
            out: list[tuple[int, int, int]] = []
            ids, side, copies, packed = *(rows.column(c).to_numpy() for c in ("set_id", "side", "copies")), rows.column("grams")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                # repeated rows may bring a set in twice
                at = a + np.unique(ids[a:b], return_index=True)[1]
                at = at[np.argsort(side[at], kind="stable")]
                halves = np.split(at, np.flatnonzero(np.diff(side[at])) + 1)
                tiles = [[h[i : i + TILE] for i in range(0, len(h), TILE)] for h in halves]
                pairs = [(x, y) for x in tiles[0] for y in tiles[1]] if len(tiles) > 1 else [(x, y) for i, x in enumerate(tiles[0]) for y in tiles[0][i:]]
                links, edges = dict.fromkeys(ids[at].tolist(), 0), []
                for x, y in pairs:
                    both = x if x is y else np.concatenate((x, y))
                    if len(both) < 2:
                        continue
                    sets = [np.frombuffer(packed[int(i)].as_py(), np.uint64) for i in both]
                    common, size = common_counts(sets), np.array([len(s) for s in sets])
                    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
                    np.fill_diagonal(linked, False)
                    if x is not y:  # each tile by itself is another pair's
                        linked[: len(x), : len(x)] = linked[len(x) :, len(x) :] = False
                    names = ids[both].tolist()
                    for name, n in zip(names, (linked @ copies[both]).tolist(), strict=True):
                        links[name] += int(n)
                    edges += [(names[i], names[j]) for i, j in forest(len(both), lambda i, left, linked=linked: linked[i, left])]
                out += [(0, x, n) for x, n in links.items() if n]
                out += [(1, x, y) for x, y in spanning(edges)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "x", "y"])

    return run


def spanning(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those edges that connect what earlier ones don't."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in edges:
        if (x := top(a)) != (y := top(b)):
            root[x] = y
            out.append((a, b))
    return out


def _in_blocks(df: DataFrame, n: F.Column, size: F.Column) -> DataFrame:
    """Deal each group of n sets, size bytes together, into blocks and give each row to the pairs of blocks that it takes part in: columns pair and side."""
    blocks = F.least(F.ceil(n / TILE), F.greatest(F.lit(BLOCKS), F.ceil(size / BLOCK_BYTES))).cast("long")
    df = df.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("set_id"), "blocks"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return df.withColumn("pair", F.least("side", "other") * F.lit(1 << 31) + F.greatest("side", "other"))


def classified(docs: DataFrame, doc_id: str, text: str, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """See near_duplicates; also t1, t2 (128 bits of a hash of the text, null for a null one) and kept: true for one row, or rows alike in id and text, of each class.

    Of a class the row with the smallest id (null last), then hash, is kept.
    """
    spark = docs.sparkSession
    python_batches(spark)
    runs = runs_for(recall)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"t1": F.when(F.col("text").isNotNull(), F.xxhash64("text")), "t2": F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text"))})
    kinds = ", ".join(f"p{i} array<long>, k{i} array<long>" if i else "k0 array<long>" for i in range(DEPTH))
    signed = materialise(rows.mapInArrow(_signatures(runs), f"doc_id long, t1 long, t2 long, s1 long, s2 long, sketch binary, {kinds}"), "signed")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t1", "t2")
    paths_of = [c for i in range(DEPTH) for c in ((f"p{i}", f"k{i}") if i else ("k0",))]
    sets = signed.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min(place).alias("place"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("sketch", *paths_of)])
    sets = materialise(sets.withColumn("set_id", F.monotonically_increasing_id()), "sets")

    leaves, opened, used = None, None, []
    for level in range(DEPTH):
        if level == 0:
            here = sets.select("set_id", F.explode("k0").alias("node"))
        else:
            here = sets.select("set_id", F.explode(F.arrays_zip(F.col(f"p{level}").alias("p"), F.col(f"k{level}").alias("k"))).alias("z")).select("set_id", F.col("z.p").alias("parent"), F.col("z.k").alias("node"))
            here = here.join(opened.withColumnRenamed("node", "parent"), "parent", "left_semi")
        sizes = materialise(here.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), f"nodes{level}")
        used.append(sizes)
        shut = sizes if level == DEPTH - 1 else sizes.where(F.col("n") <= LIMIT)
        found = here.select("set_id", "node").join(shut, "node")
        leaves = found if leaves is None else leaves.unionByName(found)
        opened = sizes.where(F.col("n") > LIMIT).select("node")
    leaves = materialise(leaves, "leaves")
    cutoff = threshold - 4 * math.sqrt(threshold * (1 - threshold) / POSITIONS)
    likely = _in_blocks(leaves.join(sets.select("set_id", "sketch"), "set_id"), F.col("n"), F.col("n") * POSITIONS)
    likely = likely.select("node", "pair", "side", "set_id", "sketch").repartition("node", "pair").sortWithinPartitions("node", "pair")
    loose = materialise(components(likely.mapInArrow(_compare_sketches(cutoff), "a long, b long")), "loose")
    known = materialise(sets.select("set_id", "s1", "s2", "place", "copies"), "known")
    discard(leaves, sets, *used)

    active = loose.join(known, loose.node == known.set_id).select("root", "set_id", "s1", "s2", "copies", F.col("place.doc_id").alias("at"), F.col("place.t1").alias("at1"))
    active = materialise(active, "active")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column("text")]
            same = pa.array([len(g) > 0 and set_hash(g) == i for g, i in zip(found, zip(*(batch.column(c).to_pylist() for c in ("s1", "s2")), strict=True), strict=True)], pa.bool_())
            made = [pa.array([len(g) for g in found], pa.int64()), pa.array([g.tobytes() for g in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("root", "set_id", "copies")], *made], ["root", "set_id", "copies", "n_grams", "grams"]).filter(same)

    # merged at every size: a broadcast that small inputs would get says nothing about large ones
    fetched = rows.hint("merge").join(active, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("t1") == F.col("at1"))).select("root", "set_id", "s1", "s2", "copies", "text")
    fetched = materialise(fetched.mapInArrow(grams, "root long, set_id long, copies long, n_grams long, grams binary"), "grams")
    of_class = materialise(fetched.groupBy("root").agg(F.count("*").alias("n"), F.sum(8 * F.col("n_grams")).alias("size")).where("n > 1"), "sizes")
    pairs = _in_blocks(fetched.join(of_class, "root"), F.col("n"), F.col("size")).select("root", "pair", "side", "set_id", "copies", "grams").repartition("root", "pair").sortWithinPartitions("root", "pair")
    exact = materialise(pairs.mapInArrow(_compare_sets(threshold), "kind long, x long, y long"), "exact")
    discard(loose, active, fetched, of_class)

    links = exact.where("kind = 0").groupBy("x").agg(F.sum("y").alias("links"))
    classes = components(exact.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))
    rooted = known.join(links, F.col("set_id") == F.col("x"), "left").join(classes, F.col("set_id") == F.col("node"), "left")
    rooted = materialise(rooted.select("s1", "s2", "place", F.coalesce("root", "set_id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rooted")
    first = rooted.groupBy("root").agg(F.min("place").alias("first"))
    found = materialise(rooted.join(first, "root").select("s1", "s2", "first", "n_links"), "classes")
    discard(known, exact, rooted)
    out = signed.select("doc_id", "t1", "t2", "s1", "s2").join(found, ["s1", "s2"], "left")
    kept = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2")))
    class_id = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", "t1", "t2", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, doc_id: str, text: str, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Classes and links of texts whose sets of word 5-grams have a Jaccard similarity of threshold or more.

    Words are runs without ASCII white space, in lower case. Returns one row per row of docs:
    doc_id, class_id (the smallest id of the class: texts connected by links), n_links (other rows linked to it, copies included). Null
    or empty texts have no set: they are their own class. Rows with a null id take part; class_id is null if no row of a class has one.
    Repeated rows count as copies. Extra columns are left out; an empty table gives no rows. A pair at
    the threshold is found with probability recall at least; links within a class are complete and exact.
    """
    return classified(docs, doc_id, text, threshold, recall).select("doc_id", "class_id", "n_links")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {NGRAM} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {NGRAM} + 2), lambda i: array_to_string(w[i:i + {NGRAM - 1}], ' '))) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT i.a, i.b FROM i JOIN n x ON i.a = x.doc_id JOIN n y ON i.b = y.doc_id WHERE i.n >= {THRESHOLD} * (x.n + y.n - i.n) - 1e-9
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS class_id FROM r GROUP BY 1
), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT d.doc_id, c.class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
