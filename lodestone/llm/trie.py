"""The prefix trie of conversations, summed up by heavy paths.

A node is known by its depth and 128 bits of a hash of the turns that lead to it: the xor of a hash of each turn and its
place, which a prefix scan gives for conversations of any length. Counts per node are plain aggregates. For sums over
subtrees every node chooses the child with the most conversations as its heavy one; heavy edges form paths, and a path
from the root has at most log2(conversations) light edges, since each of them at least halves the conversations. Each
path ends in a leaf, whose smallest conversation names it, so that a conversation's own rows are the path's array and the
path begins at the conversation's deepest light node. A path's total is handed to the path that it hangs on, level of
light edges after level, deepest first; then suffix sums along all paths at once give every node's subtree.

No conversation, node or path is gathered in one task: scans run in sorted slices, and joins meet written tables, whose skewed keys
adaptive execution splits. The digests of conversations that end at a node are streamed from strings of a slice each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc32_sql, python_batches, table
from lodestone.operators.slices import SLICE, SUM, XOR, numbered, running, sliced
from lodestone.sources.shared import discard, materialise

#: Runs that aren't ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Bounds what a slice's string of ids can hold before it is cut: rows of one slice and node in one string.
ID_ROWS = 1 << 17


def rebuilt(conversations: DataFrame, step: int, shares: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one, as written tables.

    conversations: conv_id, turn, role, text (other columns are ignored). Turns are ordered by turn, null first, those of one turn by
    the MD5 of role and text; null role or text is empty; a null conv_id takes no part; conv_id % step is that of SQL (negative for
    negative ids). Conversation c gets the first h = crc32(c) % shares turns of c - c % step, as many as there are, then its own after
    its first h. Returns turns (c, d: place from 1, a1, a2: hashes of the turn, words) and conversations (c).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.md5(F.concat(role, F.lit("\0"), text)).alias("tie"),
        F.xxhash64(role, text).alias("a1"), F.xxhash64(F.lit(1), role, text).alias("a2"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    t = materialise(numbered(turns, ["c"], ["turn", "tie"], "i").select("c", "i", "a1", "a2", "words"), "turns")
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(shares))
    convs = t.groupBy("c").agg(F.max("i").alias("n")).select("c", "n", (F.col("c") - F.col("c") % step).alias("base"), h.alias("h"))
    convs = materialise(convs, "convs")
    lent = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    shift = convs.join(lent, "base", "left").select("c", (F.least("h", F.coalesce("base_n", F.lit(0))) - F.col("h")).alias("shift")).where("shift <> 0")
    own = t.where(F.col("i") > h).join(shift, "c", "left").select("c", (F.col("i") + F.coalesce("shift", F.lit(0))).alias("d"), "a1", "a2", "words")
    first = t.where(F.col("i") < shares).select(F.col("c").alias("base"), "i", "a1", "a2", "words")
    taken = convs.select("c", "base", "h").join(first, "base").where("i <= h").select("c", F.col("i").alias("d"), "a1", "a2", "words")
    out = materialise(own.unionByName(taken), "rebuilt"), convs.select("c")
    discard(t)
    return out


def _ends(last: DataFrame) -> DataFrame:
    """For each node (d, k1, k2) the SHA-256 of its conversations' ids in order, comma-joined.

    Ids are sorted in slices; a slice's ids of a node make strings, and a node's strings are hashed one after the other as they come.
    """
    key = ["d", "k1", "k2"]
    cut = sliced(last, [*key, "c"]).groupBy(SLICE, *key, F.floor(F.col("c") / ID_ROWS).alias("part"))
    strings = materialise(cut.agg(F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("ids")), "ends")

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for part in parts:
            out = []
            for d, k1, k2, ids in zip(part["d"], part["k1"], part["k2"], part["ids"], strict=True):
                if (d, k1, k2) == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, digest.hexdigest()))
                at, digest = (d, k1, k2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*key, "ends_sha256"])
        if at:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*key, "ends_sha256"])

    return strings.repartition(*key).sortWithinPartitions(*key, SLICE, "part").select(*key, "ids").mapInPandas(stream, "d long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per distinct sequence of first turns, from the root's empty one.

    turns: (c, d, a1, a2, words), places d from 1 without gaps; convs: every c once, also those without turns. Returns conv_id (smallest member),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree: other
    members times words of the last turn) and ends_sha256 (of members without further turns). No conversations: no rows.
    """
    spark = turns.sparkSession
    python_batches(spark)
    key, up = ["d", "k1", "k2"], ["pd", "p1", "p2"]
    own = turns.select("c", "d", F.xxhash64("d", "a1", "a2").alias("x1"), F.xxhash64(F.lit(2), "a2", "a1", "d").alias("x2"), "words")
    r = running(own, ["c"], ["d"], {"k1": ("x1", XOR), "k2": ("x2", XOR)})
    r = materialise(r.select("c", *key, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words"), "prefixes")

    zero = F.lit(0).cast("long")
    nodes = r.groupBy(*key).agg(F.min("c").alias("m"), F.count("*").alias("n"), F.max("words").alias("w"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = convs.agg(F.min("c").alias("m"), F.count("*").alias("n")).where("n > 0").select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "m", "n", zero.alias("w"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = materialise(nodes.unionByName(root), "nodes")
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    kids = kids.agg(F.count("*").alias("n_children"), F.min(F.struct((-F.col("n")).alias("n"), "m", "k1", "k2")).alias("heavy"))
    nodes2 = materialise(nodes.join(kids, key, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    # each node with its parent: its conv_id, and whether the edge to it is heavy
    parents = nodes2.where("n_children > 0").select(F.col("d").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("m").alias("parent_m"), F.col("heavy.k1").alias("h1"), F.col("heavy.k2").alias("h2"))
    v = nodes2.drop("heavy").withColumn("pd", F.col("d") - 1).join(parents, up, "left")
    v = materialise(v.select(*key, *up, "m", "n", "w", "n_children", "parent_m", ((F.col("k1") != F.col("h1")) | (F.col("k2") != F.col("h2"))).alias("light")), "nodes")
    discard(nodes, nodes2)

    # a path for each leaf: from the deepest light node of its smallest conversation down to the leaf
    leaves = v.where("n_children = 0").select(F.col("m").alias("c"), F.col("d").alias("leaf_d"))
    chain = materialise(r.join(leaves, "c", "left_semi").select("c", *key), "chains")
    bends = chain.join(v.where("light").select(*key), key).groupBy("c").agg(F.max("d").alias("head"), F.count("*").alias("level"))
    paths = materialise(leaves.join(bends, "c", "left").select("c", F.coalesce("head", zero).alias("head"), F.coalesce("level", zero).alias("level")), "paths")
    on = chain.join(paths, "c").where("d >= head").select("c", *key, "head", "level")
    on = on.unionByName(paths.where("head = 0").select("c", zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "head", "level"))
    tokens, leaf = ((F.col("n") - 1) * F.col("w")).alias("tokens"), (F.col("n_children") == 0).cast("long").alias("leaves")
    placed = materialise(on.join(v, key).select("c", *key, *up, "head", "level", tokens, leaf), "placed")
    discard(chain)

    # totals of paths, handed to the paths that they hang on, deepest level of light edges first
    totals = placed.groupBy("c").agg(F.sum("tokens").alias("tokens"), F.sum("leaves").alias("leaves"))
    heads = placed.where("d = head AND level > 0").select("c", "level", *up)
    hosts = placed.select(F.col("d").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("host"))
    hung = materialise(heads.join(totals, "c").join(hosts, up), "hung")
    top = hung.agg(F.max("level")).first()[0] or 0
    done: list[DataFrame] = []
    for level in range(top, 0, -1):
        here = hung.where(F.col("level") == level)
        if done:
            got = done[-1].groupBy(F.col("host").alias("c")).agg(F.sum("tokens").alias("more_tokens"), F.sum("leaves").alias("more_leaves"))
            here = here.join(got, "c", "left").withColumn("tokens", F.col("tokens") + F.coalesce("more_tokens", zero)).withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", zero))
        done.append(materialise(here.select("host", *up, "tokens", "leaves"), "level"))
    rows = placed.select("c", *key, "tokens", "leaves")
    if done:
        light = reduce(DataFrame.unionByName, done).groupBy(F.col("pd").alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("tokens").alias("more_tokens"), F.sum("leaves").alias("more_leaves"))
        rows = rows.join(light, key, "left").select("c", *key, (F.col("tokens") + F.coalesce("more_tokens", zero)).alias("tokens"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"))
    rows = rows.withColumn("up", -F.col("d"))
    sums = running(rows, ["c"], ["up"], {"saved_tokens": ("tokens", SUM), "n_leaves": ("leaves", SUM)}).select(*key, "saved_tokens", "n_leaves")

    last = r.groupBy("c").agg(F.max(F.struct(*key)).alias("e")).select("c", "e.*")
    empty = convs.join(r.select("c").distinct(), "c", "left_anti").select("c", zero.alias("d"), zero.alias("k1"), zero.alias("k2"))
    found = v.join(sums, key).join(_ends(last.unionByName(empty)), key, "left")
    return found.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("parent_m").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


STEP, SHARES = 20, 4


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), STEP, SHARES))


SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), v AS (SELECT c, count(*) AS n, c - c % {STEP} AS base, {crc32_sql("CAST(c AS VARCHAR)")} % {SHARES} AS h FROM t GROUP BY c
), s AS (
  SELECT v.c, t.i AS d, r, x FROM v JOIN t ON t.c = v.base AND t.i <= v.h
  UNION ALL
  SELECT v.c, t.i - v.h + least(v.h, coalesce(b.n, 0)) AS d, r, x FROM v JOIN t ON t.c = v.c AND t.i > v.h LEFT JOIN v b ON b.c = v.base
), k AS (
  SELECT c, d, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w, list(md5(len(r) || ':' || r || x)) OVER (PARTITION BY c ORDER BY d) AS key FROM s
  UNION ALL SELECT c, 0, 0, [] FROM v
), l AS (SELECT c, max(d) AS d FROM k GROUP BY c
), e AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM l JOIN k USING (c, d) GROUP BY key
), n AS (SELECT key, any_value(d) AS d, min(c) AS m, count(*) AS n, any_value(w) AS w FROM k GROUP BY key
), p AS (SELECT n.*, q.m AS parent, (SELECT count(*) FROM n o WHERE o.d = n.d + 1 AND o.key[1:n.d] = n.key) AS kids FROM n LEFT JOIN n q ON q.d = n.d - 1 AND q.key = n.key[1:n.d - 1]
), u AS (SELECT a.key, count(*) FILTER (p.kids = 0) AS leaves, sum((p.n - 1) * p.w) AS saved FROM p JOIN k a ON a.c = p.m AND a.d <= p.d GROUP BY a.key)
SELECT p.m AS conv_id, CAST(p.d AS BIGINT) AS depth, parent AS parent_conv_id, p.n AS n_convs, kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM p JOIN u USING (key) LEFT JOIN e USING (key)
"""
