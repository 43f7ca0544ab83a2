"""A Merkle manifest of a dataset: every row's leaf, proof and verification.

Leaves are numbered in order inside their group by a prefix scan over sorted slices, so that a group of any size is spread. Aligned
blocks of FANOUT**HEIGHT consecutive nodes are worked off by one task each: a block's digests are one contiguous matrix of 64
bytes a row, which is reshaped by the fanout and hashed row by row, level after level; a node's siblings are found by
index arithmetic. Blocks' roots are the nodes of the next pass, until a node a group remains; the groups' roots form one more
tree. Then the passes run backwards: a block's proof is handed to its nodes, and each leaf is folded up to the root.

Only leaves (not texts) are moved, at most FANOUT**HEIGHT in a task, and a proof of a few KB once for each block.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import crc32_sql, python_batches, table
from lodestone.operators.slices import numbered
from lodestone.sources.shared import discard, materialise

#: Consecutive nodes that have one parent, and levels that a block spans.
FANOUT, HEIGHT = 8, 4
BLOCK = FANOUT**HEIGHT

_NODES = "g string, i long, digest string, n long"
_PATHS = "g string, i long, at array<int>, others array<string>"


def field(c: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 length, a colon and itself; "-" if it is null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)


def _hash_rows(rows: np.ndarray) -> bytes:
    return b"".join(sha256(row).hexdigest().encode() for row in rows)


def _levels(leaves: np.ndarray, alone: bool) -> list[np.ndarray]:
    """Digest matrices of a block from the leaves to its root.

    A block of a larger tree (not alone) has HEIGHT levels even where a single node is left; a tree of its own ends with one node.
    """
    out = [leaves]
    while len(out[-1]) > 1 if alone else len(out) <= HEIGHT:
        m = out[-1]
        full = len(m) // FANOUT * FANOUT
        joined = _hash_rows(m[:full].reshape(-1, 64 * FANOUT)) + (_hash_rows(m[full:].reshape(1, -1)) if full < len(m) else b"")
        out.append(np.frombuffer(joined, np.uint8).reshape(-1, 64))
    return out


def _run(m: np.ndarray, j: int) -> tuple[int, np.ndarray]:
    """A node's place in its run, and the run."""
    first = j // FANOUT * FANOUT
    return j - first, m[first : first + FANOUT]


def _up(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("i")
    n = int(part["n"].iloc[0])
    top = _levels(_matrix(part["digest"]), n <= BLOCK)[-1]
    return pd.DataFrame({"g": [part["g"].iloc[0]], "i": [int(part["i"].iloc[0]) // BLOCK], "digest": [top.tobytes().decode()], "n": [-(-n // BLOCK)]})


def _down(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """The nodes' paths: of each level the place in the run and the run's other digests, then those of the block."""
    nodes = nodes.sort_values("i")
    levels = _levels(_matrix(nodes["digest"]), int(nodes["n"].iloc[0]) <= BLOCK)[:-1]
    at, others = [], []
    for j in range(len(nodes)):
        runs = [_run(m, j // FANOUT**level) for level, m in enumerate(levels)]
        at.append([k for k, _ in runs] + list(above["at"].iloc[0]))
        others.append([np.delete(run, k, 0).tobytes().decode() for k, run in runs] + list(above["others"].iloc[0]))
    return pd.DataFrame({"g": nodes["g"].to_numpy(), "i": nodes["i"].to_numpy(), "at": at, "others": others})


def _prove(leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Each leaf's hashed proof, and the root that its digest of now (new, or leaf where that is null) folds to."""
    leaves = leaves.sort_values("i")
    levels = _levels(_matrix(leaves["digest"]), int(leaves["n"].iloc[0]) <= BLOCK)[:-1]
    upper = [(int(k), s.encode()) for k, s in zip(above["at"].iloc[0], above["others"].iloc[0], strict=True)]
    tail, proofs, roots = b"".join(s for _, s in upper), [], []
    for j, new in enumerate(leaves["new"].fillna(leaves["digest"])):
        proof, now = sha256(), new.encode()
        for level, m in enumerate(levels):
            k, run = _run(m, j // FANOUT**level)
            before, after = run[:k].tobytes(), run[k + 1 :].tobytes()
            proof.update(before + after)
            now = sha256(before + now + after).hexdigest().encode()
        proof.update(tail)
        for k, s in upper:
            now = sha256(s[: 64 * k] + now + s[64 * k :]).hexdigest().encode()
        proofs.append(proof.hexdigest())
        roots.append(now.decode())
    return leaves.assign(proof_sha256=proofs, folded_root=roots)[["row", "digest", "g", "proof_sha256", "folded_root"]]


def _blocks(nodes: DataFrame):
    return nodes.withColumn("b", F.floor(F.col("i") / BLOCK)).groupBy("g", "b")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Written tables of nodes, pass by pass, until each group has one."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(materialise(_blocks(out[-1]).applyInPandas(lambda part: _up(part.drop(columns="b")), _NODES), "merkle"))
    return out


def _paths(passes: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the nodes of the first pass but one (of the last pass's nodes: top), as g, i, at, others."""
    found = top
    for nodes in reversed(passes):
        found = _blocks(nodes).cogroup(found.groupBy("g", "i")).applyInPandas(lambda a, b: _down(a, b), _PATHS)
        found = materialise(found, "paths")
    return found


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Roots, proofs and verification of leaves.

    leaves: g (string, may be null), leaf (hex digest), new (the digest of now; null where unchanged) and further columns. Per group,
    leaves ascend by `order` and leaf (nulls first); equal rows are distinct leaves in any order. Groups' roots ascend by g, null first,
    bytewise. A group of one leaf has it as its root; one group's root is the root. No leaves: no rows. Returns the leaves' columns but
    new, and subroot, root, proof_sha256, folded_root and verified.
    """
    spark = leaves.sparkSession
    python_batches(spark)
    group = F.coalesce(F.concat(F.lit("1"), F.col("g")), F.lit("0"))  # keeps the order, null first
    given = leaves.columns
    kept = materialise(leaves.select(group.alias("g"), F.col("leaf").alias("digest"), "new", F.struct(*[c for c in given if c != "new"]).alias("row"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), "leaves")
    at = numbered(kept, ["g"], [*[f"_o{i}" for i in range(len(order))], "digest"], "i").withColumn("i", F.col("i") - 1)
    sizes = kept.groupBy("g").agg(F.count("*").alias("n"))
    nodes = materialise(at.join(sizes, "g").select("g", "i", "digest", "n", "new", "row"), "nodes")
    discard(kept)
    passes = _climb(nodes.select("g", "i", "digest", "n"))
    subroots = passes[-1].select("g", F.col("digest").alias("subroot"))
    # the groups' roots are a tree of one group
    many = subroots.withColumn("all", F.lit("all"))
    tops = numbered(many, ["all"], ["g"], "i").select(F.col("all").alias("g"), (F.col("i") - 1).alias("i"), F.col("subroot").alias("digest"), F.col("g").alias("of"))
    tops = materialise(tops.crossJoin(many.agg(F.count("*").alias("n"))), "tops")
    over = _climb(tops.select("g", "i", "digest", "n"))
    none = F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("others")
    root = over[-1].select(F.col("digest").alias("root"))
    above = _paths(over[:-1], over[-1].select("g", "i", *none))
    above = above.join(tops.select("i", "of"), "i").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("i"), "at", "others")
    above = _paths(passes[1:-1], above) if len(passes) > 1 else above
    schema = f"row {nodes.schema['row'].dataType.simpleString()}, digest string, g string, proof_sha256 string, folded_root string"
    if len(passes) == 1:  # every group has one leaf
        above = materialise(above, "paths")
    proven = _blocks(nodes).cogroup(above.groupBy("g", "i")).applyInPandas(lambda a, b: _prove(a, b), schema)
    found = proven.join(subroots, "g").crossJoin(F.broadcast(root))  # one row
    return found.select(*[F.col("row")[c].alias(c) for c in given if c != "new"], "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


FIELDS, EVERY = ("doc_id", "source", "lang", "n_chars", "text"), 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by lang, verified against texts of which every third (by the id's CRC-32) lost its capitals; a null id is never among these."""
    docs = table(spark, sf_dir, "documents", *FIELDS)
    lower = F.translate("text", _UPPER, _UPPER.lower())
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0
    new = F.when(touched, digest_of([lower if c == "text" else F.col(c) for c in FIELDS]))
    rows = docs.select("doc_id", F.col("lang").alias("g"), digest_of([F.col(c) for c in FIELDS]).alias("leaf"), new.alias("new"))
    return manifest(rows, ["doc_id"]).drop("g")


def _sql(levels: int) -> str:
    """A tree's levels one after the other, each from the one before; trees of up to FANOUT**levels leaves."""
    enc = lambda c, v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c, text if c == "text" else f"CAST({c} AS VARCHAR)") for c in FIELDS) + ")"
    lower = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    ctes = [f"""f0 AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % {EVERY} = 0 THEN {leaf(lower)} END AS new FROM documents)""",
            "f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f0)",
            "a0 AS (SELECT lang AS g, i, leaf AS d FROM f)"]

    def climb(name: str) -> str:
        for k in range(levels):
            ctes.append(f"{name}c{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS (SELECT g, i // {FANOUT} AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}c{k} GROUP BY g, i // {FANOUT})")
        return f"{name}{levels}"

    subs = climb("a")
    ctes.append(f"b0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, d, g AS of FROM {subs})")
    tops = climb("b")
    steps = [("a", k, "f.lang", "f.i") for k in range(levels)] + [("b", k, "'all'", "o.i") for k in range(levels)]
    run = lambda name, k: f"r{name}{k} AS (SELECT g, i // {FANOUT} AS run, list(d ORDER BY i) AS ds FROM {name}c{k} WHERE n > 1 GROUP BY g, i // {FANOUT})"
    ctes += [run(name, k) for name, k, _, _ in steps]
    cols, joins = [], []
    for name, k, g, i in steps:
        t = f"x{name}{k}"
        at = f"{i} // {FANOUT**k}"
        joins.append(f"LEFT JOIN r{name}{k} {t} ON {t}.g IS NOT DISTINCT FROM {g} AND {t}.run = ({at}) // {FANOUT}")
        cols.append(f"{t}.ds[:({at}) % {FANOUT}] AS l{name}{k}, {t}.ds[({at}) % {FANOUT} + 2:] AS g{name}{k}, {t}.ds IS NOT NULL AS h{name}{k}")
    ctes.append(f"p AS (SELECT f.doc_id, f.leaf, coalesce(new, leaf) AS now, s.d AS subroot, t.d AS root, {', '.join(cols)} FROM f JOIN {subs} s ON s.g IS NOT DISTINCT FROM f.lang JOIN b0 o ON o.of IS NOT DISTINCT FROM f.lang CROSS JOIN {tops} t {' '.join(joins)})")
    names = [f"{name}{k}" for name, k, _, _ in steps]
    last = "now"
    for j, x in enumerate(names):
        ctes.append(f"q{j} AS (SELECT *, CASE WHEN h{x} THEN sha256(array_to_string(l{x}, '') || {last} || array_to_string(g{x}, '')) ELSE {last} END AS w{j} FROM {'p' if not j else f'q{j - 1}'})")
        last = f"w{j}"
    proof = " || ".join(f"coalesce(array_to_string(l{x}, '') || array_to_string(g{x}, ''), '')" for x in names)
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {last} AS folded_root, {last} = root AS verified FROM q{len(names) - 1}"


#: Up to 8**6 documents of a lang, and as many langs.
SQL = _sql(6)
