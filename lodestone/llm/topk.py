"""Exact top-k inner-product search by term-at-a-time accumulation.

Every vector is a sparse row of (dimension, weight) pairs. The candidates are cut into blocks; a
block keeps one postings list per dimension. A query scatters its weights times a dimension's
postings into one dense score array, a dimension after the other, for some queries at a time; a partition selection takes the
block's best, and a merge over the blocks gives the result. Queries are cut into blocks as well.
Candidate blocks are dealt to lanes and query blocks to shares; each pair of a lane and a share is
a group that one task reads in order: the share's queries (some 64 MB), then one candidate block after the
other. Nothing is joined or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import python_batches, table

_BLOCK = "block long, ids array<long>, sizes binary, dims binary, weights binary"


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them all, after that type's letter."""
    kind = next(t for t in "bhiq" if not len(x) or np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
    return kind.encode() + x.astype(f"<{kind}").tobytes()


def _wide(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, f"<{chr(data[0])}", offset=1).astype(kind)


def quantised(df: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """Replace the vector by floor(scale * x) as longs; drop vectors that are null or hold null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = df.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.withColumn(vector, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _pack(block_rows: int):
    """Pack a partition's rows into blocks: ids, the number of weights that aren't 0 in each row, and these with their dimensions."""

    def packed(cut: pd.DataFrame, number: int) -> pd.DataFrame:
        lengths = np.fromiter(map(len, cut["v"]), np.int64, len(cut))
        flat = np.concatenate([np.asarray(v, np.int64) for v in cut["v"]])
        rows = np.repeat(np.arange(len(cut)), lengths)
        dims = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        some = flat != 0
        return pd.DataFrame({"block": [number], "ids": [cut["id"].to_numpy(np.int64)], "sizes": [_narrow(np.bincount(rows[some], minlength=len(cut)))], "dims": [_narrow(dims[some])], "weights": [_narrow(flat[some])]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= block_rows:
                yield packed(pd.concat(held), number)
                number, held, size = number + 1, [], 0
        if size:
            yield packed(pd.concat(held), number)

    return run


#: A list that holds at least one in so many rows is kept for all rows, with zeros.
FULL = 8


def _postings(n: int, rows: np.ndarray, dims: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """(rows, weights) of each dimension; a list that holds many of the n rows gets a slice for its rows and a weight for each of them."""
    order = np.argsort(dims, kind="stable")
    rows, dims, weights = rows[order].astype(np.intp), dims[order], weights[order]
    at = np.flatnonzero(np.diff(dims, prepend=-1))
    out = {}
    for a, b in zip(at, np.append(at[1:], len(dims)), strict=True):
        out[int(dims[a])] = rows[a:b], weights[a:b]
        if FULL * (b - a) >= n:
            held = np.zeros(n, weights.dtype)
            held[rows[a:b]] = weights[a:b]
            out[int(dims[a])] = slice(None), held
    return out


#: Queries of a block whose score arrays are filled together.
TILE = 64


def _number(weights: np.ndarray, q_rows: np.ndarray, q_weights: np.ndarray) -> type:
    """The narrowest type that holds all inner products and their parts exactly: 4-byte floats, 8-byte floats or longs."""
    if not len(weights) or not len(q_weights):
        return np.float32
    bound = np.bincount(q_rows, np.abs(q_weights.astype(np.float64))).max() * np.abs(weights.astype(np.float64)).max()
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 52 else np.int64


def _accumulated(lists: dict[int, tuple[np.ndarray | slice, np.ndarray]], n: int, queries: int, rows: np.ndarray, dims: np.ndarray, weights: np.ndarray, number: type) -> np.ndarray:
    """Score arrays of some queries over n candidates: their weights times the postings, a dimension after the other.

    Lists that are kept for all candidates are added in one product of dense arrays.
    """
    scores, order = np.zeros((queries, n), number), np.argsort(dims, kind="stable")
    rows, dims, weights = rows[order], dims[order], weights[order].astype(number)
    at = np.flatnonzero(np.diff(dims, prepend=-1))
    terms = [(slice(a, b), *lists[int(dims[a])]) for a, b in zip(at, np.append(at[1:], len(dims)), strict=True) if int(dims[a]) in lists]
    whole = [t for t in terms if isinstance(t[1], slice)]
    if whole:
        dense = np.zeros((queries, len(whole)), number)
        for i, (own, _, _) in enumerate(whole):
            dense[rows[own], i] = weights[own]
        scores += dense @ np.stack([held for _, _, held in whole])
    for own, found, held in terms:
        if not isinstance(found, slice):
            scores[rows[own][:, None], found] += weights[own][:, None] * held  # a row occurs once in a list
    return scores


def _best_of(scores: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of each query's k highest scores that reach its bar, ties to smaller ids, without its own id. A query's k-th score raises its bar."""
    own = ids == q_ids[:, None]
    good = (scores >= bar[:, None].astype(scores.dtype)) & ~own
    if len(ids) > k and np.count_nonzero(good) > 4 * k * len(q_ids):
        others = np.where(own, LOWEST, scores).astype(scores.dtype) if own.any() else scores
        good &= scores >= np.partition(others, len(ids) - k, axis=1)[:, len(ids) - k, None]
    query, place = np.nonzero(good)
    order = np.lexsort((ids[place], -scores[query, place], query))
    query, place = query[order], place[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    query, place = query[kept], place[kept]
    last = np.flatnonzero(np.bincount(query, minlength=len(q_ids)) == k)
    bar[last] = np.maximum(bar[last], scores[last, place[np.searchsorted(query, last, side="right") - 1]].astype(np.int64))
    return query, place


#: The bar of a query that has no k scores yet.
LOWEST = np.iinfo(np.int64).min


def _search(k: int):
    """Rows sorted by (lane, share, side): a pair's query blocks are held, then each of its candidate blocks meets them all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for part in parts:
            for row in part.itertuples(index=False):
                if (row.lane, row.share) != at:
                    at, held = (row.lane, row.share), []
                ids, sizes, dims, weights = np.asarray(row.ids), _wide(row.sizes, np.int32), _wide(row.dims, np.int32), _wide(row.weights, np.int64)
                rows = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
                if not row.side:
                    held.append((ids, rows, dims, weights, np.full(len(ids), LOWEST)))
                    continue
                postings, out = {}, []
                for q_ids, q_rows, q_dims, q_weights, bar in held:
                    number = _number(weights, q_rows, q_weights)
                    if number not in postings:
                        postings[number] = _postings(len(ids), rows, dims, weights.astype(number))
                    for q in range(0, len(q_ids), TILE):
                        own, (a, b) = q_ids[q : q + TILE], np.searchsorted(q_rows, [q, q + TILE])
                        scores = _accumulated(postings[number], len(ids), len(own), q_rows[a:b] - q, q_dims[a:b], q_weights[a:b], number)
                        query, place = _best_of(scores, ids, own, k, bar[q : q + TILE])
                        out.append(pd.DataFrame({"query_id": own[query], "vec_id": ids[place], "score": scores[query, place].astype(np.int64)}))
                if out:
                    yield pd.concat(out)

    return run


#: Candidate blocks of a lane, and query blocks of a share, where all are full.
LANE, SHARE = 4, 64


def top_k(queries: DataFrame, candidates: DataFrame, k: int, block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """The k candidates of highest integer inner product for each query; ties go to the smaller id.

    queries, candidates: id long, v array<long>. Rows with a null id or vector take no part; a
    candidate of the query's own id is left out; fewer than k candidates give fewer rows; repeated
    candidate rows are ranked each; a repeated query id counts once; dimensions that one side
    lacks count as 0. Empty inputs give no rows. Returns query_id, rank, vec_id, score.
    """
    spark = candidates.sparkSession
    python_batches(spark)
    live = "id IS NOT NULL AND v IS NOT NULL"
    queries, candidates = (df.where(live).select("id", "v") for df in (queries, candidates))
    most = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lanes = max(1, min(most, -(-candidates.count() // (LANE * block_rows))))
    shares = max(1, -(-queries.count() // (SHARE * query_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    q = queries.dropDuplicates(["id"]).mapInPandas(_pack(query_rows), _BLOCK).withColumn("share", dealt(shares)).withColumn("lane", every(lanes))
    c = candidates.mapInPandas(_pack(block_rows), _BLOCK).withColumn("lane", dealt(lanes)).withColumn("share", every(shares))
    both = q.withColumn("side", F.lit(0)).unionByName(c.withColumn("side", F.lit(1)))
    # a task gets its blocks one by one, in order; a join could broadcast the copies, as Spark takes their size for that of the queries
    both = both.repartition("lane", "share").sortWithinPartitions("lane", "share", "side")
    found = both.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


K, QUERY_STEP = 5, 50


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return top_k(rows.where(F.col("id") % QUERY_STEP == 0), rows, K)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), terms AS (
  SELECT vec_id, unnest(e) AS w, generate_subscripts(e, 1) AS d FROM v
), q AS (SELECT * FROM terms WHERE vec_id % {QUERY_STEP} = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM q JOIN terms c ON q.d = c.d AND q.vec_id <> c.vec_id GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
