"""Helpers that the operators of this package share."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import discard, materialise

#: Rows and bytes in an Arrow batch on its way to Python: long texts make rows of 100 KB and more.
ARROW_ROWS, ARROW_BYTES = 1000, "8m"


def python_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


# ---------------------------------------------------------------- words as hashes

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64 (n a power of two)."""
    out = np.full(n, _P, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: ASCII white space, as bytes.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (starts, ends) of the maximal runs that aren't ASCII white space."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


#: Bytes hashed at a time, which bounds the memory of long texts; a longer word has another hash.
HASH_BYTES = 1 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out, i = [np.empty(0, np.uint64)], 0
    while i < len(starts):
        a, j = int(starts[i]), int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right"))
        if j <= i:
            digest = hashlib.blake2b(data[a : ends[i]], digest_size=8).digest()
            out.append(np.frombuffer(digest, "<u8").astype(np.uint64))
            j = i + 1
        else:
            out.append(_word_hashes(data[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a))
        i = j
    return np.concatenate(out)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial in a word's bytes, read off prefix sums, then mixed."""
    length = ends - starts
    # blocks keep the polynomial's powers small; a word's terms are weighed by their place in it
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.concatenate((np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))))
    powers = _powers(1 << max(10, int(place.max()).bit_length()))
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
    terms[_SPACE[data]] = 0
    sums = np.add.reduceat(terms, starts)
    return mix64(sums + length.astype(np.uint64) * _M2)


def text_words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the lower-cased text with the words' byte offsets in its UTF-8 form."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_spans(data)
    return word_hashes(data, starts, ends), starts, ends


def texts_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of many texts, one after the other, and the bounds of each text's words."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    starts, ends = word_spans(data)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
    return word_hashes(data, starts, ends), bounds


def kgrams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes, in order; of all words if there are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    out, power, size = words, _P, 1  # runs of size words as a polynomial, and _P to that power
    with np.errstate(over="ignore"):
        for bit in f"{k:b}"[1:]:
            out, power, size = out[:-size] * power + out[size:], power * power, 2 * size
            if bit == "1":
                out, power, size = out[:-1] * _P + words[size:], power * _P, size + 1
    return mix64(out + np.uint64(k))


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label every node of edges (a long, b long; a != b) with the smallest node it is connected to.

    Large-star and small-star rounds in turn: each node's edges are rewritten to point at the
    smallest neighbour, so that a component of n nodes becomes a star in O(log n) rounds while the
    number of edges never grows. Both inputs of each join are written tables, so that the edges of a
    hub can be split over tasks. Only counters reach the driver. Returns node long, root long.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        large = e.select(F.col("b").alias("c"), F.col("a").alias("n")).join(low.withColumnRenamed("a", "c"), "c").select(F.col("n").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "large")
        # small star: of a node's smaller neighbours, the smallest takes the node and the others
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialise(small.where("a <> b").distinct(), "edges")
        state = [F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1_000_003))), F.lit(0))]
        done = tuple(new.agg(*state).first()) == tuple(e.agg(*state).first())
        discard(e, low, large, least)
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


# ---------------------------------------------------------------- SQL for DuckDB


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, which DuckDB has no function for: a bit at a time, in the reflected form."""
    bit = "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda s, ch: list_reduce([CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], {bit}, xor(s, ch)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
