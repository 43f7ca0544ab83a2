"""Removal of repeated byte strings by sorting suffixes, deep-shallow.

A string of LENGTH bytes is removed wherever it also starts earlier. Sorting the suffix of every byte of a corpus would move a hundred
times its size, so suffixes are sorted only where a repetition is possible: of each window of LENGTH bytes the seed (SEED bytes) with the least
hash is its anchor, which depends on the window's bytes alone, so that equal windows have equal seeds at equal offsets. Anchors
whose seed occurs at one place only rule their windows out. The others send their windows (runs of neighbours, as one
context) to the seed's bucket, equal contexts once. A bucket's suffixes, one for each window, are sorted within LENGTH bytes: a
multikey quicksort whose letters are eight bytes goes down to SHALLOW bytes, then blind tries order what still agrees: a group's
members branch off its first one at their first mismatch, and each branch is a group again until its members are equal.
Of equal suffixes the earliest keeps its bytes.

A seed with more than CROWD contexts is divided by the offset of its anchor in the window: halves of the range of offsets share
longer cores, and are told apart by them, down to one offset, where the core is the window itself. No bucket above CROWD contexts is
sorted in one task, nothing is left out, and nothing is broadcast. Texts move twice, to be cut and to be hashed, and only those that hold repetitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import mix64, python_batches, table
from lodestone.sources.shared import discard, materialise

#: Bytes of a string, of a seed, and of the shallow part of the sort.
LENGTH, SEED, SHALLOW = 100, 32, 24
_WINDOW = LENGTH - SEED + 1
#: Contexts of a bucket above which it is divided; windows sorted at a time; window starts of a text looked at in one piece.
CROWD, SORTED, PIECE = 2048, 1 << 17, 1 << 18
_NO_ID = -(2**63)

# ---------------------------------------------------------------- anchors


def _seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED (a power of two) bytes from each place on."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    factor = 0x9E3779B97F4A7C15
    while width < SEED:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, 2 * width
    return mix64(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of neighbouring windows with one anchor: piece, first window, further windows, the anchor's distance from the first, seed hash."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    if not len(data) or max(len(p) for p in pieces) < LENGTH:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    h = _seed_hashes(data)
    # hash above, place below: the least of a window is its anchor, the leftmost of equal hashes
    least = _sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), _WINDOW)
    edge = np.zeros(len(data) + 1, np.int64)
    long = ends - starts >= LENGTH
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    x = np.flatnonzero(np.cumsum(edge)[: len(least)])
    at = (least[x] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((np.diff(x, prepend=-9) > 1) | (np.diff(at, prepend=-9) != 0))
    last = np.append(new[1:], len(x)) - 1
    first, at = x[new], at[new]
    piece = np.searchsorted(ends, first, side="right")
    return piece, first - starts[piece], x[last] - first, at - first, h[at]


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Overlapping pieces of a text that hold each of its windows once."""
    for i in range(0, max(0, len(text) - LENGTH) + 1, PIECE):
        yield i, text[i : i + PIECE + LENGTH - 1]


def _find_anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        piece, first, span, left, h = anchors([p for _, _, _, p in held])
        ids, ties, bases = (np.array([p[i] for p in held], np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(ids[piece]), pa.array(ties[piece]), pa.array(bases[piece] + first << 16 | span << 8 | left), pa.array(h.view(np.int64))], ["k", "tie", "at", "h"])

    held, size = [], 0
    for part in parts:
        for k, tie, text in zip(*(part.column(i) for i in range(3)), strict=True):
            for base, piece in _pieces(text.as_py().encode("utf-8", "surrogatepass")):
                held.append((k.as_py(), tie.as_py(), base, piece))
                size += len(piece)
                if size >= PIECE:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def _cut_contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for k, tie, text, ats in zip(*(part.column(i) for i in range(4)), strict=True):
            data, at = text.as_py().encode("utf-8", "surrogatepass"), ats.values.to_numpy(zero_copy_only=False)
            for i in range(0, len(at), 20_000):
                some = at[i : i + 20_000]
                contexts = [data[x : x + n + LENGTH] for x, n in zip((some >> 16).tolist(), (some >> 8 & 255).tolist(), strict=True)]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k.as_py())), pa.array(np.full(n, tie.as_py())), pa.array(some), pa.array(contexts, pa.binary())], ["k", "tie", "at", "ctx"])


# ---------------------------------------------------------------- deep-shallow sorting


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by keys (the first one counts most), and numbers of groups of equal keys in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return order, np.cumsum(new)


def _several(group: np.ndarray) -> np.ndarray:
    """Which rows are in a group of several; groups are sorted."""
    if not len(group):
        return np.zeros(0, bool)
    same = group[1:] == group[:-1]
    return np.append(same, False) | np.append(False, same)


def equal_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes that agree in LENGTH bytes with others of their group: (places in `at`, numbers of classes), class after class.

    data is followed by eight more bytes at least. Groups may be numbered in any way.
    """
    words = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | data[i : len(data) - 7 + i]
    who = np.arange(len(at))
    order, group = _groups(group)
    who, many = who[order], _several(group)
    who, group = who[many], group[many]
    for depth in range(0, SHALLOW, 8):
        order, group = _groups(group, words[at[who] + depth])
        who, many = who[order], _several(group)
        who, group = who[many], group[many]
    while len(who):
        rows = data[at[who][:, None] + np.arange(SHALLOW, LENGTH)]
        leader = np.searchsorted(group, group)  # groups are sorted: the first member of each
        differs = rows != rows[leader]
        place = np.where(differs.any(1), differs.argmax(1), LENGTH)
        row, column = np.arange(len(who)), np.minimum(place, LENGTH - SHALLOW - 1)
        mine, led = rows[row, column].astype(np.int64), rows[leader, column]
        # branches below the leader's string leave it the earlier the smaller they are, those above the other way round
        branch = np.where(place == LENGTH, LENGTH * 256, np.where(mine < led, place, 2 * LENGTH - place) * 256 + mine)
        order, fresh = _groups(group, branch)
        who, place, many = who[order], place[order], _several(fresh)
        same = many & (place == LENGTH)
        if same.any():
            yield who[same], fresh[same]
        rest = many & (place < LENGTH)
        who, group = who[rest], fresh[rest]


def first_windows(part: pd.DataFrame) -> pd.DataFrame:
    """Runs of windows (k, tie, from first to last) of contexts that don't start earlier in the same bucket.

    part: b (bucket, whole ones), k, tie, at, ctx. Contexts of one (k, tie, place) don't repeat.
    """
    at, k, tie = (part[c].to_numpy(np.int64) for c in ("at", "k", "tie"))
    first, span, left = at >> 16, at >> 8 & 255, at & 255
    data = np.frombuffer(b"".join(part["ctx"]) + bytes(8), np.uint8)
    begin = np.cumsum(span + LENGTH) - span - LENGTH
    row = np.repeat(np.arange(len(part)), span + 1)
    step = np.arange(len(row)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
    keep = np.ones(len(row), bool)
    bucket = np.cumsum(np.diff(part["b"].to_numpy(np.int64), prepend=part["b"].iloc[0]) != 0)
    for who, group in equal_suffixes(data, begin[row] + step, bucket[row] * 256 + left[row] - step):
        order = np.lexsort((first[row[who]] + step[who], tie[row[who]], k[row[who]], group))
        later = np.append(False, np.diff(group[order]) == 0)
        keep[who[order[later]]] = False
    run = np.flatnonzero(keep & (np.append(True, ~keep[:-1]) | (step == 0)))
    end = np.flatnonzero(keep & (np.append(~keep[1:], True) | (step == span[row])))
    return pd.DataFrame({"k": k[row[run]], "tie": tie[row[run]], "first": first[row[run]] + step[run], "last": first[row[end]] + step[end]})


def _sort_buckets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets come one after the other; as many whole ones as hold SORTED windows are sorted together."""
    held = None
    for part in parts:
        held = part if held is None else pd.concat((held, part), ignore_index=True)
        while len(held) * 40 > SORTED:
            b = held["b"].to_numpy()
            new = np.flatnonzero(b[1:] != b[:-1]) + 1
            fits = new[new * 40 <= SORTED]
            if not len(new):
                break
            cut = int(fits[-1] if len(fits) else new[0])
            yield first_windows(held.iloc[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield first_windows(held)


# ---------------------------------------------------------------- buckets


def _bucketed(contexts: DataFrame) -> DataFrame:
    """Contexts of anchors at offsets from low to high - 1, with their bucket b: that of the bytes that all such windows hold. Equal contexts once."""
    left = F.col("at").bitwiseAND(F.lit(255))
    once = contexts.groupBy("ctx", left.alias("left"), "low", "high").agg(F.min(F.struct("k", "tie", "at")).alias("f"))
    core = F.expr(f"substring(ctx, CAST(left - low + 1 AS INT), CAST({LENGTH + 1} + low - high AS INT))")
    return once.select(F.xxhash64("low", "high", core).alias("b"), "f.k", "f.tie", "f.at", "ctx", "low", "high")


def _halved(contexts: DataFrame) -> DataFrame:
    """The contexts' windows apart: those with their anchor in the lower and in the upper half of the offsets."""
    middle = "(low + high) DIV 2"
    halves = contexts.selectExpr("k", "tie", "ctx", "shiftright(at, 16) AS x", "shiftright(at, 8) & 255 AS span", "at & 255 AS left", f"inline(array(struct(low AS low, {middle} AS high), struct({middle} AS low, high AS high)))")
    # a window's offset falls by one from left to left - span
    some = halves.selectExpr("*", "greatest(0, left - (high - 1)) AS skip", "least(span, left - low) AS upto").where("skip <= upto")
    return some.selectExpr("k", "tie", "shiftleft(x + skip, 16) | shiftleft(upto - skip, 8) | (left - skip) AS at", f"substring(ctx, CAST(skip + 1 AS INT), CAST(upto - skip + {LENGTH} AS INT)) AS ctx", "low", "high")


def _kept_windows(contexts: DataFrame) -> DataFrame:
    """Runs of windows that start nowhere earlier: k, tie, first, last."""
    done, some = [], contexts.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(_WINDOW).cast("long"))
    while True:  # halving ends at one offset, where equal cores are equal contexts
        held = materialise(_bucketed(some), "contexts")
        crowds = materialise(held.where("high - low > 1").groupBy("b").count().where(F.col("count") > CROWD).select("b"), "crowds")
        if not crowds.take(1):
            done.append(held)
            break
        done.append(held.join(crowds, "b", "left_anti"))
        some = _halved(held.join(crowds, "b", "left_semi"))
    fit = reduce(DataFrame.unionByName, [f.select("b", "k", "tie", "at", "ctx") for f in done])
    return fit.repartition("b").sortWithinPartitions("b").mapInPandas(_sort_buckets, "k long, tie long, first long, last long")


def _removals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Byte ranges that windows cover which are in question and not kept."""
    for part in parts:
        out = []
        for k, tie, ats, kept in zip(part["k"], part["tie"], part["ats"], part["kept"], strict=True):
            at = np.sort(np.asarray(ats, np.int64))
            first = at >> 16
            last = first + (at >> 8 & 255)
            edge, sign = np.concatenate((first, last + 1)), np.repeat([1, -1], len(at))
            if kept is not None:
                a, b = (np.fromiter((w[n] for w in kept), np.int64, len(kept)) for n in ("first", "last"))
                edge, sign = np.concatenate((edge, a, b + 1)), np.concatenate((sign, np.repeat([-1, 1], len(kept))))
            order = np.argsort(edge, kind="stable")
            edge, level = edge[order], np.cumsum(sign[order])
            on = np.flatnonzero((level[:-1] > 0) & (edge[1:] > edge[:-1])) if len(edge) else []
            start, end = edge[on], edge[np.add(on, 1)] - 1 + LENGTH  # the last window's last byte, past the end
            if len(start):
                reach = np.maximum.accumulate(end)
                new = np.append(True, start[1:] > reach[:-1])
                start, end = start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                out.append((k, tie, int((end - start).sum()), len(start), start, end))
        yield pd.DataFrame(out, columns=["k", "tie", "n_removed", "n_spans", "starts", "ends"])


def _kept_digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        out = []
        for text, starts, ends in zip(*(part.column(i) for i in range(2, 5)), strict=True):
            data, h, at = memoryview(text.as_py().encode("utf-8", "surrogatepass")), hashlib.sha256(), 0
            for a, b in zip(starts.as_py(), ends.as_py(), strict=True):
                h.update(data[at:a])
                at = b
            h.update(data[at:])
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["k", "tie", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of every text what is left without the strings of LENGTH bytes that start earlier too.

    Texts are UTF-8 bytes (null: empty). Earlier is a smaller id (null first), in one document an earlier start; of texts with one id that with the
    smaller hash; of repeated rows all but one are later. An equal text of LENGTH bytes or more goes wholly, and is looked at only once.
    Texts shorter than LENGTH stay. An empty table gives no rows. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256.
    """
    spark = docs.sparkSession
    python_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(body).alias("tie"), body.alias("text"))
    known = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("tie"), F.sha2(body, 256).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes"))
    known = materialise(known.groupBy("doc_id", "tie", "sha", "n_bytes").agg(F.count("*").alias("copies")), "texts")
    origin = known.groupBy("sha").agg(F.min(F.struct("doc_id")).alias("of"))
    known = materialise(known.join(origin, "sha").select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"), "tie", "sha", "n_bytes", "copies", F.col("of.doc_id").eqNullSafe(F.col("doc_id")).alias("original")), "texts")
    long = rows.where(F.octet_length("text") >= LENGTH)

    found = materialise(long.mapInArrow(_find_anchors, "k long, tie long, at long, h long"), "anchors")
    # a seed at several places; a place in equal texts is one
    place = F.xxhash64("tie", "at")
    seeds = materialise(found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h"), "seeds")
    repeated = found.join(seeds, "h").groupBy("k", "tie").agg(F.collect_set("at").alias("ats"))
    repeated = materialise(repeated.join(known.where("original").select("k", "tie"), ["k", "tie"], "left_semi"), "repeated")
    discard(found, seeds)

    contexts = long.join(repeated, ["k", "tie"]).select("k", "tie", "text", "ats").mapInArrow(_cut_contexts, "k long, tie long, at long, ctx binary")
    kept = materialise(_kept_windows(contexts), "kept")
    spared = kept.groupBy("k", "tie").agg(F.collect_list(F.struct("first", "last")).alias("kept"))
    gone = repeated.join(spared, ["k", "tie"], "left").mapInPandas(_removals, "k long, tie long, n_removed long, n_spans long, starts array<long>, ends array<long>")
    gone = materialise(gone, "removed")
    discard(repeated, kept)
    left = long.join(gone, ["k", "tie"]).select("k", "tie", "text", "starts", "ends").mapInArrow(_kept_digests, "k long, tie long, kept string").groupBy("k", "tie").agg(F.first("kept").alias("kept"))
    changed = materialise(gone.select("k", "tie", "n_removed", "n_spans").join(left, ["k", "tie"]), "changed")

    zero = F.lit(0).cast("long")
    first = known.where("original").join(changed, ["k", "tie"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
    more = known.withColumn("copies", F.col("copies") - F.col("original").cast("long")).where("copies > 0")
    more = more.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    all_gone = F.col("n_bytes") >= LENGTH
    again = more.select("doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(zero).alias("n_removed"), all_gone.cast("long").alias("n_spans"), F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"))
    return first.unionByName(again)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


#: Every string of every text is a row here.
SQL = f"""
WITH b AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents
), w AS (SELECT r, unnest(range(octet_length(t) - {LENGTH - 1})) AS x, unnest(list_transform(range(octet_length(t) - {LENGTH - 1}), lambda x: md5_number(array_slice(t, x + 1, x + {LENGTH})))) AS m FROM b WHERE octet_length(t) >= {LENGTH}
), d AS (SELECT r, x, row_number() OVER (PARTITION BY m ORDER BY r, x) > 1 AS later FROM w
), g AS (SELECT r, x, CASE WHEN x > lag(x) OVER o + {LENGTH} THEN 1 ELSE 0 END AS fresh FROM d WHERE later WINDOW o AS (PARTITION BY r ORDER BY x)
), s AS (SELECT r, x, sum(fresh) OVER (PARTITION BY r ORDER BY x) AS span FROM g
), i AS (SELECT r, span, min(x) AS a, max(x) + {LENGTH} AS e FROM s GROUP BY r, span
), k AS (SELECT r, count(*) AS n_spans, CAST(sum(e - a) AS BIGINT) AS n_removed, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e FROM i GROUP BY r
), p AS (SELECT r, unnest(range(len(a) + 1)) AS j, a, e FROM k
), f AS (SELECT r, string_agg(hex(array_slice(t, coalesce(e[j], 0) + 1, coalesce(a[j + 1], octet_length(t)))), '' ORDER BY j) AS kept FROM p JOIN b USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha256(unhex(kept)), sha256(t)) AS kept_sha256
FROM b LEFT JOIN k USING (r) LEFT JOIN f USING (r)
"""
