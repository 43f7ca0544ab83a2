"""Pairs of overlapping intervals by plane sweeps within cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import materialise

#: Cells of a level are this many times wider than those of the level below; intervals above the last level share one cell.
FACTOR, LEVELS = 8, 20
#: Intervals of either side of a block; pairs, and ids of pairs, that a sweep makes at a time.
SWEEP, PAIRS, IDS = 32768, 1 << 18, 1 << 20
#: Equal intervals of a side that stay in one block; of more, each so many have a block of their own choice.
EQUAL = 1024
#: Possible pairs from which on sweeps are dealt out by their number, as their few bytes say nothing of their work.
MANY = 1 << 26


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices i, j for all j from first[i] to last[i] - 1."""
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]


def _starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in these columns (no nulls; NaN equals NaN)."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in columns:
        x = rows.column(c).combine_chunks()
        differs = pc.not_equal(x[1:], x[:-1])
        if pa.types.is_floating(x.type):
            differs = pc.and_(differs, pc.invert(pc.and_(pc.is_nan(x[1:]), pc.is_nan(x[:-1]))))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return new


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of the sorted rows: many small ones together, or one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and not _starts(pa.Table.from_batches([held[0].slice(0, 1), batch.slice(batch.num_rows - 1)]), keys)[1]:
            continue  # one group goes on
        rows = pa.Table.from_batches(held)
        last = int(np.flatnonzero(_starts(rows, keys))[-1])
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _places(group: np.ndarray, value: np.ndarray, of_group: np.ndarray, of_value: np.ndarray, equal: bool) -> np.ndarray:
    """For each (of_group, of_value) how many of the sorted (group, value) are below it, or equal if so asked."""
    n = len(group)
    kind = np.concatenate((np.full(n, not equal), np.full(len(of_group), equal)))
    order = np.lexsort((kind, np.concatenate((value, of_value)), np.concatenate((group, of_group))))
    seen = np.cumsum(order < n)
    out = np.empty(len(of_group), np.int64)
    mine = order >= n
    out[order[mine] - n] = seen[mine]
    return out


def _sweep(keys: list[str]):
    """Rows (keys, side, id, lo, hi, first, cell, home), sorted by keys -> pairs of intervals, each with the lists of ids that have it.

    Starts are sorted in each group, and each interval meets the other side's that start while it lasts. A pair is found once, where the later of
    the two starts (equal ones: the right side's); it counts in the first cell that both touch, and at the level of the wider one only.
    Equal intervals of a group and side are swept as one. All groups of a batch are swept together.
    """
    schema = pa.schema([("left_ids", pa.list_(pa.int64())), ("right_ids", pa.list_(pa.int64())), ("start", pa.float64()), ("end", pa.float64())])

    def distinct(group: np.ndarray, cols: dict[str, np.ndarray]) -> dict:
        order = np.lexsort((cols["hi"], cols["lo"], group))
        group, c = group[order], {k: v[order] for k, v in cols.items()}
        new = np.ones(len(group), bool)
        new[1:] = (np.diff(group) != 0) | (c["lo"][1:] != c["lo"][:-1]) | (c["hi"][1:] != c["hi"][:-1])
        at = np.flatnonzero(new)
        ends = np.append(at, len(group))
        out = {k: c[k][at] for k in ("lo", "hi", "first", "cell", "home")}
        return out | {"group": group[at], "size": np.diff(ends), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c["id"]))}

    def swept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group, side = np.cumsum(_starts(rows, keys)), rows.column("side").to_numpy()
        cols = {c: rows.column(c).to_numpy() for c in ("id", "lo", "hi", "first", "cell", "home")}
        a, b = (distinct(group[side == n], {k: v[side == n] for k, v in cols.items()}) for n in (0, 1))
        for x, y, left in ((a, b, True), (b, a, False)):
            lo, hi = _places(y["group"], y["lo"], x["group"], x["lo"], not left), _places(y["group"], y["lo"], x["group"], x["hi"], False)
            made = np.cumsum(np.maximum(hi - lo, 0))
            at = 0
            while at < len(made):
                to = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + PAIRS, side="right")))
                i, j = _ranges(lo[at:to], hi[at:to])
                i += at
                good = (x["home"][i] | y["home"][j]) & (np.maximum(x["first"][i], y["first"][j]) == x["cell"][i])
                i, j = i[good], j[good]
                at = to
                one, two, m, n = (x, y, i, j) if left else (y, x, j, i)
                ids = np.cumsum(one["size"][m] + two["size"][n])
                start, end = np.maximum(one["lo"][m], two["lo"][n]), np.minimum(one["hi"][m], two["hi"][n])
                p = 0
                while p < len(m):
                    q = max(p + 1, int(np.searchsorted(ids, (ids[p - 1] if p else 0) + IDS, side="right")))
                    yield pa.RecordBatch.from_arrays([one["ids"].take(pa.array(m[p:q])), two["ids"].take(pa.array(n[p:q])), pa.array(start[p:q]), pa.array(end[p:q])], schema=schema)
                    p = q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, keys):
            yield from swept(rows)

    return run


def _unfolded(pairs: DataFrame, values: dict[str, str]) -> DataFrame:
    """A row for each two ids; values are computed once for all ids of a pair of intervals."""
    rows = pairs.select("left_ids", "right_ids", *[F.expr(v).alias(name) for name, v in values.items()])
    return rows.withColumn("left_id", F.explode("left_ids")).withColumn("right_id", F.explode("right_ids")).select("left_id", "right_id", *values)


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, low: str, high: str, width: float, by: list[str] | None = None, sweep: int = SWEEP, values: dict[str, str] | None = None) -> DataFrame:
    """Pairs of ids (longs) whose intervals [low, high) overlap and whose `by` columns are equal, with the overlap's start and end (doubles), or what `values` (SQL by name) makes of these.

    An interval lives on the level of cells that fits its length, where it touches two at most, and visits the wider levels that
    others live on, where it touches two as well; a pair meets at the wider one's level. A cell's sides are cut into blocks of about `sweep` intervals
    by their counts, and each pair of blocks is one sweep: where a cell is crowded on both sides, so is the result. Equal intervals go to one block, as far as EQUAL allows, so that they are swept as one. Rows are copied only for
    further blocks, and a sweep hands on pairs of lists of ids, which Spark unfolds in place: nothing that grows with the pairs is shuffled or written. width: about
    that of the shortest intervals. A `by` key with `sweep` intervals a side at most is one sweep by itself, without levels, cells or copies. Nulls, empty and turned intervals and null keys match nothing; repeated ids make pairs each.
    """
    by = by or []
    values = values or {"start": "start", "end": "`end`"}

    def cell(c: str) -> Column:
        return F.when(F.col("level") < LEVELS, F.floor(F.col(c) / (width * F.pow(F.lit(float(FACTOR)), F.col("level"))))).otherwise(F.lit(0)).cast("long")

    def side(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(by)]).dropna().where("lo < hi AND id IS NOT NULL")
        fits = F.greatest(F.lit(0.0), F.ceil(F.log(float(FACTOR), (F.col("hi") - F.col("lo")) / width)))
        huge = (F.greatest(F.abs("lo"), F.abs("hi")) / width > 1e15) | (F.col("hi") - F.col("lo") >= width * float(FACTOR) ** (LEVELS - 1))
        return rows.withColumn("own", F.when(huge, LEVELS).otherwise(fits).cast("int"))

    def parted(rows: DataFrame) -> DataFrame:
        """With part, which equal intervals share: 0 where they are few."""
        same = [*[f"by{i}" for i in range(len(by))], "lo", "hi"]
        common = materialise(rows.groupBy(*same).agg(F.count("*").alias("n")).where(F.col("n") > EQUAL), "common")
        if common.isEmpty():
            return rows.withColumn("part", F.lit(0))
        return rows.join(common, same, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / EQUAL)), F.lit(0)).cast("int")).drop("n")

    a, b = materialise(side(left, left_id), "intervals"), materialise(side(right, right_id), "intervals")
    swept = "left_ids array<long>, right_ids array<long>, start double, end double"
    few = None
    if by:
        names = [f"by{i}" for i in range(len(by))]
        both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
        crowded = materialise(both.groupBy(*names).agg(F.sum("side").alias("nb"), F.sum(1 - F.col("side")).alias("na")).where((F.greatest("na", "nb") > sweep) & (F.least("na", "nb") > 0)).select(*names), "crowded")
        some = not crowded.isEmpty()
        rows = (both.join(crowded, names, "left_anti") if some else both).drop("own").repartition(*names).sortWithinPartitions(*names)
        few = rows.withColumns({"first": F.lit(0), "cell": F.lit(0), "home": F.lit(True)}).mapInArrow(_sweep(names), swept)
        if not some:
            return _unfolded(few, values)
        a, b = (materialise(x.join(crowded, names, "left_semi"), "intervals") for x in (a, b))
    a, b = (parted(x) for x in (a, b))
    levels = sorted(r[0] for r in a.select("own").unionAll(b.select("own")).distinct().collect())  # LEVELS + 1 at most
    keys = [*[f"by{i}" for i in range(len(by))], "level", "cell"]

    def placed(rows: DataFrame) -> DataFrame:
        seen = rows.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).where("level >= own")
        touched = F.sequence(cell("lo"), cell("hi"))
        return seen.withColumn("first", cell("lo")).withColumn("cell", F.explode(touched)).select(*keys, "id", "lo", "hi", "part", "first", (F.col("level") == F.col("own")).alias("home"))

    pa_, pb_ = placed(a), placed(b)
    counts = lambda p, n: p.groupBy(*keys).agg(F.count("*").alias(n))
    blocks = materialise(counts(pa_, "na").join(counts(pb_, "nb"), keys).select(*keys, F.ceil(F.col("na") / sweep).cast("int").alias("ca"), F.ceil(F.col("nb") / sweep).cast("int").alias("cb"), (F.col("na").cast("double") * F.col("nb")).alias("most")), "cells")
    many = (blocks.agg(F.sum("most")).first()[0] or 0) >= MANY

    def dealt(p: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64("lo", "hi", "part"), F.col(own)).cast("int")
        return p.join(blocks, keys).withColumn(mine, block).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("ca", "cb", "most", "part")

    groups = [*keys, "i", "j"]
    sides = (dealt(p, *names).withColumn("side", F.lit(n)) for n, (p, names) in enumerate(((pa_, ("ca", "cb", "i", "j")), (pb_, ("cb", "ca", "j", "i")))))
    spark = left.sparkSession
    number = [max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)] if many else []
    both = next(sides).unionByName(next(sides)).repartition(*number, *groups).sortWithinPartitions(*groups)
    pairs = both.mapInArrow(_sweep(groups), swept)
    return _unfolded(pairs.unionAll(few) if few else pairs, values)
