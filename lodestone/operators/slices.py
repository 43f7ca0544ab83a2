"""Ordered operators that don't give a key to one task: sorted slices, and what one slice hands to the next.

sliced() range-partitions rows by (key, order), so that a key with many rows lies in many slices, one after the
other. Every operator here works inside the slices with ordinary windows and adds what the other slices hold of
the same key. Only a slice's first and last key can lie in other slices as well, so what is handed over has two rows
a slice at most, and that is all that is broadcast.

Null keys form a key of their own and null orders come first, as in Spark's windows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import materialise

SLICE = "_slice"


def sliced(df: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """Add _slice: slices hold consecutive ranges of the sorted columns and are numbered in that order.

    Equal rows lie in one slice; give a column that tells them apart where a third of all rows may be equal.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *columns).withColumn(SLICE, F.spark_partition_id())


def _over(by: list[str]) -> Window:
    return Window.partitionBy(SLICE, *by)


class Scan(NamedTuple):
    """An associative aggregate that ignores nulls, and how an earlier slice's result joins a later one's."""

    aggregate: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]


def _with_null(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b))


SUM = Scan(F.sum, _with_null(lambda a, b: a + b))
LEAST = Scan(F.min, F.least)
GREATEST = Scan(F.max, F.greatest)
XOR = Scan(F.bit_xor, _with_null(lambda a, b: a.bitwiseXOR(b)))
LAST = Scan(lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a))


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Scan]], parts: int | None = None) -> DataFrame:
    """Add running aggregates over each key's rows up to the present one, without a task per key.

    values: new column -> (column, scan). Rows are in ascending order; rows that agree in (by, order) come in any
    order, as in a window over rows. One range shuffle, one shuffle by slice and a table that is written; a broadcast
    of a row a slice. An empty table gives an empty table. The columns _slice, _n, _head and _own_* and _pre_* are taken.
    """
    w = _over(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = {name: f"_own_{name}" for name in values}
    local = sliced(df, [*by, *order], parts)
    local = local.select("*", F.count(F.lit(1)).over(w).alias("_n"), *[scan.aggregate(F.col(c)).over(w).alias(own[name]) for name, (c, scan) in values.items()])
    rows = materialise(local, "running")
    # of the slice's last key the last row, which has all that the slice holds of it
    ends = rows.groupBy(SLICE).agg(F.min(F.struct(*by)).alias("first"), F.max(F.struct(*by, "_n")).alias("end"), F.max_by(F.struct(*by, *own.values()), F.struct(*by, "_n")).alias("last"))
    probes = ends.select(SLICE, F.lit(0).alias("_kind"), *[F.col(f"first.{c}").alias(c) for c in by])
    tails = ends.select(SLICE, F.lit(1).alias("_kind"), "last.*")
    before = Window.partitionBy(*by).orderBy(SLICE, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carry = probes.unionByName(tails, allowMissingColumns=True).select(SLICE, "_kind", *by, *[scan.aggregate(F.col(own[n])).over(before).alias(f"_pre_{n}") for n, (_, scan) in values.items()]).where("_kind = 0")
    return _with_carry(rows, carry.drop("_kind"), by).select(*df.columns, *[scan.combine(F.col(f"_pre_{n}"), F.col(own[n])).alias(n) for n, (_, scan) in values.items()])


def _with_carry(rows: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of carry, of which there are two rows a slice at most."""
    keys = [SLICE, *by]
    c = carry.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], *[k for k in carry.columns if k not in keys])
    match = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)))
    return rows.join(F.broadcast(c), match, "left").drop(*[f"_c{i}" for i in range(len(keys))])


def ranks(df: DataFrame, by: list[str], order: list[str], parts: int | None = None, tie: str | None = None) -> DataFrame:
    """Add row_number, rank, dense_rank, cume_dist, percent_rank (of each key, by ascending order) and n_rows of the key.

    tie: a column that orders rows of one (by, order), for row_number; rows that agree in it as well are numbered in
    any order. Peers may lie in several slices: a slice's first and last peers are counted in the others.
    The columns _slice, _n, _lo, _hi, _d, _k* and _g* are taken.
    """
    last = [tie] if tie else []
    w = _over(by)
    peers = w.orderBy(*order)
    local = sliced(df, [*by, *order, *last], parts)
    local = local.select(
        "*", F.row_number().over(w.orderBy(*order, *last)).cast("long").alias("_n"), (F.rank().over(peers) - 1).cast("long").alias("_lo"),
        F.count(F.lit(1)).over(peers.rangeBetween(Window.unboundedPreceding, 0)).alias("_hi"), F.dense_rank().over(peers).cast("long").alias("_d"),
        F.count(F.lit(1)).over(w).alias("_k_rows"), F.min(F.struct(*order)).over(w).alias("_k_first"), F.max(F.struct(*order)).over(w).alias("_k_last"),
    )
    local = local.withColumn("_k_groups", F.max("_d").over(w)).withColumn("_g_rows", F.col("_hi") - F.col("_lo"))
    rows = materialise(local, "ranks")
    keys = rows.groupBy(SLICE).agg(*[f(F.struct(*by, "_k_rows", "_k_groups", "_k_first", "_k_last")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))])
    keys = keys.select(SLICE, F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select(SLICE, "e.*")
    along = Window.partitionBy(*by).orderBy(SLICE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    # groups of peers that go on from the key's slice before are one group, not two
    keys = keys.withColumn("_more", F.coalesce((F.lag("_k_last").over(along) == F.col("_k_first")).cast("long"), F.lit(0)))
    keys = keys.select(
        SLICE, *by, F.sum("_k_rows").over(earlier).alias("_k_before"), F.sum("_k_rows").over(Window.partitionBy(*by)).alias("_k_all"),
        (F.coalesce(F.sum(F.col("_k_groups") - F.col("_more")).over(earlier), F.lit(0)) - F.col("_more")).alias("_k_dense"),
    )
    groups = rows.groupBy(SLICE).agg(*[f(F.struct(*by, F.struct(*order).alias("_g_of"), "_g_rows")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))])
    groups = groups.select(SLICE, F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select(SLICE, "e.*")
    through = Window.partitionBy(*by, "_g_of").orderBy(SLICE)
    groups = groups.select(SLICE, *by, "_g_of", F.sum("_g_rows").over(through.rowsBetween(Window.unboundedPreceding, -1)).alias("_g_before"), F.sum("_g_rows").over(through.rowsBetween(1, Window.unboundedFollowing)).alias("_g_after"))
    found = _with_carry(_with_carry(rows, keys, by).withColumn("_g_of", F.struct(*order)), groups, [*by, "_g_of"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n, before = F.coalesce("_k_all", "_k_rows"), zero("_k_before")
    lower, upto = before + F.col("_lo") - zero("_g_before"), before + F.col("_hi") + zero("_g_after")
    return found.select(
        *df.columns, (before + F.col("_n")).alias("row_number"), (lower + 1).alias("rank"), (F.col("_d") + zero("_k_dense")).alias("dense_rank"),
        (upto / n).alias("cume_dist"), F.when(n > 1, lower / (n - 1)).otherwise(F.lit(0.0)).alias("percent_rank"), n.alias("n_rows"),
    )


def ntile(row_number: Column, n_rows: Column, buckets: int) -> Column:
    """The bucket of a row among its key's: the first n_rows % buckets buckets have a row more."""
    small = F.floor(n_rows / buckets).cast("long")
    more = n_rows % buckets
    wide = more * (small + 1)
    return F.when(row_number <= wide, F.ceil(row_number / (small + 1))).otherwise(more + F.ceil(F.try_divide(row_number - wide, small))).cast("long")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "row_number", parts: int | None = None) -> DataFrame:
    """Add the row's number among its key's rows, from 1; rows that agree in (by, order) are numbered in any order."""
    one = "_one"
    return running(df.withColumn(one, F.lit(1).cast("long")), by, order, {name: (one, SUM)}, parts).drop(one)


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: dict[str, str], parts: int | None = None) -> DataFrame:
    """Each row of left with the latest row of right for the same `by` that isn't later, however many rows a key has.

    The semantics of joins.asof_join: of right rows at one time the one with the largest values counts, a left row sees
    a right row of its own time, a null key or time matches nothing. A key's times are cut into slices, and the last
    right row of each slice is handed on to the next by a prefix scan.
    """
    kept = left.columns
    held = F.struct(F.col(right_time).alias("_time"), *[F.col(c).alias(n) for c, n in values.items()])
    known = reduce(and_, (F.col(c).isNotNull() for c in by))
    a = left.select("*", F.col(left_time).alias("_at"), F.lit(1).alias("_side"))
    b = right.where(F.col(right_time).isNotNull() & known).select(*by, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), held.alias("_held"))
    both = a.unionByName(b, allowMissingColumns=True)
    found = running(both, by, ["_at", "_side", "_held"], {"_found": ("_held", LAST)}, parts).where("_side = 1")
    known &= F.col(left_time).isNotNull()
    return found.select(*kept, *[F.when(known, F.col(f"_found.{n}")).alias(n) for n in values.values()])


def row_frames(df: DataFrame, by: list[str], order: list[str], before: int, after: int, columns: dict[str, Callable[[Window], Column]], block: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """Add window functions that look at most `before` rows back and `after` rows on within a key, in many tasks a key.

    columns: name -> function of the key's ordered window to a column, e.g. lambda w: F.max("v").over(w.rowsBetween(-3, 0)).
    A prefix scan numbers a key's rows; `block` consecutive ones make a block, which also gets the rows at its two
    borders that its frames reach (a halo, from as many blocks as it spans), computes, and drops these. order must leave
    no ties; frames are cut at a key's ends as in an ordinary window. The columns _place, _block and _home are taken.
    """
    rows = numbered(df, by, order, "_place", parts).withColumn("_home", F.floor((F.col("_place") - 1) / block))
    first, last = F.greatest(F.lit(0), F.floor((F.col("_place") - 1 - after) / block)), F.floor((F.col("_place") - 1 + before) / block)
    w = Window.partitionBy(*by, "_block").orderBy("_place")
    found = rows.withColumn("_block", F.explode(F.sequence(first, last))).select("*", *[f(w).alias(n) for n, f in columns.items()])
    return found.where("_block = _home").select(*df.columns, *columns)


def range_sums(df: DataFrame, by: list[str], at: str, before: object, after: object, key: str, columns: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Sums over the rows of a key whose `at` lies from at - before to at + after (both included), however many they are.

    columns: name -> long expression of a row (null counts as 0; F.lit(1) counts rows). A frame's sum is the difference
    of two prefix sums: every row sends a probe to each end of its frame, a prefix scan sums up to the probes, and
    the two meet again by `key`, which must be unique. Rows whose `at` is null have each other as their frame, as in Spark.
    No frame's rows are gathered, so that work doesn't depend on the frame's width. The columns _at, _kind, _row, _v*, _s* are taken.
    """
    value = {n: f"_v{i}" for i, n in enumerate(columns)}
    rows = df.select("*", F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(True).alias("_row"), *[F.coalesce(c, F.lit(0)).cast("long").alias(value[n]) for n, c in columns.items()])
    probe = lambda x, kind: df.select(key, *by, x.cast(df.schema[at].dataType).alias("_at"), F.lit(kind).alias("_kind"))
    both = rows.unionByName(probe(F.col(at) - before, 0), allowMissingColumns=True).unionByName(probe(F.col(at) + after, 2), allowMissingColumns=True)
    found = running(both, by, ["_at", "_kind"], {f"_s{i}": (f"_v{i}", SUM) for i in range(len(columns))}, parts)
    kept = F.first(F.when(F.col("_row"), F.struct(*df.columns)), ignorenulls=True).alias("r")
    sums = [F.sum(F.when(F.col("_kind") == 2, F.col(f"_s{i}")).when(F.col("_kind") == 0, -F.coalesce(F.col(f"_s{i}"), F.lit(0)))).alias(n) for i, n in enumerate(columns)]
    return found.groupBy(F.col(key).alias("_row")).agg(kept, *sums).select("r.*", *columns)
