"""Aggregates of huge groups from counts alone: exact quantiles, mergeable distinct counts, frequent items."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import discard, materialise


def _match(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(and_, (a[c].eqNullSafe(b[f"_{c}"]) for c in columns), F.lit(True))


def _magnitude(v: Column) -> Column:
    """Rises with v, by one for each doubling away from 0."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1080))


def quantiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float], bins: int = 1024) -> DataFrame:
    """Exact discrete quantiles: of each group the least value that has at least that share of its values below or at it.

    fractions: output column -> share. Nothing is sorted or gathered: a pass counts a group's values in `bins` bins between the
    least and the greatest candidate; the bin that holds the wanted rank has the next pass's candidates, until it holds one value.
    Candidates' ends are met values, so that each pass parts them: for usual values that takes two to four passes, and
    it ends for any. Between passes a row a group and fraction is kept. Values are read as doubles; nulls don't count; NaN is the greatest; a group
    of nulls gives nulls; a null key is a group; no rows give no rows (without `by`: a row of nulls).
    """
    keys, by = by, [f"_by{i}" for i in range(len(by))]
    inf = F.lit(float("inf"))
    v = df.select(*[F.col(c).alias(b) for c, b in zip(keys, by, strict=True)], F.col(value).cast("double").alias("_v"))
    finite = F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < inf)
    sizes = v.groupBy(*by).agg(
        F.count("_v").alias("n"), F.count_if(F.isnan("_v")).alias("nan"), F.count_if(F.col("_v") == -inf).alias("neg"), F.count_if((F.col("_v") == inf) & ~F.isnan("_v")).alias("pos"),
        F.min(F.when(finite, F.col("_v"))).alias("lo"), F.max(F.when(finite, F.col("_v"))).alias("hi"),
    )
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(p)).alias("p")) for n, p in fractions.items()]))
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("w.p"))).cast("long")
    states = sizes.withColumn("w", names).withColumn("k", rank)
    known = F.when(F.col("n") == 0, F.lit(None).cast("double")).when(F.col("k") <= F.col("neg"), -inf).when(F.col("k") > F.col("n") - F.col("nan"), F.lit(float("nan"))).when(F.col("k") > F.col("n") - F.col("nan") - F.col("pos"), inf)
    done = (F.col("n") == 0) | (F.col("k") <= F.col("neg")) | (F.col("k") > F.col("n") - F.col("nan") - F.col("pos"))
    states = states.select(*by, F.col("w.q").alias("q"), (F.col("k") - F.col("neg")).alias("k"), F.when(done, known).otherwise(F.col("lo")).alias("lo"), F.when(done, known).otherwise(F.col("hi")).alias("hi"), done.alias("done"))
    states = materialise(states.withColumn("done", F.col("done") | (F.col("lo") == F.col("hi"))), "states")
    while states.where("NOT done").take(1):
        open_ = states.where("NOT done").select(*[F.col(c).alias(f"_{c}") for c in by], "q", "k", "lo", "hi")
        some = v.where(finite)
        some = some.join(open_, _match(some, open_, by)).where("_v BETWEEN lo AND hi")
        # by magnitude first, so that values of any scales are parted soon; halves, so that differences are finite
        scaled = [_magnitude(F.col(c)) for c in ("_v", "lo", "hi")]
        even = F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        place = F.when(scaled[1] < scaled[2], (scaled[0] - scaled[1]) / F.greatest(scaled[2] - scaled[1], F.lit(5e-324))).otherwise(even)
        # where halves of the least doubles vanish, the ends alone are parted
        place = F.when(F.isnan(place) | place.isNull(), F.when(F.col("_v") == F.col("lo"), 0.0).otherwise(1.0)).otherwise(place)
        spread = F.when(F.col("_v") == F.col("hi"), F.lit(bins - 1)).otherwise(F.least(F.lit(max(0, bins - 2)), F.floor(place * (bins - 1)))).cast("int")
        counts = some.groupBy(*by, "q", "k", spread.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b"))
        along = Window.partitionBy(*by, "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        found = counts.withColumn("upto", F.sum("c").over(along)).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
        found = found.select(*by, "q", (F.col("k") - F.col("upto") + F.col("c")).alias("k"), F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("a") == F.col("b")).alias("done"))
        new = materialise(states.where("done").unionByName(found), "states")
        discard(states)
        states = new
    found = states.groupBy(*by).agg(*[F.max(F.when(F.col("q") == n, F.col("lo"))).alias(f"_f{i}") for i, n in enumerate(fractions)])
    return found.select(*[F.col(b).alias(c) for c, b in zip(keys, by, strict=True)], *[F.col(f"_f{i}").alias(n) for i, n in enumerate(fractions)])


def distinct_levels(df: DataFrame, levels: list[str], columns: dict[str, str]) -> DataFrame:
    """Exact distinct counts of whole-number columns at every prefix of levels, from the full one to none: a roll-up.

    columns: output column -> column of ids (dense ones: each 32768 neighbouring ids that occur cost a bitmap of 4 KB a group).
    Ids become bits of bitmaps by bucket, built on the map side, written once for the finest level and or-ed together level by
    level: rows aren't multiplied by columns (no Expand), and a group's ids never meet in one task, as its buckets are dealt
    out. Nulls don't count; no rows give the total of 0 alone. Returns levels (null above their own), level (how many are set) and the counts.
    """
    out = None
    for name, column in columns.items():
        ids = df.where(F.col(column).isNotNull()).select(*levels, F.bitmap_bucket_number(F.col(column)).alias("_b"), F.bitmap_bit_position(F.col(column)).alias("_p"))
        maps = materialise(ids.groupBy(*levels, "_b").agg(F.bitmap_construct_agg("_p").alias("_m")), "bitmaps")
        rows = []
        for n in range(len(levels), -1, -1):
            kept = levels[:n]
            merged = maps if n == len(levels) else maps.groupBy(*kept, "_b").agg(F.bitmap_or_agg("_m").alias("_m"))
            counts = merged.groupBy(*kept).agg(F.coalesce(F.sum(F.bitmap_count("_m")), F.lit(0)).alias("_n"))
            rows.append(counts.select(*[F.col(c) if c in kept else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in levels], F.lit(n).alias("level"), F.lit(name).alias("_name"), "_n"))
        found = reduce(DataFrame.unionByName, rows)
        out = found if out is None else out.unionByName(found)
    # groups whose ids are all null have no bitmap; they count 0
    groups = reduce(DataFrame.unionByName, [df.groupBy(*levels[:n]).agg(F.count("*").alias("_c")).select(*[F.col(c) if c in levels[:n] else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in levels], F.lit(n).alias("level")) for n in range(len(levels), -1, -1)])
    out = out.unionByName(groups, allowMissingColumns=True)
    return out.groupBy(*levels, "level").agg(*[F.coalesce(F.max(F.when(F.col("_name") == n, F.col("_n"))), F.lit(0)).cast("long").alias(n) for n in columns])


def frequent_items(df: DataFrame, by: list[str], item: str, k: int, tracked: int, part: Column | None = None) -> DataFrame:
    """The k most frequent items of each group by a frequent-items sketch, with its error bound.

    Sketches are accumulated in parts of a group (by `part`, or one), combined, and estimated, so that a hot group is spread.
    Up to `tracked` items are counted at a time: while a group has no more than three quarters of them, counts are exact;
    beyond, an estimate is too high by at most bound = 3.5 / tracked of the group's rows. Nulls don't count.
    Returns by, item, estimate, bound.
    """
    rows = df.where(F.col(item).isNotNull())
    parts = rows.groupBy(*by, (part if part is not None else F.lit(0)).alias("_part")).agg(F.expr(f"approx_top_k_accumulate(`{item}`, {tracked})").alias("_s"), F.count("*").alias("_n"))
    merged = parts.groupBy(*by).agg(F.expr(f"approx_top_k_combine(_s, {tracked})").alias("_s"), F.sum("_n").alias("_n"))
    best = merged.select(*by, "_n", F.explode(F.expr(f"approx_top_k_estimate(_s, {k})")).alias("_e"))
    return best.select(*by, F.col("_e.item").alias(item), F.col("_e.count").alias("estimate"), F.ceil(F.col("_n") * 3.5 / tracked).alias("bound"))
