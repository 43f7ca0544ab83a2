"""Joins that Spark has no good plan for, as DataFrame rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.slices import SUM, running


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: dict[str, str]) -> DataFrame:
    """Each row of left with the latest row of right for the same `by` that isn't later.

    values: column of right -> output name. Both sides become one stream per key, and a window carries the
    last right row forward: one shuffle on the key, no pairs. Of right rows at one time, the one with
    the largest values counts; a left row sees a right row of its own time. A null key or time matches nothing.
    """
    kept = left.columns
    held = F.struct(F.col(right_time).alias("_time"), *[F.col(c).alias(n) for c, n in values.items()])
    a = left.select(*kept, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_held"))
    b = right.where(F.col(right_time).isNotNull()).select(*[F.col(c) for c in by], F.col(right_time).alias("_at"), F.lit(0).alias("_side"), held.alias("_held"))
    both = a.drop("_held").unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("_at", "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_held", ignorenulls=True).over(order)).where("_side = 1")
    known = F.lit(True)
    for c in [*by, left_time]:
        known &= F.col(c).isNotNull()
    return found.select(*kept, *[F.when(known, F.col(f"_found.{n}")).alias(n) for n in values.values()])


#: Cells of a level are this many times wider than those of the level below; ranges beyond the last level share one cell.
FACTOR, LEVELS = 16, 16


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of rows with low <= point < high, all numeric.

    Each range goes to a level of cells about as wide as itself, so that it touches two cells however wide it is, and
    meets points by an equality join on level and cell: no nested loop runs. A point is repeated once for each level
    that some range needs, LEVELS + 1 at most. width is that of the narrowest cells: a usual range's length. Nulls match nothing.
    """
    cell = lambda c: F.when(F.col("_level") < LEVELS, F.floor(F.col(c) / (width * F.pow(F.lit(float(FACTOR)), F.col("_level")))).cast("long")).otherwise(F.when(F.col(c).isNotNull(), 0))
    span = (F.col(high) - F.col(low)).cast("double")
    fits = F.greatest(F.lit(0.0), F.ceil(F.log(float(FACTOR), span / width)).cast("double"))
    level = F.when(F.isnan(span) | (span >= width * float(FACTOR) ** (LEVELS - 1)), LEVELS).otherwise(fits.cast("int"))
    r = ranges.where(F.col(high) > F.col(low)).withColumn("_level", level)
    used = sorted(x["_level"] for x in r.select("_level").distinct().collect())
    r = r.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in used]).cast("array<int>"))).withColumn("_cell", cell(point))
    return p.join(r, ["_level", "_cell"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_level", "_cell")


def range_counts(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str) -> DataFrame:
    """(key, n): how many points with low <= point < high the ranges of each key have together, where there are any; all numeric.

    No pair is made: n is the points below the high ends less those below the low ones, and both are prefix sums over the sorted
    values (slices.running). The work grows with points and ranges, however many of them meet. Nulls, empty and turned ranges match nothing.
    """
    found = points.where(F.col(point).isNotNull()).groupBy(F.col(point).alias("_at")).agg(F.count("*").alias("_points"))
    kept = ranges.where(F.col(low) < F.col(high))
    ends = [kept.select(F.col(c).alias("_at"), F.col(key).alias("_key"), F.lit(sign).alias("_sign")) for c, sign in ((low, -1), (high, 1))]
    both = found.unionByName(ends[0].unionAll(ends[1]), allowMissingColumns=True).select(F.lit(0).alias("_all"), "*", F.col("_points").isNotNull().alias("_is_point"))
    # an end comes before the points of its own value
    below = running(both, ["_all"], ["_at", "_is_point"], {"_below": ("_points", SUM)}).where("NOT _is_point")
    return below.groupBy(F.col("_key").alias(key)).agg(F.sum(F.col("_sign") * F.coalesce("_below", F.lit(0).cast("long"))).alias("n")).where("n > 0")


def salted_join(facts: DataFrame, keys: DataFrame, key: str, salts: int) -> DataFrame:
    """Inner equality join in which each key's fact rows go to up to `salts` tasks; keys rows are repeated that often."""
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    copies = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "_salt"]).drop("_salt")
