"""Operators on ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each group before it shuffles. order must leave no ties."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", rank).where(F.col("place") <= k)


def sessions(df: DataFrame, key: str, time: str, order: str, gap_seconds: int) -> DataFrame:
    """Add session (from 1): it rises where a key's rows lie more than gap_seconds apart."""
    w = Window.partitionBy(key).orderBy(time, order)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    fresh = F.when(seconds(F.col(time)) - seconds(F.lag(time).over(w)) > gap_seconds, 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("session", (F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("_fresh")
