"""Structured Streaming over the table events, run to its end over what there is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.sources.shared import new_path

#: Settings for stateful processors, whose state must be in RocksDB.
PROCESSOR_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files under path, one per micro-batch."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def appended(df: DataFrame, tag: str) -> DataFrame:
    """Run an append-mode query into Parquet files and read these."""
    spark = df.sparkSession
    out = new_path(spark, tag)
    query = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", new_path(spark, f"{tag}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def latest(df: DataFrame, tag: str, mode: str = "complete", keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Run a complete-mode query, or an update-mode one with keys and a rising order column, and read its last state."""
    spark = df.sparkSession
    out = new_path(spark, tag)

    def put(batch: DataFrame, number: int) -> None:  # a batch that runs again after a failure takes its own place
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", new_path(spark, f"{tag}-log")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if mode == "complete":
        return rows.where(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0])).drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("s")).select(*keys, "s.*")


def tumbling_counts(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their value in cents by window and type."""
    kept = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = kept.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


def session_counts(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of users: events less than a gap apart."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def first_events(stream: DataFrame, late: str = "400 days") -> DataFrame:
    """An event of each type and user, once: dedup within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def running_totals(stream: DataFrame) -> DataFrame:
    """A user's events and highest value so far, in state of their own."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, float("-inf"))
        for part in parts:
            n, top = n + len(part), max(top, float(part["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    return stream.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, top double", "n long, top double", "update", GroupStateTimeout.NoTimeout)


class Totals(StatefulProcessor):
    """A user's events and highest value so far, in a value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, top double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        n, top = self.totals.get() if self.totals.exists() else (0, float("-inf"))
        for part in rows:
            n, top = n + len(part), max(top, float(part["value"].max()))
        self.totals.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    def close(self) -> None:
        pass


def processed_totals(stream: DataFrame) -> DataFrame:
    """running_totals by a stateful processor; start the query under PROCESSOR_STORE."""
    return stream.select("user_id", "value").groupBy("user_id").transformWithStateInPandas(Totals(), "user_id long, n long, top double", "Update", "None")
