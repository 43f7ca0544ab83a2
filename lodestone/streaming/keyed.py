"""Keyed state with timers and time to live, and state that two streams share."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.sources.shared import new_path


def in_batches(df: DataFrame, at: str, batches: int, jitter_seconds: int = 0, key: str | None = None) -> str:
    """Write df as files for as many micro-batches, in the order of `at`; returns their folder.

    jitter_seconds: rows come up to so much later than they should (by a hash of key), that is out of order across batches.
    """
    spark = df.sparkSession
    path = new_path(spark, "batches")
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    late = seconds + (F.pmod(F.xxhash64(key), F.lit(jitter_seconds)) if jitter_seconds else 0)
    first, last = df.agg(F.min(seconds), F.max(seconds) + jitter_seconds).first()
    step = ((last or 0) - (first or 0)) / batches or 1
    cut = df.withColumn("_batch", F.least(F.lit(batches - 1), F.floor((late - F.lit(first)) / step)))
    for i in range(batches):  # files are read in the order of their times
        cut.where(F.col("_batch") == i).drop("_batch").repartition(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    return path


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files under path, one a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


class IdleSessions(StatefulProcessor):
    """Sessions of a bucket's users: rows less than `gap` apart; an event-time timer closes them when the watermark passes their ends.

    State: a table of the users' open sessions, a row per type in them, in Arrow's format as one value. Rows of a batch are merged with it together, as late rows may open a session before
    another or join two. A bucket has one timer, for the end of what ends first; that closes all that the watermark has passed, and a bucket without
    open sessions keeps no state. No call and no timer thus belongs to a single user or session.
    """

    COLUMNS = ["user_id", "start", "end", "type", "n"]

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")

    def _state(self) -> pd.DataFrame:
        return pa.ipc.open_stream(bytes(self.open.get()[0])).read_pandas() if self.open.exists() else pd.DataFrame(columns=self.COLUMNS)

    def _put(self, rows: pd.DataFrame) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rows):
            table = pa.Table.from_pandas(rows[self.COLUMNS], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.open.update((sink.getvalue().to_pybytes(),))
            self.handle.registerTimer(int(rows["end"].min()) + self.gap)
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [pd.DataFrame({"user_id": p["user_id"], "start": p["at"], "end": p["at"], "type": p["type"], "n": 1}) for p in rows]
        old = self._state()
        every = pd.concat([old, *new] if len(old) else new).sort_values(["user_id", "start"], ignore_index=True)
        reached = every.groupby("user_id")["end"].cummax().shift(fill_value=0)
        session = ((every["user_id"] != every["user_id"].shift()) | (every["start"] - reached >= self.gap)).cumsum()
        every["start"], every["end"] = every.groupby(session)["start"].transform("min"), every.groupby(session)["end"].transform("max")
        self._put(every.groupby(self.COLUMNS[:4], as_index=False, sort=False)["n"].sum())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        rows = self._state()
        over = rows["end"] + self.gap <= timerValues.getCurrentWatermarkInMs()
        self._put(rows[~over])
        if over.any():
            yield rows[over].groupby(["user_id", "start", "end"], as_index=False).agg(n=("n", "sum"), kinds=("type", "nunique"))

    def close(self) -> None:
        pass


#: Buckets of users, whose state is read and written together.
USER_BUCKETS = 256


def idle_sessions(stream: DataFrame, gap_seconds: int, late: str, buckets: int = USER_BUCKETS) -> DataFrame:
    """Closed sessions of users (user_id, start, end: of its last event, in ms, n, kinds: different types); start under PROCESSOR_STORE.

    stream: user_id, event_type, ts (timestamp). Spark drops rows that are later than the watermark of the batch before; those of a null
    user or time are left out. A bucket's rows of a micro-batch and its open sessions are in memory at a time: take more buckets for more users.
    """
    rows = stream.where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).select(F.col("user_id").cast("long").alias("user_id"), F.unix_millis("ts").alias("at"), F.coalesce("event_type", F.lit("")).alias("type"), "ts")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(IdleSessions(gap_seconds), "user_id long, start long, end long, n long, kinds long", "Append", "EventTime")


class Balances(StatefulProcessor):
    """Running sums that begin with what a table says, and are forgotten when a key has been quiet for a time to live."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, total long", self.ttl)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self.sums.update((0, int(initialState["total"].sum())))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, total = map(int, self.sums.get()) if self.sums.exists() else (0, 0)
        for part in rows:
            n, total = n + len(part), total + int(part["cents"].fillna(0).sum())
        self.sums.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def balances(stream: DataFrame, initial: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Each user's rows and sum of cents on top of initial (user_id, total), updated with every batch; start under PROCESSOR_STORE.

    A time to live counts processing time since a key's last update, after which the key starts from nothing; a query with one
    doesn't end by itself (not even for availableNow), as it runs batches without rows: trigger it once or stop it. Rows of a null user are left out.
    """
    stream = stream.where("user_id IS NOT NULL")
    return stream.groupBy("user_id").transformWithStateInPandas(Balances(ttl_ms), "user_id long, n long, total long", "Update", "ProcessingTime" if ttl_ms else "None", initial.groupBy("user_id"))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str, how: str = "left") -> DataFrame:
    """Rows of two streams with one key whose right row is at most `within` earlier than the left one; left rows without one in the end.

    Both sides have a watermark of `late`, so that Spark drops a row's state when nothing can meet it any more; a left row
    that met nothing comes out then. Rows with a null key meet nothing. Column names of the sides must differ but for the key.
    """
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late).withColumnRenamed(key, f"_{key}")
    near = (F.col(key) == F.col(f"_{key}")) & (F.col(right_time) <= F.col(left_time)) & (F.col(right_time) >= F.col(left_time) - F.expr(f"INTERVAL {within}"))
    return a.join(b, near, how).drop(f"_{key}")
