"""Batch sources and sinks: the tables, round trips through file formats, and a Python data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.sources.shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round_trip(df: DataFrame, form: str, **options: str) -> DataFrame:
    """Write df in a file format to the shared folder and read it again with its schema."""
    path = new_path(df.sparkSession, form)
    df.write.format(form).options(**options).save(path)
    return df.sparkSession.read.format(form).schema(df.schema).options(**options).load(path)


def partitioned(df: DataFrame, *columns: str) -> DataFrame:
    """Write df as Parquet in a folder per value of columns, and read it again: filters on these prune folders."""
    path = new_path(df.sparkSession, "partitioned")
    df.write.partitionBy(*columns).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, *columns: str) -> DataFrame:
    """df as a table in the shared folder, in buckets of columns and sorted by them: joins and aggregates on these need no exchange.

    One file a bucket, as rows are dealt out like the buckets before they are written. The table stays in the catalog under a name of its own.
    """
    spark = df.sparkSession
    path = new_path(spark, "bucketed")
    name = f"bucketed_{path[-32:]}"
    df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(name)
    return spark.table(name)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class CalendarSource(DataSource):
    """format("calendar"): a row per day from option start to option end (both included), read in `parts` partitions."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, year int, month int, weekday int"

    def reader(self, schema: object) -> DataSourceReader:
        return _CalendarReader(self.options)


class _CalendarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        from datetime import date

        self.first, self.last = (date.fromisoformat(options[k]).toordinal() for k in ("start", "end"))
        self.parts = int(options.get("parts", 4))

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-(self.last - self.first + 1) // self.parts))
        return [_Range(a, min(a + step, self.last + 1)) for a in range(self.first, self.last + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        from datetime import date

        for n in range(part.start, part.end):
            day = date.fromordinal(n)
            yield day, day.year, day.month, day.isoweekday()


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    spark.dataSource.register(CalendarSource)
    return spark.read.format("calendar").option("start", start).option("end", end).load()
