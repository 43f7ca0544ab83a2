"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Deletes a query's shuffle files when it ends; without it they stay until the driver's JVM collects its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and Spark is local."""
    set_one = spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/lodestone-shared"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; those of before come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; its shuffle files go when that ends.

    This cuts lineage, survives lost executors, and makes both inputs of a later join plain scans,
    so that adaptive execution may split a skewed side. discard() deletes the table.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later result reads."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.shared_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
