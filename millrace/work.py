"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only in local mode, where driver and executors are one process, a temporary folder takes its place."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/millrace"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written here go when it is written; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/millrace/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of dealt() gets, about.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in so many partitions that one has about TASK_ROWS rows, however many there are. Their number is fixed: adaptive execution
    puts partitions together by their compressed bytes, which for narrow rows are a small part of what a sort of them takes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)), *keys)


def ordinals(df: DataFrame, *order: str | Column, name: str = "_place") -> DataFrame:
    """df with each row's place in the whole order, from 0. Rows are dealt by ranges of the order and written; a range's offset is the number
    of rows in those before it, so that no task sees more than its range (and one row for each range). Equal rows keep any order."""
    part = "_part"
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(part, (ahead - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(offsets), part).withColumn(name, F.col("_at") + F.col("_shift")).drop(part, "_at", "_shift")
