"""Stateful streams: running moments by key and the most recent rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.sources.shared import remove


def running_moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and deviation of a value by key; on a stream the state lives in Spark's checkpoint."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def recent_rows(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """Per key the last n rows by an order."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def keep_recent(path: str, by: str, order: list[str], n: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch writes the next version of the log, so a repeated batch changes nothing.

    Version k holds the last n rows by key after batch k; batches are numbered from 0 without gaps.
    The version before the last stays for a repeated batch, older ones are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        if number > 0:
            batch = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={number - 1}"))
        recent_rows(batch, by, order, n).write.mode("overwrite").parquet(f"{path}/version={number}")
        if number > 1:
            remove(batch.sparkSession, f"{path}/version={number - 2}")

    return write
