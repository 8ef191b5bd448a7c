"""Lines of text files by their place: numbered over all files, the last ones, side by side.

A line's place is that of its file (by path), of its block in the file and its place in the block, which is
what the reader's rows follow; blocks are counted, so numbers need no window over more than one block
and nothing in the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ["file", "block"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.text(path).select("value", *at)


def _blocks(lines: DataFrame) -> DataFrame:
    """One row a block: lines before it and in all. Blocks are few, as each holds a reader's split."""
    w = Window.orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(*BLOCK, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), "_n", F.sum("_n").over(Window.partitionBy()).alias("_total"))


def _placed(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    within = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("_row")) - 1
    d = lines.withColumn("_row", F.monotonically_increasing_id()).join(blocks, BLOCK)
    return d.withColumn("line", (F.col("_before") + within).cast("long")).drop("block", "_row", "_before", "_n", "_total")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``line`` (from 0, over all files in the order of their paths), ``value`` and ``file``."""
    lines = _lines(spark, path)
    return _placed(lines, _blocks(lines))


def last_lines(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """The last n lines with their numbers; only blocks that hold any of them are put in order."""
    lines = _lines(spark, path)
    least = F.col("_total") - n
    blocks = _blocks(lines).filter(F.col("_before") + F.col("_n") > least).withColumn("_least", least)
    return _placed(lines, blocks).filter(F.col("line") >= F.col("_least")).drop("_least", "file")


def zip_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """``line``, ``left`` and ``right``: lines of two sets of files at the same place; null beyond the shorter one's end."""
    a, b = (numbered_lines(spark, p).withColumnRenamed("value", c) for p, c in ((left, "left"), (right, "right")))
    return a.drop("file").join(b.drop("file"), "line", "full")
