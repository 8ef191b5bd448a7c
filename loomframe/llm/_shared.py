"""Session helpers of the training-data operators: shared storage, broadcasts of checked size.

Batches that go to Python are bounded in bytes by Spark (spark.sql.execution.arrow.maxBytesPerBatch,
64 MB unless set otherwise), so long texts need no setting of the operators.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows of a few numbers each that are sent to all executors at most.
SENT_ROWS = 1_000_000
NOT_SPACE = "[^\\x20\\x09-\\x0D]"


@cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="loomframe-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset a temporary folder serves, which goes when Python ends, but only in local mode;
    a cluster without the setting is an error, as executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local_dir()
    return found.rstrip("/")


_made: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end what was written within, but the tables that are given to its function."""
    paths: list[str] = []
    _made.append(paths)

    def kept(df: DataFrame) -> DataFrame:
        paths.remove(df.stored_at)
        return df

    try:
        yield kept
    finally:
        _made.remove(paths)
        for path in paths:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, reread: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes materialized tables that nothing reads any more."""
    for t in tables:
        _remove(spark, t.stored_at)


def sendable(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which are few and small; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def same(names: list[str], prefix: str) -> Column:
    """Whether the named columns equal those with the prefix, nulls included."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in names])


def with_copy_numbers(df: DataFrame, by: list[str], most: int, suspects: DataFrame) -> DataFrame:
    """df with ``_copy``: 0, but a number from 0 for each of the rows equal in ``by`` if more than ``most`` are.

    ``suspects``: values of some columns of df among which such rows are. The rows are counted by
    partition and then within their partition, so no task holds all of a crowd; being written, they
    keep their numbers if a task runs again.
    """
    crowds = df.join(sendable(suspects), suspects.columns, "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    crowds = sendable(materialize(crowds.select(*[F.col(c).alias("_h" + c) for c in by]), "crowds"))
    found = df.join(crowds, same(by, "_h"), "left_semi").withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    found = materialize(found, "copies")
    before = found.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    before = sendable(materialize(before.select(*[F.col(c).alias("_h" + c) for c in (*by, "_part")], "_before"), "before"))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_seq"))
    found = found.withColumn("_k", within).join(before, same([*by, "_part"], "_h"))
    found = found.select(*df.columns, (F.col("_before") + F.col("_k") - 1).cast("long").alias("_copy"))
    others = df.join(crowds, same(by, "_h"), "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    return others.unionByName(found)


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
