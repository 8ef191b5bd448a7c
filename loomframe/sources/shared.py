"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short columns that are sent to all executors at most.
SMALL_ROWS = 500_000


@cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="loomframe-core-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever it is; nothing if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_scratch: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    """Removes what scratch paths hold when Python ends; what Spark no longer reaches then stays."""
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, removed when Python ends; in local mode without it, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_dir()
    _scratch.append((spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"))
    return _scratch[-1][1]


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and reread: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
