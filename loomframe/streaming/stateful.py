"""Streams with state of their own by key: running moments that merge, and the last rows of a key.

State lives in Spark's state store (RocksDB) and in the query's checkpoint: a query that stops, or whose
executors are lost, goes on from its last batch. The state can be read back as a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from heapq import nlargest
from itertools import chain
from math import sqrt
from typing import Any

from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOMENTS = "n long, mean double, m2 double"
#: Keys share a state by their hash, in so many buckets.
BUCKETS = 4096


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, as states of their own need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and sum of squared deviations of two sets of values together."""
    n = a[0] + b[0]
    if not n:
        return a
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def _sort_key(v: Any) -> tuple[bool, bool, Any]:
    """Nulls below all, NaN above all numbers and equal to itself, as Spark sorts."""
    nan = v != v  # noqa: PLR0124
    return v is not None, nan, 0 if v is None or nan else v


class Moments(StatefulProcessor):
    """Merges each batch's moments of the keys of a bucket into their state; rows without a value count for nothing."""

    def __init__(self, key: str, value: str, schema: str):
        self.columns, self.schema = (key, value), schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("moments", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = {_sort_key(r[0]): tuple(r) for r in self.state.get()}
        changed = set()
        for r in rows:
            own, v = (r[c] for c in self.columns)
            k = _sort_key(own)
            changed.add(k)
            own, *moments = now.get(k, (own, 0, 0.0, 0.0))
            # NaN is no value, as null
            now[k] = (own, *(moments if v is None or v != v else merged(tuple(moments), (1, float(v), 0.0))))
        self.state.put(list(now.values()))
        shape = Row(self.columns[0], "n", "mean", "std")
        for own, n, mean, m2 in (now[k] for k in changed):
            yield shape(own, n, mean if n else None, sqrt(m2 / (n - 1)) if n > 1 else None)

    def close(self) -> None:
        pass


def _bucketed(stream: DataFrame, key: str, buckets: int) -> GroupedData:
    """The rows of a stream by the bucket of their key."""
    kind = dict(stream.dtypes)[key]
    if kind in ("float", "double"):
        # zero for negative zero, which hashes apart
        stream = stream.withColumn(key, (F.col(key) + F.lit(0.0)).cast(kind))
    return stream.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("_bucket")


def moments_stream(stream: DataFrame, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """The moments of each key that a batch changed: ``n``, ``mean``, ``std``; ``buckets`` stays as the stream's checkpoint began."""
    kind = dict(stream.dtypes)[key]
    rows = _bucketed(stream.select(key, value), key, buckets)
    return rows.transformWithState(Moments(key, value, f"{key} {kind}, {MOMENTS}"), f"{key} {kind}, n long, mean double, std double", "Update", "None")


def _values(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    s = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return s.select(("list_element" if "list_element" in s.columns else "value") + ".*")


def moments_state(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """All keys' moments as a query's checkpoint holds them."""
    n = F.col("n")
    return _values(spark, checkpoint, "moments").select(key, n, F.when(n > 0, F.col("mean")).alias("mean"), F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"))


class Recent(StatefulProcessor):
    """Keeps the last rows of each key of a bucket by an order as a list; those that fell out are gone from the state.

    A call of the state costs more than the rows of a key, so keys share one. ``columns`` begin with the key.
    """

    def __init__(self, order: list[str], columns: list[str], schema: str, n: int):
        self.columns, self.schema, self.n = columns, schema, n
        self.order = [columns.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("recent", self.schema)

    def last(self, rows: list[tuple]) -> list[tuple]:
        # of equal rows the first stay
        return nlargest(self.n, rows, key=lambda r: tuple(_sort_key(r[i]) for i in self.order))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        kept: dict[tuple, list[tuple]] = {}
        for r in self.state.get():
            kept.setdefault(_sort_key(r[0]), []).append(tuple(r))
        changed = set()
        for r in rows:
            row = tuple(r[c] for c in self.columns)
            k = _sort_key(row[0])
            changed.add(k)
            own = kept.setdefault(k, [])
            own.append(row)
            # so a key holds few rows more than it keeps
            if len(own) >= 8 * self.n:
                own[:] = self.last(own)
        kept = {k: self.last(own) if k in changed else own for k, own in kept.items()}
        self.state.put([r for own in kept.values() for r in own])
        shape = Row(*self.columns)
        for k in changed:
            yield from (shape(*r) for r in kept[k])

    def close(self) -> None:
        pass


def recent_stream(stream: DataFrame, key: str, order: list[str], n: int, buckets: int = BUCKETS) -> DataFrame:
    """The last n rows of each key that a batch changed, in whole; ``buckets`` stays as the stream's checkpoint began."""
    kinds = dict(stream.dtypes)
    columns = [key, *[c for c in stream.columns if c != key]]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return _bucketed(stream, key, buckets).transformWithState(Recent(order, columns, schema, n), schema, "Update", "None")


def recent_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All keys' last rows as a query's checkpoint holds them."""
    return _values(spark, checkpoint, "recent")
