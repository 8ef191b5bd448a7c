"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered from 0 in a fixed order that depends on their content alone: by hash bucket,
then within the bucket by id, text checksum, size and text hash. The permutation is a balanced
Feistel network over the next even power of two, walked along its cycle until it is back below the
row count; the walk always ends. With p the permuted number, shard = p mod shards and slot =
p div shards, so both can be computed from a row number alone, counts differ by one at most and
slots have no gap.

Defined cases: a null text has size 8 and the checksum of the empty text; rows equal in all these
values share out their numbers in any order, whatever their count; a null id is a value like others;
very long texts are only hashed; further columns are carried as they are, whatever their names; an
empty table gives an empty result. Equal texts are no group of their own under this law: with shards
of equal counts each row is placed by itself, so copies of a text may stand in several shards.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm._shared import materialize, with_copy_numbers

BUCKET_ROWS, MAX_BUCKETS = 2048, 1 << 16
#: A bucket of so many times its share of rows is crowded.
CROWDED = 4
ROUNDS = 6
MIX = np.uint64(0x9E3779B97F4A7C15)


def _round(x: np.ndarray, key: int) -> np.ndarray:
    z = (x + np.uint64(key)) * MIX
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


def feistel(number: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permutation of 0 to n - 1 at each number."""
    if n <= 1:
        return number.astype(np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(seed * 1_000_003 + r * 7919 + 1) & 0xFFFFFFFF for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        return (left << h) | right

    out = once(number.astype(np.uint64))
    while (beyond := np.flatnonzero(out >= n)).size:
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def unfeistel(p: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number that is permuted to p."""
    if n <= 1:
        return p.astype(np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(seed * 1_000_003 + r * 7919 + 1) & 0xFFFFFFFF for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for k in reversed(keys):
            left, right = right ^ (_round(left, k) & mask), left
        return (left << h) | right

    out = once(p.astype(np.uint64))
    while (beyond := np.flatnonzero(out >= n)).size:
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], count: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with ``row_number`` from 0, by bucket of the order columns' hash and then by them.

    Two narrow passes: counts by bucket, then a window over buckets of bounded size. Where a bucket is
    crowded because many rows are equal in the order columns, such rows are counted and part by part
    put into buckets of their own hash, so the numbers still depend on the rows alone.
    """
    buckets = max(1, min(MAX_BUCKETS, ceil(count / bucket_rows)))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = materialize(df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")), "sizes")
    most = CROWDED * max(bucket_rows, count // buckets)
    crowded = sizes.filter(F.col("n") > most).select("_bucket")
    if crowded.isEmpty():
        df = df.withColumn("_copy", F.lit(0).cast("long"))
    else:
        df = with_copy_numbers(df, order, bucket_rows, crowded)
        part = F.floor(F.col("_copy") / bucket_rows)
        df = df.withColumn("_bucket", F.when(part > 0, F.pmod(F.xxhash64(*order, part), F.lit(buckets)).cast("int")).otherwise(F.col("_bucket")))
        sizes = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most MAX_BUCKETS rows
    before = sizes.select(
        "_bucket", F.coalesce(F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    before = materialize(before, "buckets")
    w = Window.partitionBy("_bucket").orderBy(*order, "_copy")
    out = df.join(before, "_bucket").withColumn("row_number", F.col("_before") + F.row_number().over(w) - 1)
    return out.drop("_bucket", "_before", "_copy")


def shard_rows(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 20,
    bucket_rows: int = BUCKET_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (carried columns), ``size``, ``text_crc32``, ``row_number``, ``shard`` and ``slot`` of each row."""
    carry = docs.columns if carry is None else carry
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("row"),
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
    )
    slim = set(carry) <= {id_col}
    if slim:
        d = materialize(d, "sharding")
    n = d.count() if slim else docs.count()

    @F.pandas_udf(T.LongType())
    def permuted(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), n, seed))

    d = number_rows(d, ["_id", "text_crc32", "size", "_hash"], n, bucket_rows).withColumn("_p", permuted("row_number"))
    return d.select(
        "row",
        "size",
        "text_crc32",
        "row_number",
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"),
    )
