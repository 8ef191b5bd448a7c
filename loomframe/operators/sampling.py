"""Deterministic sampling, splitting, shuffling and generation by quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.text import fill, unit_hash
from loomframe.operators.ordering import crowded, places


#: Rows of a category that are ranked in one task at most.
GROUP_ROWS = 50_000


def order_key(seed: str, *cols: Column) -> Column:
    """A reproducible random order: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]))


def quota_sample(df: DataFrame, category: str, key: str, quotas: DataFrame, seed: str) -> DataFrame:
    """Per category the first rows in random order, up to its ``quota`` or the pool's size; ``rank`` from 1.

    Categories of more than GROUP_ROWS rows are ranked by ranges of the order over many tasks.
    """
    d = df.join(quotas, category).withColumn("_order", order_key(seed, F.col(key)))
    w = Window.partitionBy(category).orderBy("_order", key)

    def first(d: DataFrame, rank: Column) -> DataFrame:
        return d.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= F.col("quota"))

    long = crowded(df, [category], GROUP_ROWS)
    if long is None:
        return first(d, F.row_number().over(w)).drop("_order")
    spread = places(d.join(long.select(category), category, "left_semi"), [category], ["_order", key], place="_place")
    few = first(d.join(long.select(category), category, "left_anti"), F.row_number().over(w))
    return first(spread, F.col("_place") + 1).drop("_place").unionByName(few).drop("_order")


def quota_plan(shares: DataFrame, n: int) -> DataFrame:
    """Rows to make of each category: its share of n, rounded down."""
    return shares.withColumn("quota", F.floor(F.col("share") * n).cast("int"))


def hash_split(df: DataFrame, content: Column, held_share: float, seed: str) -> DataFrame:
    """``part``: validation for the given share of contents; equal contents stay together."""
    return df.withColumn("part", F.when(unit_hash(F.lit(seed), content) < held_share, "validation").otherwise("train"))


def drop_repeated(df: DataFrame, by: list[str], first: list[str]) -> DataFrame:
    """Of rows equal in ``by`` the first in the order of ``first``, then of the other columns; a crowd is reduced where it stands."""
    rest = [c for c in df.columns if c not in by and c not in first]
    least = df.groupBy(*by).agg(F.min(F.struct(*first, *rest)).alias("_r"))
    return least.select(*[F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in df.columns])


def take_with_replacement(pool: DataFrame, index: str, n: int, size: int, seed: str) -> DataFrame:
    """n draws from a pool numbered from 0 by ``index``."""
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(unit_hash(F.lit(seed), F.col("id")) * size).cast("long").alias(index))
    return draws.join(pool, index)


def expand_templates(templates: DataFrame, slots: DataFrame, names: list[str]) -> DataFrame:
    """Every template with every row of slot values filled in; both are literal tables of fixed size."""
    filled = {n: F.col(n) for n in names}
    return templates.crossJoin(slots).select(
        "kind", fill(F.col("pattern"), **filled).alias("instruction"), fill(F.col("command"), **filled).alias("command"), "confidence"
    )
