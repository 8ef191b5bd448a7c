"""Places and running sums in the order of a whole table or of its groups, whatever their size.

Rows are dealt out by ranges of the order, so a group may span many tasks; counts by task and group
carry the numbers on from one task to the next. Only rows that are equal in group and whole order
need one task; ``order`` should end with columns that tell them apart where there may be many.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.sources.shared import store

Keep = Callable[[DataFrame, str], DataFrame]
#: A number of monotonically_increasing_id has the partition above and the place in it below.
PLACE_BITS = 33


def join_safe(df: DataFrame, other: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names in which nulls meet nulls; the names stand once."""
    side = {c: f"_of_{c}" for c in names}
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(o)) for c, o in side.items()])
    return df.join(other.withColumnsRenamed(side), on, how).drop(*side.values())


def tied(df: DataFrame, name: str = "_tie") -> DataFrame:
    """df with a hash of each row, which orders rows that are equal otherwise and spreads them over ranges."""
    return df.withColumn(name, F.xxhash64(*df.columns))


def crowded(df: DataFrame, by: list[str], most: int) -> DataFrame | None:
    """Groups of more than so many rows with their ``count``, written; None if there are none."""
    out = df.groupBy(*by).count().filter(F.col("count") > most)
    return None if out.isEmpty() else store(out, "crowded")


def places(df: DataFrame, by: list[str], order: list[str | Column], place: str = "place", total: str | None = None, keep: Keep = store) -> DataFrame:
    """df with the place of each row from 0 within its group (nulls are a group) by an order, and the group's count.

    The rows are stored in order once (``keep``), so their places stay if a task runs again. Nulls come
    first unless the order says otherwise; rows equal in the order get places in any order.
    """
    d = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_row", F.monotonically_increasing_id())
    d = keep(d, "places")
    d = d.withColumns({"_part": F.shiftright("_row", PLACE_BITS), "_in": F.col("_row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_row")
    # a row for each task and group that meet: tasks hold ranges, so these are few more than the groups
    runs = d.groupBy(*by, "_part").agg(F.min("_in").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    added = {"_shift": F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")}
    if total:
        added["_total"] = F.sum("_n").over(Window.partitionBy(*by))
    runs = runs.withColumns(added).drop("_first", "_n")
    d = join_safe(d, runs, [*by, "_part"])
    out = d.withColumn(place, F.col("_in") + F.col("_shift"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_in", "_shift", "_total")


def running_totals(df: DataFrame, by: list[str], place: str, sums: dict[str, Column], width: int = 4096, inclusive: bool = False) -> DataFrame:
    """df with sums over the rows of its group before each one (and of itself if inclusive).

    ``place``: dense numbers from 0 within the group, as ``places`` gives them; sums run in blocks of
    ``width`` rows and over the blocks' totals. A null counts as nothing.
    """
    d = df.withColumn("_block", F.floor(F.col(place) / width)).withColumns({f"_v{k}": c for k, c in enumerate(sums.values())})
    values = [f"_v{k}" for k in range(len(sums))]
    blocks = d.groupBy(*by, "_block").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v + "t") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({v + "b": F.coalesce(F.sum(v + "t").over(earlier), F.lit(0)) for v in values}).drop(*[v + "t" for v in values])
    within = Window.partitionBy(*by, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumns({v + "w": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    d = join_safe(d, blocks, [*by, "_block"])
    return d.select(*df.columns, *[(F.col(v + "b") + F.col(v + "w")).alias(name) for v, name in zip(values, sums, strict=True)])
