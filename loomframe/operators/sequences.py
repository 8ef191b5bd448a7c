"""Operators on ordered groups: advantages, recursions, packing, rank alignment."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomframe.operators.ordering import crowded, join_safe, places, running_totals, tied
from loomframe.sources.shared import store

#: A group of more rows is spread over tasks.
GROUP_ROWS = 50_000


def group_advantage(df: DataFrame, group: str, reward: Column, scaled: bool | str = True, eps: float = 1e-4) -> Column:
    """Reward less its group's mean, over a deviation: the group's (True, "group"), the whole table's ("batch") or none (False, "none").

    "batch" reads the columns ``_std`` that ``with_batch_moments`` adds.
    """
    if scaled not in (True, False, "group", "batch", "none"):
        raise ValueError("scaled is group, batch or none")
    w = Window.partitionBy(group)
    gap = reward - F.avg(reward).over(w)
    if scaled == "batch":
        return gap / (F.col("_std") + eps)
    return gap / (F.stddev_samp(reward).over(w) + eps) if scaled in (True, "group") else gap


def with_batch_moments(df: DataFrame, value: Column) -> DataFrame:
    """df with ``_mean`` and ``_std`` of a value over the whole table."""
    return df.crossJoin(F.broadcast(df.agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))))


def leave_one_out(group: str, reward: Column) -> Column:
    """Reward less the mean of the others of its group; null if alone."""
    w = Window.partitionBy(group)
    others = F.count(reward).over(w) - 1
    return F.when(others > 0, reward - (F.sum(reward).over(w) - reward) / others)


def standardised(df: DataFrame, column: str, eps: float = 1e-4) -> DataFrame:
    """df with the column as a z-score over the whole table."""
    d = with_batch_moments(df, F.col(column))
    return d.withColumn(column, (F.col(column) - F.col("_mean")) / (F.col("_std") + eps)).drop("_mean", "_std")


def whiten(df: DataFrame, value: str, mask: Column, shift_mean: bool = True) -> Column:
    """Masked z-score by columns ``_m`` and ``_v`` of ``masked_moments``; without shift the mean is added back; 0 outside the mask."""
    white = (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)
    return F.when(mask, white if shift_mean else white + F.col("_m")).otherwise(0.0)


def masked_moments(df: DataFrame, value: str, mask: Column) -> DataFrame:
    """df with ``_m`` and ``_v``: mean and sample variance of a value where the mask holds."""
    kept = F.when(mask, F.col(value))
    return df.crossJoin(F.broadcast(df.agg(F.avg(kept).alias("_m"), F.var_samp(kept).alias("_v"))))


def _block(factor: float) -> int:
    """Steps in which powers of a factor stay within doubles."""
    return 128 if factor == 1 else max(2, min(128, int(200 / abs(log10(factor)))))


def _scan(gamma: float, factor: float, reward: str, value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows by ``_g``, the last step of a group first: ``_a``, the advantage over the steps of the same task, and ``_k``, their count before it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, place, advantage, after = None, 0, 0.0, 0.0  # of the row before
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column("_g").to_numpy()
            r, v = b.column(reward), b.column(value)
            known = pc.and_(r.is_valid(), v.is_valid()).to_numpy(zero_copy_only=False)
            r, v = (x.cast(pa.float64()).fill_null(0.0).to_numpy() for x in (r, v))
            new = np.append(group is None or g[0] != group, g[1:] != g[:-1])
            at = np.arange(n)
            k = at - np.maximum.accumulate(np.where(new, at, -place - 1))
            a = np.where(known, r + gamma * np.where(new, 0.0, np.append(after, v[:-1])) - v, 0.0)
            if not new[0]:
                a[0] += factor * advantage
            # after a round with s each row holds the sum over 2 * s steps
            reach, s, power = np.minimum(k, at), 1, factor
            while s <= reach.max():
                a = np.append(a[:s], a[s:] + np.where(reach[s:] >= s, power * a[:-s], 0.0))
                s, power = 2 * s, power * power
            group, place, advantage, after = g[-1], k[-1], a[-1], v[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k), pa.array(a)], names=[*b.schema.names, "_k", "_a"])

    return scan


def _carries(d: DataFrame, known: Column, value: Column, gamma: float, factor: float) -> DataFrame:
    """``_c`` for each ``_g`` and ``_part`` of a group over several tasks: what the steps behind the task's add to its first row's advantage.

    A row k places on gets factor ** k of it. Tasks hold ranges, so these are fewer than two rows for each task.
    """
    runs = d.groupBy("_g", "_part").agg(F.max("_k").alias("n"), F.max_by("_a", "_k").alias("a"), F.max_by(value, "_k").alias("v"), F.min_by(known, "_k").alias("known"))
    # as many as there are tasks at most
    runs = runs.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_part", "n", "a", "v", "known"))).alias("_runs")).filter(F.size("_runs") > 1)

    def carry(ahead: Column, run: Column) -> Column:
        return F.when(run["known"], gamma * ahead["v"]).otherwise(0.0) + factor * ahead["a"]

    def step(ahead: Column, run: Column) -> Column:
        c = carry(ahead, run)
        return F.struct(_carried(run["a"], c, factor, run["n"]).alias("a"), F.coalesce(run["v"], F.lit(0.0)).alias("v"), F.concat(ahead["out"], F.array(F.struct(run["_part"].alias("_part"), c.alias("_c")))).alias("out"))

    none = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("v"), F.array().cast("array<struct<_part:int,_c:double>>").alias("out"))
    return runs.select("_g", F.inline(F.aggregate("_runs", none, step, lambda x: x["out"])))


def _carried(own: Column, carry: Column, factor: float, k: Column) -> Column:
    # a power that is infinite must not meet a carry of 0
    return F.when(F.coalesce(carry, F.lit(0.0)) == 0, own).otherwise(own + F.pow(F.lit(factor), k.cast("double")) * carry)


def gae(df: DataFrame, group: str, order: list[str], reward: str, value: str, gamma: float, lam: float) -> DataFrame:
    """``advantage`` and ``returns`` of each step by the backward recursion A(t) = d(t) + gamma * lam * A(t + 1).

    Longer groups are dealt out once, by ranges of their steps from the last on, scanned by each task and
    written; what the steps behind a task's add to its own is one number for each group in it, which a
    broadcast brings. Groups of at most one block are summed where they stand. A null reward or value counts 0.
    """
    g = gamma * lam
    if g < 0:
        raise ValueError("gamma and lam are not negative")
    names = [*df.columns, "advantage", "returns"]

    def delta(after: Column) -> Column:
        return F.coalesce(F.col(reward) + gamma * F.coalesce(after, F.lit(0.0)) - F.col(value), F.lit(0.0))

    def done(d: DataFrame) -> DataFrame:
        return d.withColumn("returns", F.col("advantage") + F.col(value)).select(*names)

    size = _block(g) if g else GROUP_ROWS
    w = Window.partitionBy(group).orderBy(*order)

    def short(d: DataFrame) -> DataFrame:
        d = d.withColumns({"_t": F.row_number().over(w) - 1, "_d": delta(F.lead(value).over(w))})
        if g == 0:
            return done(d.withColumn("advantage", F.col("_d")))
        power = F.pow(F.lit(g), F.col("_t").cast("double"))
        # the frame is summed anew for each row, but has one block of rows at most and needs no other sort
        ahead = w.rowsBetween(0, Window.unboundedFollowing)
        return done(d.withColumn("advantage", F.sum(F.col("_d") * power).over(ahead) / power))

    long = crowded(df, [group], size)
    if long is None:
        return short(df)
    long = store(long.select(group, F.monotonically_increasing_id().alias("_g")), "numbered")
    back = ["_g", *[F.desc(c) for c in order]]
    d = join_safe(df, long, [group]).repartitionByRange(*back).sortWithinPartitions(*back).withColumn("_part", F.spark_partition_id())
    scanned = StructType([*d.schema.fields, StructField("_k", LongType()), StructField("_a", DoubleType())])
    d = store(d.mapInArrow(_scan(gamma, g, reward, value), scanned), "scanned")
    known = F.col(reward).isNotNull() & F.col(value).isNotNull()
    d = d.join(F.broadcast(_carries(d, known, F.col(value).cast("double"), gamma, g)), ["_g", "_part"], "left")
    d = d.withColumn("advantage", _carried(F.col("_a"), F.col("_c"), g, F.col("_k")))
    return done(d).unionByName(short(join_safe(df, long.select(group), [group], "left_anti")))


def rank_align(df: DataFrame, batch: str, left: str, right: str, most: int = GROUP_ROWS) -> DataFrame:
    """Within a batch the left values and the right values, each sorted, side by side, with their ``rank`` from 1.

    Batches of more than ``most`` rows are sorted by ranges over many tasks, ties dealt out by the rows'
    hash, and both sides meet by their rank in the whole batch. A null batch is a batch.
    """
    # zero for negative zero: engines order the two zeros apart
    d = tied(df).select(batch, (F.col(left) + 0.0).alias(left), (F.col(right) + 0.0).alias(right), "_tie")

    def ranked(d: DataFrame, side: str, spread: bool) -> DataFrame:
        if spread:
            return places(d.select(batch, side, "_tie"), [batch], [side, "_tie"], place="rank").select(batch, side, (F.col("rank") + 1).cast("int").alias("rank"))
        return d.select(batch, side, F.row_number().over(Window.partitionBy(batch).orderBy(side)).alias("rank"))

    def aligned(d: DataFrame, spread: bool) -> DataFrame:
        return join_safe(ranked(d, left, spread), ranked(d, right, spread), [batch, "rank"])

    long = crowded(df, [batch], most)
    if long is None:
        return aligned(d, False).select(batch, "rank", left, right)
    long = long.select(batch)
    out = aligned(join_safe(d, long, [batch], "left_semi"), True).unionByName(aligned(join_safe(d, long, [batch], "left_anti"), False))
    return out.select(batch, "rank", left, right)


def running_sums(df: DataFrame, by: list[str], order: str, size: str, width: int = 4096, most: int = GROUP_ROWS) -> DataFrame:
    """df with ``before``: the sum of ``size`` over the rows of its group before it in an order of any values, nulls first.

    Rows equal in the order stand in the order of their hash. Groups of more than ``most`` rows are cut
    into spans of ``width`` rows, however sparse the order's values are; a null group is a group.
    """
    d = tied(df)
    w = Window.partitionBy(*by).orderBy(order, "_tie").rowsBetween(Window.unboundedPreceding, -1)

    def short(d: DataFrame) -> DataFrame:
        return d.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))

    def spread(d: DataFrame) -> DataFrame:
        return running_totals(places(d, by, [order, "_tie"], place="_place"), by, "_place", {"before": F.col(size)}, width).drop("_place")

    if not by:
        return spread(d).drop("_tie")
    long = crowded(df, by, most)
    if long is None:
        return short(d).drop("_tie")
    long = long.select(*by)
    out = spread(join_safe(d, long, by, "left_semi")).unionByName(short(join_safe(d, long, by, "left_anti")))
    return out.drop("_tie")


def pack_wrapped(df: DataFrame, shard: str, order: str, size: str, limit: int) -> DataFrame:
    """Sequences laid end to end within a shard and cut at every ``limit``: first and last pack of each; a null size is 0."""
    d = running_sums(df, [shard], order, size).withColumnRenamed("before", "start")
    last = F.col("start") + F.coalesce(size, F.lit(0)) - 1
    d = d.withColumn("first_pack", F.floor(F.col("start") / limit).cast("long"))
    return d.withColumn("last_pack", F.floor(F.greatest(last, F.col("start")) / limit).cast("long"))


def plan_best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[size]`` sequences of each size up to the limit, by runs of equal packs.

    Each step (size, rank, n, pack, each) puts the n sequences of a size from a rank on into packs from
    a number on, ``each`` of them into one. A sequence goes into the fullest pack that holds it, of
    equally full ones the first. A pack that takes a sequence of one size takes more of them until it
    can't, so steps are counted by sizes and not by sequences.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # what is left -> runs (first pack, count) in order
    rooms: list[int] = []
    steps, packs = [], 0

    def add(left: int, first: int, count: int) -> None:
        if left not in room:
            room[left] = []
            insort(rooms, left)
        insort(room[left], (first, count))

    for size in sorted(counts, reverse=True):
        rank, more = 0, counts[size]
        while more:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = limit // size if size else more
                steps.append((size, rank, more, packs, each))
                full, rest = divmod(more, each)
                if full:
                    add(limit - each * size, packs, full)
                if rest:
                    add(limit - rest * size, packs + full, 1)
                packs, more = packs + full + (rest > 0), 0
                break
            left = rooms[at]
            each = left // size if size else more
            first, count = room[left].pop(0)
            if not room[left]:
                del room[left], rooms[at]
            n = min(more, count * each)
            steps.append((size, rank, n, first, each))
            full, rest = divmod(n, each)
            if full:
                add(left - each * size, first, full)
            if rest:
                add(left - rest * size, first + full, 1)
            if (spare := count - full - (rest > 0)) > 0:
                add(left, first + full + (rest > 0), spare)
            rank, more = rank + n, more - n
    return steps


def pack_best_fit(df: DataFrame, key: str, size: str, limit: int, width: int = 4096) -> DataFrame:
    """Best-fit decreasing over the whole table: each sequence into the fullest pack that still holds it.

    Sequences go by falling size and then by key. A sequence longer than the limit is cut to it, a null
    size is 0: ``kept`` is what of it is packed. The packing is planned on the counts of sizes alone
    (limit + 1 at most); rows get their pack by their rank among those of their size.
    """
    kept = F.least(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)), F.lit(limit)).cast("long")
    d = tied(df.select(key, size).withColumn("kept", kept))
    counts = {r["kept"]: r["count"] for r in d.groupBy("kept").count().collect()}
    steps = df.sparkSession.createDataFrame(plan_best_fit(counts, limit) or [(0, 0, 0, 0, 1)], "_kept long, _rank long, _n long, _first long, _each long")
    # steps by spans of ranks, so that a size with many rows and steps meets by span
    spans = F.sequence(F.floor(F.col("_rank") / width), F.floor((F.col("_rank") + F.greatest("_n", F.lit(1)) - 1) / width))
    steps = steps.withColumn("_span", F.explode(spans))
    d = places(d, ["kept"], [key, "_tie"], place="_place").withColumn("_at", F.floor(F.col("_place") / width))
    on = (F.col("_place") >= F.col("_rank")) & (F.col("_place") < F.col("_rank") + F.col("_n"))
    d = d.join(steps, (F.col("kept") == F.col("_kept")) & (F.col("_at") == F.col("_span")) & on)
    pack = F.col("_first") + F.floor((F.col("_place") - F.col("_rank")) / F.col("_each"))
    return d.select(key, size, "kept", pack.cast("long").alias("pack"))


def positions(df: DataFrame, order: str, width: int = 4096) -> DataFrame:
    """df with ``position``: the place of each row from 0 in an order of any values, nulls first, equal ones by their hash."""
    return places(tied(df), [], [order, "_tie"], place="position").drop("_tie")


def zip_rows(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Columns of rows at the same position side by side; a's rows beyond b's end have nulls."""
    right = positions(b, order_b).drop(order_b) if order_b in a.columns else positions(b, order_b)
    return positions(a, order_a).join(right, "position", "left")


def add_column(df: DataFrame, order: str, name: str, values: DataFrame, values_order: str, value: str) -> DataFrame:
    """df with a column whose values stand at the same positions in another table."""
    return zip_rows(df, values.select(F.col(values_order).alias("_o"), F.col(value).alias(name)), order, "_o").drop("position", "_o")


def hash_rank(df: DataFrame, key: Column, ties: list[str], digits: int = 3) -> DataFrame:
    """df with ``rank`` from 0 and the table's ``total``, in the order of a hexadecimal hash and then of the ties.

    Rows are parted by the first digits of the hash, which are even, so the order of the whole table
    needs no task that holds it.
    """
    d = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, digits))
    parts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most 16 ** digits rows
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_key", *ties)) - 1
    return d.withColumn("_within", within).join(F.broadcast(parts), "_part").withColumn("rank", F.col("_before") + F.col("_within")).drop("_key", "_part", "_before", "_within")


def running_delta(df: DataFrame, batch: str, reward: Column, name: str = "delta") -> DataFrame:
    """df with the mean of a reward over its own batch and all batches before it, in the order of ``batch`` (nulls first).

    Batches are reduced to sums and counts, which are scanned in the order of the batches over blocks of
    them and come back to the rows by batch; a null reward counts for nothing, no reward gives 0.
    """
    sums = df.groupBy(batch).agg(F.coalesce(F.sum(reward), F.lit(0.0)).alias("_sum"), F.count(reward).alias("_n"))
    scanned = running_totals(places(sums, [], [batch], place="_place"), [], "_place", {"_all": F.col("_sum"), "_rows": F.col("_n")}, inclusive=True)
    means = scanned.select(batch, F.when(F.col("_rows") > 0, F.col("_all") / F.col("_rows")).otherwise(0.0).alias(name))
    return join_safe(df, means, [batch])


def tile(rank: Column, total: Column, tiles: int) -> Column:
    """The tile from 1 of a rank, the first tiles one larger where the total can't be shared evenly."""
    small, more = F.floor(total / tiles), total % tiles
    cut = more * (small + 1)
    return F.when(rank < cut, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - cut) / F.greatest(small, F.lit(1)))).cast("int") + 1


def exact_quantile(df: DataFrame, column: str, share: float, margin: float = 5e-4) -> DataFrame:
    """One row ``cut``: the interpolated quantile of a column of doubles; null if it has no value.

    A mergeable sketch brackets the quantile within ``margin`` of the ranks on both sides (all values where
    that is few rows); what is below is counted and only what is within is sorted, by ranges of its values.
    """
    v = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    # the sketch errs by a rank of 10,000 at most, a fifth of the margin
    ends = [max(share - margin, 0.0), min(share + margin, 1.0)]
    seen = v.agg(F.percentile_approx("v", ends, F.lit(10_000)).alias("p"), F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))
    side = lambda k, whole: F.when(F.col("n") * margin < 20, F.col(whole)).otherwise(F.get("p", F.lit(k)))
    seen = seen.select(side(0, "least").alias("lo"), side(1, "most").alias("hi"), "n", (F.lit(share) * (F.col("n") - 1)).alias("rank"))
    v = v.crossJoin(F.broadcast(seen))
    below = v.filter("v < lo").agg(F.count(F.lit(1)).alias("below"))
    near = v.filter("v >= lo and v <= hi").groupBy("v", "rank").agg(F.count(F.lit(1)).alias("c"))
    near = running_totals(places(near, [], ["v"], place="_p"), [], "_p", {"until": F.col("c")}, inclusive=True).crossJoin(F.broadcast(below))
    until = F.col("until") + F.col("below")
    holds = lambda r: F.min(F.when(until > r, F.col("v")))
    low, high = holds(F.floor("rank")), holds(F.ceil("rank"))
    part = F.max(F.col("rank") - F.floor("rank"))
    return near.agg((low + (high - low) * part).alias("cut"))
