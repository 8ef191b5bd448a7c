"""Ordered operators over groups of any size: nulls, sparse orders, ties, one group that holds all."""

import random
from bisect import bisect_left, insort

import pytest
from pyspark.sql import functions as F

from loomframe.operators import sequences as S


def plain_best_fit(rows, limit):
    """rows (key, size) -> {key: pack}, one sequence after the other."""
    room, out, n = [], {}, 0
    for key, size in sorted(rows, key=lambda x: (-min(x[1] or 0, limit), x[0])):
        need = min(size or 0, limit)
        k = bisect_left(room, (need, -1))
        if k == len(room):
            left, pack, n = limit - need, n, n + 1
        else:
            left, pack = room.pop(k)
            left -= need
        insort(room, (left, pack))
        out[key] = pack
    return out


@pytest.mark.parametrize("limit, sizes", [(10, range(0, 14)), (100, range(1, 130)), (7, [7]), (64, [1]), (97, [3, 30, 31, 48, 49, 50, None]), (5, [0, 0, 5])])
def test_best_fit_plan(limit, sizes):
    r = random.Random(limit)
    for n in (0, 1, 5, 60, 700):
        rows = [(k, r.choice(list(sizes))) for k in range(n)]
        counts, ranks, packs = {}, {}, {}
        for k, size in sorted(rows):
            size = min(size or 0, limit)
            ranks[k] = size, counts.get(size, 0)
            counts[size] = counts.get(size, 0) + 1
        for size, rank, m, first, each in S.plan_best_fit(counts, limit):
            packs |= {(size, rank + j): first + j // each for j in range(m)}
        assert {k: packs[at] for k, at in ranks.items()} == plain_best_fit(rows, limit)


def test_best_fit_rows(spark):
    r = random.Random(3)
    rows = [(k, r.choice([None, 0, 5, 20_000, *range(90, 4000, 37)])) for k in range(3000)] + [(5000 + k, 8192) for k in range(2500)]
    out = S.pack_best_fit(spark.createDataFrame(rows, "k long, n long").repartition(9), "k", "n", 8192, width=64).collect()
    assert {x.k: x.pack for x in out} == plain_best_fit(rows, 8192) and len(out) == len(rows)
    full = {}
    for x in out:
        assert x.kept == min(x.n or 0, 8192)
        full[x.pack] = full.get(x.pack, 0) + x.kept
    assert max(full.values()) <= 8192
    assert S.pack_best_fit(spark.createDataFrame([], "k long, n long"), "k", "n", 9).collect() == []


def test_nulls_and_sparse_orders(spark):
    rows = [(k * 1_000_003, "s", 3) for k in range(400)] + [(None, "s", 5), (1, None, 2), (2, None, None), (None, None, 7)]
    df = spark.createDataFrame(rows, "k long, s string, n long").repartition(5)
    for most in (10, 10_000):
        got = S.running_sums(df, ["s"], "k", "n", width=16, most=most).collect()
        assert len(got) == len(rows)
        assert {(x.s, x.k): x.before for x in got} == {("s", None): 0, **{("s", k * 1_000_003): 5 + 3 * k for k in range(400)}, (None, None): 0, (None, 1): 7, (None, 2): 9}
    packs = S.pack_wrapped(spark.createDataFrame([(1, None, 3), (2, None, 4), (3, "a", 5), (4, "a", None)], "k long, s string, n long"), "s", "k", "n", 4).collect()
    assert sorted((x.k, x.start, x.first_pack, x.last_pack) for x in packs) == [(1, 0, 0, 0), (2, 3, 0, 1), (3, 0, 0, 1), (4, 5, 1, 1)]
    at = S.positions(df.select("k"), "k").collect()
    assert sorted(x.position for x in at) == list(range(len(rows))) and {x.position for x in at if x.k is None} == {0, 1}
    both = S.zip_rows(df.select("k"), spark.createDataFrame([(None, "x"), (9, "y")], "o long, v string"), "k", "o").collect()
    assert len(both) == len(rows) and {x.position: x.v for x in both if x.v} == {0: "x", 1: "y"}


def test_rank_align_one_batch(spark):
    r = random.Random(4)
    rows = [(0, r.choice([0.0, -0.0, 1.5, r.random()]), float(r.randrange(3))) for _ in range(4000)] + [(None, 2.0, 1.0), (None, 1.0, 3.0), (7, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "b long, x double, y double").repartition(6)
    for most in (100, 10_000):
        got = S.rank_align(df, "b", "x", "y", most=most).collect()
        for b in (0, None, 7):
            own = [x for x in rows if x[0] == b]
            want = list(zip(range(1, len(own) + 1), sorted(x[1] + 0.0 for x in own), sorted(x[2] for x in own)))
            assert sorted((x["rank"], x.x, x.y) for x in got if x.b == b) == want


def test_rank_align_tasks_are_even(spark):
    """Values with three distinct ones: ranges of (value, hash) hold about as many rows each."""
    df = spark.range(40_000).select(F.lit(0).alias("b"), (F.col("id") % 3).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    d = S.tied(df).repartitionByRange(8, "b", "x", "_tie").groupBy(F.spark_partition_id()).count().collect()
    assert max(x["count"] for x in d) < 2 * 40_000 / 8


def test_scatter_is_not_quadratic(spark):
    import time

    from loomframe.functions import tokens as K

    df = spark.createDataFrame([([1, 0, 1, 1, None], [5.0, 6.0]), ([], [1.0]), ([0, 0], []), ([1], [7.0, 8.0])], "m array<int>, v array<double>")
    assert [x[0] for x in df.select(K.scatter(F.col("m"), F.col("v"), -1.0)).collect()] == [[5.0, -1.0, 6.0, None, -1.0], [], [-1.0, -1.0], [7.0]]
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda x: (x % 3 == 0).cast("int")).alias("m"), F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda x: x * 1.0).alias("v"))
    began = time.perf_counter()
    out = long.select(K.scatter(F.col("m"), F.col("v"))).first()[0]
    assert time.perf_counter() - began < 60 and [x for x in out if x] == [float(k) for k in range(1, 33_334)]
