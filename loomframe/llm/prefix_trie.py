"""Prefix trie of conversations and sums over its subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns, named by running sums of the turns' digests (with their
places), so names are prefix sums and a conversation of any length spans many tasks. Each node's
heavy child is that with most conversations; a light child has at most half its parent's, so a path
from the root has log2(conversations) light nodes at most. A heavy path ends at a childless node and
is named by that node's smallest conversation, whose turns hold the whole path and tell where it
begins and how many light nodes are above it (its round).

The rounds run from the most light nodes to none: along each path's arrays (blocks of ``BLOCK`` nodes)
values are summed from the bottom up, and the sum at a path's top is attached to the node that it
hangs from, which belongs to the next round.

Defined cases: a null role or text is empty; turns in one place are ordered by role and text before
they come here; a conversation without turns ends at the root; ids are distinct and not null (others
are left out, as a node is named by an id); very long texts are hashed whole; an empty table has no
root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm._shared import materialize, words
from loomframe.operators.ordering import running_totals

#: Nodes of a path in one array.
BLOCK = 1024
#: 32 bits of a digest each; sums of them stay exact over 2 ** 31 turns.
LANES = 6
#: Nodes with more than this part of all rows are few enough to be sent to all executors.
COMMON = 20_000
#: Ids that are hashed together.
CHUNK = 4096


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", depth.cast("string"), *[x.cast("string") for x in lanes])))


def _root() -> Column:
    return _key(F.lit(0), [F.lit(0)] * LANES)


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn (``conv``, ``place`` dense from 0, ``role``, ``text``) as the node that its conversation reaches by it.

    ``conv``, ``depth`` from 1, ``key``, ``up`` (the key of the node before) and ``words`` of the turn; written.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.sha2(F.concat_ws("|", F.col("place").cast("string"), F.octet_length(role).cast("string"), F.concat(role, text)), 256)
    d = turns.select("conv", "place", F.size(words(text)).cast("long").alias("words"), own.alias("own"))
    lanes = [f"l{k}" for k in range(LANES)]
    d = d.withColumns({x: F.conv(F.substring("own", 8 * k + 1, 8), 16, 10).cast("long") for k, x in enumerate(lanes)})
    d = materialize(d.drop("own"), "turns")
    d = running_totals(d, ["conv"], "place", {"b" + x: F.col(x) for x in lanes})
    before = [F.col("b" + x) for x in lanes]
    d = d.select("conv", (F.col("place") + 1).alias("depth"), _key(F.col("place") + 1, [F.col("b" + x) + F.col(x) for x in lanes]).alias("key"), _key(F.col("place"), before).alias("up"), "words")
    return materialize(d, "prefixes")


def _with_common(df: DataFrame, on: str, nodes: DataFrame, common: Column, columns: list[str]) -> DataFrame:
    """df with columns of the node that ``on`` names; common nodes are sent, so that none of them crowds a task.

    Of all pairs of a conversation and one of its nodes a common node has more than a COMMON-th, so
    fewer than COMMON nodes are common.
    """
    side = nodes.select(F.col("key").alias("_key"), common.alias("_common"), *[F.col(c).alias("_" + c) for c in columns])
    sent = df.join(F.broadcast(side.filter("_common")), F.col(on) == F.col("_key"), "left")
    found = sent.filter("_key is not null")
    others = sent.filter("_key is null").select(*df.columns).join(side.filter("not _common"), F.col(on) == F.col("_key"), "left")
    return found.unionByName(others).select(*df.columns, *[F.col("_" + c).alias(c + "_of") for c in columns])


def trie_nodes(members: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a node: ``key``, ``up``, ``depth``, ``conv`` (least member), ``n_convs``, ``words``, ``n_children``, ``heavy``, ``common``; written."""
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv")).filter("n_convs > 0")
    root = root.select(_root().alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), "conv", "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = rows.groupBy("key").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = materialize(root.unionByName(nodes), "nodes")
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    # siblings share no conversation, so the least of each tells equal ones apart
    most = F.max_by("key", F.struct("n_convs", -F.col("conv")))
    children = nodes.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"), most.alias("chosen"))
    heavy = children.select(F.col("chosen").alias("key"), F.lit(True).alias("heavy"))
    out = nodes.join(children.drop("chosen"), "key", "left").join(heavy, "key", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "heavy": F.coalesce("heavy", F.lit(False))})
    return materialize(out.withColumn("common", F.col("n_convs") * COMMON > total), "nodes")


def heavy_paths(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Each node on its heavy path: ``path`` (a conversation), ``key``, ``depth``, ``place`` from the path's top, ``round``; written."""
    ends = nodes.filter("n_children = 0").select("conv", F.col("depth").alias("bottom"))
    along = rows.select("conv", "depth", "key").join(ends, "conv")
    light = nodes.filter("not heavy and depth > 0")
    tops = _with_common(along, "key", light, F.col("common"), ["depth"]).filter("depth_of is not null").groupBy("conv").agg(F.max("depth").alias("top"), F.count(F.lit(1)).alias("round"))
    # the path of the root has no light node
    paths = ends.join(tops, "conv", "left").select("conv", F.coalesce("top", F.lit(0).cast("long")).alias("top"), F.coalesce("round", F.lit(0).cast("long")).alias("round"))
    on = rows.select("conv", "depth", "key").join(paths, "conv").filter("depth >= top")
    first = paths.filter("round = 0").select("conv", F.lit(0).cast("long").alias("depth"), _root().alias("key"), "top", "round")
    out = on.unionByName(first, allowMissingColumns=True)
    return materialize(out.select(F.col("conv").alias("path"), "key", (F.col("depth") - F.col("top")).alias("place"), F.col("round")), "paths")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _suffix_sums(values: pd.Series) -> pd.Series:
    """Arrays of value lists, one a node, summed from the last node to each."""

    def summed(rows: np.ndarray) -> list[np.ndarray]:
        return list(np.cumsum(np.stack(rows)[::-1], axis=0)[::-1])

    return values.map(summed)


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``key`` and for each value (whole numbers) its sum over the node's subtree; one written table a round."""
    names = list(values)
    own = nodes.select("key", "up", F.array(*[c.cast("long") for c in values.values()]).alias("own"))
    placed = materialize(paths.join(own, "key").withColumn("block", F.floor(F.col("place") / BLOCK)), "placed")
    rounds = [r["round"] for r in placed.select("round").distinct().orderBy(F.desc("round")).collect()]  # log2(conversations) at most
    hanging, done = None, []
    for k in rounds:
        at = placed.filter(F.col("round") == k)
        if hanging is not None:
            at = at.join(hanging, "key", "left").withColumn("own", F.when(F.col("hung").isNull(), F.col("own")).otherwise(F.zip_with("own", "hung", lambda x, y: x + y)))
        arrays = at.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("place", "key", "up", "own"))).alias("nodes"))
        arrays = materialize(arrays.withColumn("sums", _suffix_sums(F.transform("nodes", lambda x: x["own"]))), "path-sums")
        below = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        later = arrays.select("path", "block", *[F.get(F.get("sums", F.lit(0)), F.lit(j)).alias(f"s{j}") for j in range(len(names))])
        later = later.select("path", "block", F.array(*[F.coalesce(F.sum(f"s{j}").over(below), F.lit(0)) for j in range(len(names))]).alias("later"))
        out = arrays.join(later, ["path", "block"]).select("later", F.explode(F.arrays_zip("nodes", "sums")).alias("x"))
        out = out.select("x.nodes.key", "x.nodes.up", "x.nodes.place", F.zip_with("x.sums", "later", lambda x, y: x + y).alias("sum"))
        done.append(out.select("key", "sum"))
        tops = out.filter("place = 0 and up is not null").select("up", *[F.get("sum", F.lit(j)).alias(f"s{j}") for j in range(len(names))])
        hanging = tops.groupBy(F.col("up").alias("key")).agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(len(names))])
        hanging = hanging.select("key", F.array(*[f"s{j}" for j in range(len(names))]).alias("hung"))
    if not done:
        return nodes.select("key", *[c.cast("long").alias(n) for n, c in values.items()])
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("key", *[F.get("sum", F.lit(j)).alias(n) for j, n in enumerate(names)])


def ends_digests(members: DataFrame, rows: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256``: SHA-256 of the ascending ids of the conversations that end at a node, joined by commas.

    Ids are joined in chunks over ranges of (node, id), and one task reads a node's chunks as a stream,
    so no crowd of equal conversations has to fit in memory.
    """
    last = rows.groupBy("conv").agg(F.max_by("key", "depth").alias("key"))
    ends = members.join(last, "conv", "left").select("conv", F.coalesce("key", _root()).alias("key"))
    ends = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = (b.groupby("key", sort=False).cumcount() // CHUNK).rename("part")
            g = b.assign(part=part, s=b["conv"].astype(str)).groupby(["key", "part"], sort=False)
            yield g.agg(first=("conv", "first"), ids=("s", ",".join)).reset_index().drop(columns="part")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for b in batches:
            out = []
            for k, ids in zip(b["key"], b["ids"], strict=True):
                if k != key:
                    if h is not None:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if h is not None:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends_sha256"])

    joined = ends.mapInPandas(chunks, "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInPandas(digests, "key binary, ends_sha256 string")


def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node of the trie of conversations.

    members: ``conv`` (whole numbers, distinct); turns: ``conv``, ``place`` dense from 0, ``role``, ``text``.
    Returns ``conv`` (least member), ``depth``, ``parent_conv``, ``n_convs``, ``n_children``, ``n_leaves`` (childless
    nodes below or at it), ``saved_tokens`` (words that members after the first repeat, over its
    subtree) and ``ends_sha256`` of the members that end there.
    """
    rows = prefixes(turns)
    nodes = trie_nodes(members, rows)
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}
    sums = subtree_sums(nodes, heavy_paths(nodes, rows), values)
    out = _with_common(nodes, "up", nodes, F.col("common"), ["conv"])
    out = out.join(sums, "key").join(ends_digests(members, rows), "key", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv", "depth", F.col("conv_of").alias("parent_conv"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
