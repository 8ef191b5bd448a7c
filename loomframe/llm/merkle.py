"""Merkle manifest of a dataset: trees of digests over groups of rows, proofs, verification.

A row's leaf is the SHA-256 of its fields, each written with its length. Within a group leaves stand in
the order of an id; every ``fan_out`` consecutive nodes (the last run may be shorter) are hashed into
one until one is left, the group's root; the groups' roots, in the order of the groups, likewise give
the manifest's root.

The build goes bottom up: each level is one grouping by run and is written with the digests of its
runs. Proofs go top down: a level's nodes join the runs that they belong to, and each puts its
siblings before the proof that it inherits. No node is ever with more than ``fan_out`` others in one
row, and a group of any size spans as many tasks as its rows need.

Defined cases: a null field differs from an empty one; a null group is a group, the first; a null id
comes first; of rows with equal ids the lesser leaf is first, and rows equal in all fields take
neighbouring places; very long texts are hashed whole; further columns are carried as they are,
whatever their names; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm._shared import materialize
from loomframe.operators.ordering import join_safe, places

FAN_OUT = 16
DIGEST = 32
PATH = "array<struct<at:bigint,others:binary>>"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of fields, each as its UTF-8 byte count, a colon and its value, or - if it is null."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


@dataclass
class Manifest:
    """``leaves``: row, group, place and digest; ``levels`` and ``top``: the written runs, from the leaves up; ``roots``: one row a group."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]
    fan_out: int

    @property
    def root(self) -> DataFrame:
        """At most one row: the digest of the whole."""
        return _tops([self.roots.withColumn("group", F.lit(0)), *self.top]).select("digest")


def _levels(nodes: DataFrame, fan_out: int) -> list[DataFrame]:
    """The runs above some nodes (group, place, total, digest), level by level, until each group has one node."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels = []
    while most > 1:
        own = F.struct("place", "digest")
        runs = nodes.filter("total > 1").groupBy("group", F.floor(F.col("place") / fan_out).alias("above"))
        runs = runs.agg(F.max("total").alias("total"), F.array_sort(F.collect_list(own)).alias("children"))
        run = F.aggregate("children", F.lit(b""), lambda done, x: F.concat(done, x["digest"]))
        runs = runs.select("group", F.col("above").alias("place"), F.ceil(F.col("total") / fan_out).alias("total"), run.alias("run"))
        nodes = materialize(runs.withColumn("digest", F.unhex(F.sha2(as_hex(F.col("run")), 256))), "level")
        levels.append(nodes)
        most = -(-most // fan_out)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The node of each group that is alone on its level."""
    out = None
    for nodes in levels:
        alone = nodes.filter("total = 1").select("group", "digest")
        out = alone if out is None else out.unionByName(alone)
    return out


def build(df: DataFrame, fields: list[str], group: str, order: str, carry: list[str] | None = None, fan_out: int = FAN_OUT) -> Manifest:
    """The manifest of a table: leaves over ``fields``, a tree for each ``group`` in the order of ``order`` and one over them."""
    carry = df.columns if carry is None else carry
    rows = df.select(
        F.struct(*[F.col(c) for c in carry]).alias("row"),
        F.col(group).alias("group"),
        F.col(order).alias("_order"),
        F.unhex(leaf_digest([F.col(c) for c in fields])).alias("digest"),
    )
    rows = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    leaves = places(rows, ["group"], ["_order", "digest", "_tie"], total="total", keep=materialize)
    leaves = materialize(leaves.select("row", "group", "place", "total", "digest"), "leaves")
    nodes = leaves.select("group", "place", "total", "digest")
    levels = _levels(nodes, fan_out)
    roots = places(_tops([nodes, *levels]), [], ["group"], total="total", keep=materialize)
    roots = materialize(roots.select("group", "place", "total", "digest"), "roots")
    top = _levels(roots.withColumn("group", F.lit(0)), fan_out)
    return Manifest(leaves, levels, roots, top, fan_out)


def _sibling(run: Column, place: Column, fan_out: int) -> Column:
    """The digests of a node's run but its own, and where it stands among them."""
    at = F.pmod(place, F.lit(fan_out))
    others = F.concat(F.substring(run, F.lit(1), (at * DIGEST).cast("int")), F.substring(run, (at * DIGEST + DIGEST + 1).cast("int"), F.lit(fan_out * DIGEST)))
    return F.struct(at.alias("at"), others.alias("others"))


def _push(nodes: DataFrame, above: DataFrame, fan_out: int) -> DataFrame:
    """Nodes that aren't alone with ``path``: their siblings before what their run inherits."""
    below = nodes.filter("total > 1").withColumn("_above", F.floor(F.col("place") / fan_out))
    above = above.withColumnRenamed("place", "_above").withColumnsRenamed({"path": "_path", "run": "_run"}).drop("total", "digest")
    d = join_safe(below, above, ["group", "_above"])
    step = _sibling(F.col("_run"), F.col("place"), fan_out)
    return d.withColumn("path", F.concat(F.array(step), F.col("_path"))).drop("_above", "_path", "_run")


def proofs(m: Manifest) -> DataFrame:
    """``row``, ``group``, ``place``, ``digest`` of each leaf, its ``subroot`` and ``root`` and its proof.

    ``path``: from the leaf up, for each run that is hashed the place in it (``at``) and the digests of
    the others in order (``others``, one after another).
    """
    nothing = F.array().cast(PATH)
    inherited = None
    for nodes in reversed([m.roots.withColumn("group", F.lit(0)), *m.top]):
        here = nodes.filter("total = 1").withColumns({"path": nothing, "root": F.col("digest")})
        if inherited is not None:
            here = here.unionByName(_push(nodes, inherited, m.fan_out), allowMissingColumns=True)
        inherited = here
    # a group's root by its place among the groups, so that the group's own name stands again
    ends = inherited.select("place", F.col("path").alias("_ends"), "root").join(m.roots.select("place", F.col("group"), F.col("digest").alias("subroot")), "place").drop("place")
    inherited = None
    for nodes in reversed([m.leaves, *m.levels]):
        alone = join_safe(nodes.filter("total = 1"), ends, ["group"]).withColumnRenamed("_ends", "path")
        inherited = alone if inherited is None else alone.unionByName(_push(nodes, inherited, m.fan_out))
    return inherited.drop("total")


def siblings(path: Column) -> Column:
    """All digests of a proof as one binary, from the leaf's siblings up."""
    return F.aggregate(path, F.lit(b""), lambda done, step: F.concat(done, step["others"]))


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and a proof lead to."""

    def up(node: Column, step: Column) -> Column:
        cut = (step["at"] * DIGEST).cast("int")
        before = F.substring(step["others"], F.lit(1), cut)
        after = F.substring(step["others"], cut + 1, F.octet_length(step["others"]))
        return F.sha2(F.concat(as_hex(before), node, as_hex(after)), 256)

    return F.aggregate(path, leaf, up)
