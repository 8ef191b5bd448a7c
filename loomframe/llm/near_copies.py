"""Groups of near copies: candidates by SimHash anchors and by bands of min-hashes, checked by shingle similarity.

Fingerprints of three-word shingles within three bits are linked by the anchors of covering codes
(``simhash.anchor_links``); texts of one fingerprint are linked to the least of them, linked fingerprints
by theirs. Fingerprints reach the closest copies only, and a link stands for others that it joins, so
bands find what the anchors leave.

A text is the set of its runs of five words. Under a random order of all shingles two sets share
their smallest with the probability of their similarity (Jaccard), whatever their sizes. A band is
the hash of ``ROWS`` such least shingles, and each text goes to the buckets of its ``BANDS`` bands.
Texts with a similarity of 0.8 miss each other in all of them in 3 cases of 100,000, more similar ones
less often, long texts no more often than short ones, and tables of every size are treated alike.

Texts that an anchor links or that meet in a bucket are candidates. They are checked by exact similarity in rounds:

1. Each text is checked along its anchors' links and against the least one of each of its buckets. That
   is linear in the texts, and joins most groups; those that pass are united.
2. Buckets of three or more texts that still hold several groups are crowded: by families of which
   no text is in the middle, or by a passage that many texts share and that makes much of them, but
   not 0.8. Their texts meet again by prefix: the shingles of a set are put in order, those first that
   few of these texts hold, and two sets of 0.8 or more share one of the first (all but as many as both
   must share, plus one). Texts that are joined by such shingles, directly or through others, make a
   family. A family is dealt out as a grid of cells of bounded size, each of which holds two parts of
   its sets; a cell checks its candidates, the likeliest first, until each pair has been checked, can't
   reach 0.8 (where the first shared shingle stands bounds what is shared beyond it) or is in one
   group by others. It gives only the links that join groups, so what is written grows with the texts.

So a failed check parts no two similar texts, and neither which text a bucket begins with nor how a
family is cut changes anything. A text with many links has its set copied, so that no task holds all
of them.

Fewer words than a shingle has are one shingle; A-Z are lower-cased; texts of equal words are one
node, so groups of equal copies of any size are one row.

Defined cases: null and blank texts equal each other; a null id takes part and can't name a group;
repeated rows and equal ids share the group of their text; of equally likely candidates any may be checked first,
which changes no group; very long texts take time and memory in proportion to their length; further
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm._shared import discard, materialize, sendable
from loomframe.llm.simhash import LOWER, SEED, anchor_links, code_for, components, fingerprint

#: A-Z in lower case, white space as a space.
PLAIN = bytes(32 if chr(x) in " \t\n\v\f\r" else x for x in LOWER)

BANDS, ROWS = 20, 4
#: Odd multipliers of the 64-bit finaliser of SplitMix (fixed values).
STEP, MIX1, MIX2 = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
#: Pairs that a cell compares at once and remembers, links by which a node's set is copied once more, shingles that are hashed at once.
HELD, KNOWN_PAIRS, LINKS_A_COPY, CHUNK = 1 << 21, 1 << 20, 512, 1 << 12
#: Shingles of a family's part, candidates of a text that a cell checks before all others, sets that hold a rare shingle at most.
CELL_SIZE, FIRST, RARE = 1 << 18, 8, 64
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 16


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * MIX1
    z = (z ^ (z >> np.uint64(27))) * MIX2
    return z ^ (z >> np.uint64(31))


#: A random number for each byte, and the powers of an odd number and of its inverse modulo 2 ** 64.
BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * STEP)
BASE = int(MIX1)
POWERS, INVERSES = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, x, np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64)))
#: One random order of the shingles for each row of each band.
ORDERS = (_mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * MIX2) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
SHIFTS = (_mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * MIX1) >> np.uint64(32)).astype(np.uint32)[:, None]


class Words:
    """A text's words, A-Z lower-cased and parted by one space each: the bytes, and where each word begins and ends."""

    def __init__(self, text: str | None):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(PLAIN), np.uint8)
        space = raw == 32
        keep = ~space
        keep[1:] |= ~space[:-1]  # the first space after a word
        self.bytes = raw[keep]
        space = np.concatenate([[True], space[keep], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]

    def name(self) -> int:
        """A hash of the words, as a signed long."""
        end = int(self.ends[-1]) if len(self.ends) else 0
        return int(np.array(xxhash.xxh64_intdigest(self.bytes[:end], SEED), np.uint64).view(np.int64))

    def shingles(self, width: int) -> np.ndarray:
        """Sorted distinct hashes of the runs of ``width`` words; of all words if they are fewer."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.uint64)
        width = min(width, n)
        start, end = self.starts[: n - width + 1], self.ends[width - 1 :]
        # a run's hash is that of a polynomial in its bytes: a difference of sums up to its ends
        sums = np.zeros(len(self.bytes) + 1, np.uint64) if len(self.bytes) <= BLOCK else None
        if sums is not None:
            np.cumsum(BYTES[self.bytes] * POWERS[: len(self.bytes)], out=sums[1:])
            out = (sums[end] - sums[start]) * INVERSES[start]
        else:
            out = self._long(start, end)
        out = np.sort(_mix(out))
        return out[np.concatenate([[True], out[1:] != out[:-1]])]

    def _long(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same, block by block."""
        low, high, back = (np.zeros(len(start), np.uint64) for _ in range(3))
        carry, power, inverse = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
        for k in range(0, len(self.bytes) + 1, BLOCK):
            part = self.bytes[k : k + BLOCK]
            sums = np.concatenate([carry, carry + np.cumsum(BYTES[part] * (POWERS[: len(part)] * power))])
            a, z = np.searchsorted(start, [k, k + BLOCK])
            low[a:z] = sums[start[a:z] - k]
            back[a:z] = INVERSES[start[a:z] - k] * inverse
            a, z = np.searchsorted(end, [k, k + BLOCK])
            high[a:z] = sums[end[a:z] - k]
            carry, power, inverse = sums[-1:], power * POWERS[BLOCK], inverse * INVERSES[BLOCK]
        return (high - low) * back


def bands(s: np.ndarray) -> np.ndarray:
    """The band hashes of a set, as signed longs; the empty set has none."""
    if not len(s):
        return np.zeros(0, np.int64)
    s = s.astype(np.uint32)
    least = np.full(len(ORDERS), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(s), CHUNK):
        np.minimum(least, ((s[k : k + CHUNK] ^ SHIFTS) * ORDERS).min(1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = _mix(out * STEP + row)
    return out.view(np.int64)


def cell_links(n: np.ndarray, group: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (of ``n``) that join the groups of a cell's similar sets. sets: shingles in the common order; side: 0 or 1.

    Rows of side 0 are compared with those of side 1, or, if there are none, with each other.
    """
    none = np.zeros(0, np.int64)
    size = np.array([len(x) for x in sets], np.int64)
    if len(n) < 2:
        return none, none
    parent = np.unique(group, return_inverse=True)[1]
    parent = np.array([np.flatnonzero(parent == g)[0] for g in range(parent.max() + 1)])[parent]
    inorder = [np.sort(x) for x in sets]
    us: list[int] = []
    vs: list[int] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return int(k)

    def check(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a == b:
            return
        x, y = inorder[i], inorder[j]
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        if both >= similarity * (len(x) + len(y) - both) - 1e-9:
            parent[max(a, b)] = min(a, b)
            us.append(i)
            vs.append(j)

    kept = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    row = np.repeat(np.arange(len(n)), kept)
    place = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
    token = np.concatenate([x[:k] for x, k in zip(sets, kept.tolist(), strict=True)])
    order = np.lexsort((place, token))
    token, row, left = token[order], row[order], (size[row] - place)[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(token)]])
    share, two = similarity / (1 + similarity), bool(side.any())
    tested: set[int] = set()
    for most in (FIRST, len(n)):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            rows, rest = row[a:b], left[a:b]
            step = max(1, HELD // (b - a))
            for k in range(0, b - a, step):
                some = rows[k : k + step]
                while not (parent[parent] == parent).all():
                    parent = parent[parent]
                spare = np.minimum(rest[k : k + step][:, None], rest[None, :]) - share * (size[some][:, None] + size[rows][None, :])
                ok = (spare >= -1e-6) & (parent[some][:, None] != parent[rows][None, :])
                ok &= (side[some][:, None] < side[rows][None, :]) if two else (some[:, None] < rows[None, :])
                i, j = np.nonzero(ok)
                likely = np.lexsort((-spare[i, j], i))
                i, j = i[likely], j[likely]
                near = np.arange(len(i)) - np.searchsorted(i, i) < most
                for x, y in zip(some[i[near]].tolist(), rows[j[near]].tolist(), strict=True):
                    if x * len(n) + y not in tested:
                        if len(tested) >= KNOWN_PAIRS:  # then some are checked again
                            tested.clear()
                        tested.add(x * len(n) + y)
                        check(x, y)
    return n[us], n[vs]


def meetings(nodes: DataFrame) -> DataFrame:
    """``key``, ``n`` of the nodes in each bucket of two or more, with its least node ``v`` and its ``size``."""
    placed = nodes.select(F.explode("bands").alias("key"), "n")
    least = placed.groupBy("key").agg(F.min("n").alias("v"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return placed.join(least, "key").select("key", "n", "v", "size")


def anchored(nodes: DataFrame) -> DataFrame:
    """Pairs (``u``, ``v``) of nodes that the anchors link: equal fingerprints as a star, linked ones by their least nodes."""
    firsts = nodes.groupBy("fp").agg(F.min("n").alias("v"), F.count(F.lit(1)).alias("size"))
    firsts = materialize(firsts, "firsts")
    links = anchor_links(firsts.select("fp"), kind=code_for(firsts.count()))
    shared = sendable(firsts.filter("size > 1").select("fp", "v"))
    equal = nodes.select("n", "fp").join(shared, "fp").filter("n != v").select(F.col("n").alias("u"), "v")
    ends = links
    for end in "uv":
        ends = ends.join(firsts.select(F.col("fp").alias(end), F.col("v").alias("_" + end)), end)
    across = ends.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v"))
    out = materialize(equal.unionByName(across), "anchored")
    discard(nodes.sparkSession, firsts, links)
    return out


def crowded_links(sets: DataFrame, similarity: float, cell_size: int = CELL_SIZE) -> DataFrame:
    """Links (``u``, ``v``) that join similar sets of different groups. sets: ``family``, ``n``, ``grp``, ``shingles`` in the common order.

    A family is cut into parts of about ``cell_size`` shingles; each two parts meet in one cell.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(b: pd.DataFrame) -> pd.DataFrame:
            u, v = cell_links(b["n"].to_numpy(), b["grp"].to_numpy(), list(b["shingles"]), b["side"].to_numpy(), similarity)
            return pd.DataFrame({"u": u, "v": v})

        held: list[pd.DataFrame] = []
        for batch in batches:
            key = batch["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1]["key"].iloc[0] != key[a]:
                    yield links(pd.concat(held))
                    held = []
                held.append(batch.iloc[a:b])
        if held:
            yield links(pd.concat(held))

    zero = F.lit(0).cast("long")
    totals = sets.groupBy("family").agg(F.ceil(F.sum(F.size("shingles")) / cell_size).alias("parts"))
    # few families have several parts
    parts = sendable(materialize(totals.filter("parts > 1"), "parts"))
    d = sets.join(parts, "family", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    d = d.withColumn("part", F.pmod(F.xxhash64("n"), F.col("parts")))
    # the cell (i, j) holds part i as side 0 and part j as side 1; (i, i) holds a part once
    cell = lambda i, j, side: F.struct((i * F.col("parts") + j).alias("cell"), F.lit(side).alias("side"))
    first = F.transform(F.sequence(F.col("part"), F.col("parts") - 1), lambda j: cell(F.col("part"), j, 0))
    second = F.when(F.col("part") > 0, F.transform(F.sequence(zero, F.greatest(F.col("part") - 1, zero)), lambda i: cell(i, F.col("part"), 1)))
    d = d.select("family", "n", "grp", "shingles", F.explode(F.concat(first, F.coalesce(second, F.array().cast("array<struct<cell:bigint,side:int>>")))).alias("p"))
    d = d.select(F.xxhash64("family", "p.cell").alias("key"), "n", "grp", "shingles", F.col("p.side").alias("side"))
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(n, "key").sortWithinPartitions("key").mapInPandas(compare, "u long, v long").distinct()


def sets_of(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``n`` and ``shingles`` of the wanted nodes. texts: ``id``, ``text``; nodes: ``n``, ``name``, ``rep``; wanted: ``n``."""
    ends = materialize(wanted.join(nodes.select("n", "name", F.col("rep").alias("id")), "n"), "wanted")

    @F.pandas_udf("name long, shingles array<long>")
    def described(text: pd.Series) -> pd.DataFrame:
        words = [Words(t) for t in text]
        return pd.DataFrame([(w.name(), w.shingles(shingle).view(np.int64)) for w in words], columns=["name", "shingles"])

    # else the filter of its name would be pushed below the choice of rows, which are few
    described = described.asNondeterministic()
    rows = texts.join(sendable(ends.select("id").distinct()), "id", "left_semi")
    if not ends.filter("id is null").isEmpty():
        rows = rows.unionByName(texts.filter("id is null"))
    sets = rows.select("id", described("text").alias("d")).select("id", "d.*")
    sets = sets.join(ends, sets["id"].eqNullSafe(ends["id"]) & (sets["name"] == ends["name"])).select("n", "shingles")
    out = materialize(sets.dropDuplicates(["n"]), "shingles")
    discard(out.sparkSession, ends)
    return out


def similar_links(sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """The links whose texts are similar. sets: ``n``, ``shingles``; links: ``u``, ``v``."""
    ends = links.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.ceil(F.count(F.lit(1)) / LINKS_A_COPY).alias("copies"))
    # few nodes have many links: a copy of their set for every so many, so that no task holds all of them
    many = sendable(materialize(ends.filter("copies > 1"), "many"))
    e = links
    for end, other in ("uv", "vu"):
        e = e.join(many.select(F.col("n").alias(end), F.col("copies").alias("_c")), end, "left")
        e = e.withColumn("c" + end, F.pmod(F.xxhash64(other), F.coalesce("_c", F.lit(1)))).drop("_c")
    copied = sets.join(many, "n", "left").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), "shingles")
    e = e.join(copied.select(F.col("n").alias("u"), F.col("copy").alias("cu"), F.col("shingles").alias("a")), ["u", "cu"])
    e = e.join(copied.select(F.col("n").alias("v"), F.col("copy").alias("cv"), F.col("shingles").alias("b")), ["v", "cv"])
    both = F.size(F.array_intersect("a", "b"))
    return materialize(e.filter(both >= F.lit(similarity) * (F.size("a") + F.size("b") - both)).select("u", "v"), "similar")


def ordered(sets: DataFrame) -> DataFrame:
    """``n`` and ``shingles``, those before that few sets hold."""
    each = sets.select("n", F.explode("shingles").alias("key"))
    # shingles of few sets need no order among them but any; the others are few themselves
    common = sendable(materialize(each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > RARE), "common"))
    each = each.join(common, "key", "left").select("n", F.struct(F.coalesce("c", F.lit(0)).alias("c"), "key").alias("s"))
    inorder = each.groupBy("n").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return inorder.select("n", F.transform("s", lambda x: x["key"]).alias("shingles"))


def families(sets: DataFrame, similarity: float) -> DataFrame:
    """``n`` and ``family`` of the sets that share a shingle of their prefixes with one of another group, directly or through others.

    sets: ``n``, ``grp``, ``shingles`` in the common order.
    """
    spark = sets.sparkSession
    size = F.size("shingles")
    first = F.slice("shingles", F.lit(1), size - F.ceil(F.lit(similarity) * size - 1e-9).cast("int") + 1)
    placed = materialize(sets.select("n", "grp", F.explode(first).alias("key")), "prefixes")
    keys = placed.groupBy("key").agg(F.min("n").alias("v"), F.min("grp").alias("_a"), F.max("grp").alias("_b")).filter("_a != _b").select("key", "v")
    links = materialize(placed.join(sendable(materialize(keys, "keys")), "key").select(F.col("n").alias("u"), "v").distinct(), "members")
    comp = components(links)
    member = links.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    out = materialize(member.join(comp.withColumnRenamed("u", "n"), "n", "left").select("n", F.coalesce("root", "n").alias("family")), "families")
    discard(spark, placed, links, comp)
    return out


def grouped(placed: DataFrame, comp: DataFrame) -> DataFrame:
    """placed with ``grp``: the root of each node, itself if it has no links."""
    joined = placed.drop("grp").join(comp.withColumnRenamed("u", "n"), "n", "left")
    return joined.withColumn("grp", F.coalesce("root", "n")).drop("root")


def of_several_groups(placed: DataFrame, comp: DataFrame) -> DataFrame:
    """``key``, ``n`` with ``grp``, without the keys whose nodes are all of one group."""
    now = grouped(placed, comp)
    keys = now.groupBy("key").agg(F.min("grp").alias("_a"), F.max("grp").alias("_b")).filter("_a != _b").select("key")
    return now.join(sendable(materialize(keys, "keys")), "key", "left_semi")


def checked_links(texts: DataFrame, nodes: DataFrame, similarity: float, shingle: int, cell_size: int = CELL_SIZE) -> DataFrame:
    """(``u``, ``root``) of the groups that the similar pairs of nodes form."""
    spark = nodes.sparkSession
    met = materialize(meetings(nodes), "met")
    # in the first round each text is checked along its anchors' links and against the least of its buckets
    near = anchored(nodes)
    tested = materialize(met.filter("n != v").select(F.col("n").alias("u"), "v").unionByName(near).distinct(), "pairs")
    discard(spark, near)
    sets = sets_of(texts, nodes, tested.select(F.explode(F.array("u", "v")).alias("n")).distinct(), shingle)
    passed = similar_links(sets, tested, similarity)
    comp = components(passed)
    # buckets of two texts are done with
    crowded = of_several_groups(met.filter("size > 2").select("key", "n"), comp).select("n").distinct()
    some = materialize(sets.join(crowded, "n", "left_semi"), "crowded")
    discard(spark, met, sets)
    inorder = materialize(grouped(ordered(some), comp), "ordered")
    member = families(inorder, similarity)
    more = materialize(crowded_links(inorder.join(member, "n"), similarity, cell_size), "links")
    out = components(passed.unionByName(more))
    discard(spark, tested, passed, comp, some, inorder, member, more)
    return out


def near_copy_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    cell_size: int = CELL_SIZE,
    detail: bool = False,
) -> DataFrame:
    """``id``, ``component`` (the smallest id of the group) of each row.

    ``detail``: also ``h`` (a hash of the row's text as it stands) and ``grp`` (equal in a group).
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))

    @F.pandas_udf("name long, fp long, bands array<long>")
    def described(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            w = Words(t)
            s = w.shingles(shingle)
            rows.append((w.name(), int(np.uint64(fingerprint(t)).view(np.int64)), bands(s)))
        return pd.DataFrame(rows, columns=["name", "fp", "bands"])

    described_rows = texts.select("id", F.xxhash64("text").alias("h"), described("text").alias("d")).select("id", "h", "d.*")
    rows = materialize(described_rows, "fingerprints")
    nodes = rows.groupBy("name", "fp").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    # once written, a node keeps its number
    nodes = materialize(nodes.withColumn("n", F.monotonically_increasing_id()), "nodes")
    comp = checked_links(texts, nodes, similarity, shingle, cell_size)
    slim = nodes.select("n", "name", "fp", "rep")
    member = grouped(slim, comp)
    label = member.groupBy("grp").agg(F.min("rep").alias("component"))
    label = member.select("grp", "name", "fp").join(label, "grp")
    out = rows.select("id", "h", "name", "fp").join(label, ["name", "fp"])
    return out.select("id", "component", *(["h", "grp"] if detail else []))
