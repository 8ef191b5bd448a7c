"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints are compared within blocks of their bits. Two fingerprints that differ in at most
``threshold`` bits differ in at most ``threshold // blocks`` bits of one block, so each block is
covered by the codewords of a linear code (the anchors; covering radius R): a fingerprint is at
home with the one nearest anchor of its block and is sent to every anchor within R plus the
block's share of the threshold. At each anchor the residents are compared with all arrivals over
all 64 bits. No link is lost: a resident is within R of its anchor, its partner therefore within R
plus the share. An anchor with many rows is dealt out as a grid of cells, residents by arrivals, so
a task holds a bounded number of rows however many fingerprints an anchor has.

Equal fingerprints are merged first, so groups of equal copies of any size are one row. Anchors
give a spanning forest of their links, not all pairs; an alternating large-star small-star
iteration joins the forests. The code grows with the count of distinct fingerprints, so that an
anchor's residents stay few; every code finds all links, so the groups are the same.

Defined cases: a null or blank text has fingerprint zero; a null id takes part and can't name a
group; repeated rows and equal ids share a fingerprint's group; a bit that is set in just half of the
hashes is not set in the fingerprint; very long texts take time in proportion to their length;
further columns are ignored (``keep_one`` keeps them), whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm._shared import discard, materialize, sendable

SEED = 42
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Generator polynomial of the binary Golay code of length 23 (a fixed value).
GOLAY = 0b101011100011
#: Rows on each side of a cell of an anchor.
CELL_ROWS = 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, with repeats."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)),
        np.uint64,
        len(w) - shingle + 1,
    )
    n = len(hashes)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        set_bits += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, detail: bool = False) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a signed long) of each row; ``detail``: also ``h``, a hash of the text."""

    @F.pandas_udf(T.LongType())
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(x, shingle) for x in text), np.uint64, len(text)).view(np.int64))

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), *([F.xxhash64(text).alias("h")] if detail else []), fp(text).alias("fp"))


class Component:
    """A linear code whose parity checks are the columns ``checks``; length = len(checks)."""

    def __init__(self, checks: list[int], reach: int):
        self.n, self.checks = len(checks), np.array(checks, np.int64)
        # error patterns of each syndrome, by weight
        self.patterns: list[dict[int, np.ndarray]] = []
        found: dict[tuple[int, int], list[int]] = {}
        for weight in range(min(reach, self.n) + 1):
            for bits in combinations(range(self.n), weight):
                s = e = 0
                for b in bits:
                    s ^= checks[b]
                    e |= 1 << b
                found.setdefault((s, weight), []).append(e)
        for s in range(1 << max(checks).bit_length()):
            self.patterns.append({w: np.array(found[s, w], np.int64) for w in range(reach + 1) if (s, w) in found})

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.int64)
        for b in range(self.n):
            s ^= np.where((x >> b) & 1 == 1, self.checks[b], 0)
        return s


def _golay_checks() -> list[int]:
    out = []
    for k in range(23):
        r = 1 << k
        for b in range(r.bit_length() - 1, 10, -1):
            if r >> b & 1:
                r ^= GOLAY << (b - 11)
        out.append(r)
    return out


#: Codes with their counts of anchors in a block. All of them lose no link; of more anchors each has fewer residents.
CODES = {"golay": 1 << 12, "wide": 1 << 18, "double": 1 << 24, "long": 1 << 27, "free": 1 << 32}
#: Fingerprints of an anchor, on average, from which the next code serves.
RESIDENTS = 1024


def code_for(fingerprints: int) -> str:
    """The code with the fewest anchors whose residents are still few, whatever the count of fingerprints."""
    return next((k for k, anchors in CODES.items() if fingerprints <= RESIDENTS * anchors), "free")


@cache
def block_code(kind: str, share: int) -> tuple[list[Component], int]:
    """Components of a block's code and the reach R + share.

    golay: 23 bits, R 3, 4,096 anchors. wide: 32 bits as Golay, a Hamming code of 7 bits (R 1) and
    two free bits (R 0), R 4, 262,144 anchors. double: 32 bits as two Hamming codes of 15 bits and two
    free bits, R 2, 2 ** 24 anchors. long: a Hamming code of 31 bits and a free bit, R 1, 2 ** 27 anchors.
    free: 32 free bits, R 0, 2 ** 32 anchors.
    """
    checks, radius = {
        "golay": ([_golay_checks()], 3),
        "wide": ([_golay_checks(), list(range(1, 8)), [0, 0]], 4),
        "double": ([list(range(1, 16)), list(range(1, 16)), [0, 0]], 2),
        "long": ([list(range(1, 32)), [0]], 1),
        "free": ([[0] * 32], 0),
    }[kind]
    reach = radius + share
    return [Component(c, reach) for c in checks], reach


def anchors_of(x: np.ndarray, kind: str, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, weight) of all anchors within reach of each block value."""
    parts, reach = block_code(kind, share)
    rows, err, weight = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    shift = 0
    for p in parts:
        s = p.syndrome((x >> shift) & ((1 << p.n) - 1))[rows]
        out = []
        for w in range(reach + 1):
            can = np.flatnonzero(weight + w <= reach)
            if not len(can):
                continue
            counts = np.array([len(q.get(w, ())) for q in p.patterns])
            flat = np.concatenate([q.get(w, np.zeros(0, np.int64)) for q in p.patterns] or [np.zeros(0, np.int64)])
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            n = counts[s[can]]
            if not n.sum():
                continue
            which = np.repeat(can, n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((rows[which], err[which] | flat[first[s[which]] + nth] << shift, weight[which] + w))
        rows, err, weight = (np.concatenate(z) for z in zip(*out, strict=True))
        shift += p.n
    return rows, x[rows] ^ err, weight


def spread(fp: np.ndarray, kind: str, threshold: int, blocks: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, at home) rows of the fingerprints, for all their blocks."""
    share = threshold // blocks
    bits = sum(p.n for p in block_code(kind, share)[0])
    u = fp.view(np.uint64)
    out = []
    for b in range(blocks):
        x = ((u >> np.uint64(b * (64 // blocks))) & np.uint64((1 << bits) - 1)).astype(np.int64)
        rows, anchor, weight = anchors_of(x, kind, share)
        order = np.lexsort((anchor, weight, rows))
        rows, anchor = rows[order], anchor[order]
        home = np.ones(len(rows), bool)
        home[1:] = rows[1:] != rows[:-1]
        out.append((anchor * blocks + b, fp[rows], home))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def forest(fp: np.ndarray, home: np.ndarray, threshold: int, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller one) that span the links of the residents of one cell."""
    order = np.argsort(fp, kind="stable")
    fp, home = fp[order], home[order]
    u, residents = fp.view(np.uint64), np.flatnonzero(home)
    parent = np.arange(len(fp))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return int(k)

    size = max(1, step // max(1, len(fp)))
    for k in range(0, len(residents), size):
        some = residents[k : k + size]
        i, j = np.nonzero(np.bitwise_count(u[some][:, None] ^ u[None, :]) <= threshold)
        i = some[i]
        apart = i != j
        a, b = parent[i[apart]], parent[j[apart]]
        new = a != b
        if not new.any():
            continue
        pairs = np.unique(np.minimum(a, b)[new] * len(fp) + np.maximum(a, b)[new])
        for x, y in zip((pairs // len(fp)).tolist(), (pairs % len(fp)).tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    child = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[child], fp[parent[child]]


def cells(near: DataFrame, cell_rows: int, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """Rows (``key``, the named columns, ``home``): each anchor's residents and arrivals in a grid of cells.

    Every resident meets every arrival of its anchor in one cell of about ``cell_rows`` rows a side.
    The counts of crowded anchors are sent if they are few, else joined.
    """
    sizes = near.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("m"))
    sizes = sizes.filter(F.col("n") > cell_rows).select("anchor", *[F.ceil(F.col(c) / cell_rows).alias(k) for c, k in (("m", "_r"), ("n", "_a"))])
    one = F.lit(1).cast("long")
    d = near.join(sendable(sizes), "anchor", "left").withColumns({"_r": F.greatest(F.coalesce("_r", one), one), "_a": F.coalesce("_a", one)})
    at = F.pmod(F.xxhash64(*names), F.col("_r"))
    col = F.pmod(F.xxhash64(*names, F.lit(1)), F.col("_a"))
    zero = F.lit(0).cast("long")
    as_resident = F.transform(F.sequence(zero, F.col("_a") - 1), lambda j: F.struct((at * F.col("_a") + j).alias("cell"), F.lit(True).alias("home")))
    as_arrival = F.transform(F.sequence(zero, F.col("_r") - 1), lambda i: F.struct((i * F.col("_a") + col).alias("cell"), F.lit(False).alias("home")))
    # where an anchor has one cell, a resident's row is its own arrival
    places = F.when(~F.col("home"), as_arrival).when(F.col("_a") == 1, as_resident).otherwise(F.concat(as_resident, as_arrival))
    d = d.select("anchor", *names, F.explode(places).alias("p"))
    # should two cells' hashes be equal, their rows are compared together, which loses nothing
    return d.select(F.xxhash64("anchor", "p.cell").alias("key"), *names, F.col("p.home").alias("home"))


def anchor_links(nodes: DataFrame, threshold: int = 3, kind: str = "golay", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (``u``, ``v``) that connect all fingerprints ``fp`` within the threshold."""

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for k in range(0, len(fp), 4096):
                yield pd.DataFrame(dict(zip(("anchor", "fp", "home"), spread(fp[k : k + 4096], kind, threshold), strict=True)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pd.DataFrame:
            cuts = np.flatnonzero(np.diff(key)) + 1
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if b - a > 1 and home[a:b].any():
                    u, v = forest(fp[a:b], home[a:b], threshold)
                    us.append(u)
                    vs.append(v)
            return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not len(batch):
                continue
            now = (batch["key"].to_numpy(), batch["fp"].to_numpy(np.int64), batch["home"].to_numpy(bool))
            last = np.searchsorted(now[0], now[0][-1])  # rows are sorted by key
            if now[0][0] == now[0][-1] and held and held[-1][0][0] == now[0][0]:
                held.append(now)
                continue
            done = tuple(np.concatenate(x) for x in zip(*held, tuple(x[:last] for x in now), strict=True))
            held = [tuple(x[last:] for x in now)]
            if len(done[0]):
                yield links(*done)
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = materialize(nodes.select("fp").mapInPandas(replicate, "anchor long, fp long, home boolean"), "anchors")
    near = cells(anchors, cell_rows).repartition(parts, "key").sortWithinPartitions("key")
    out = materialize(near.mapInPandas(compare, "u long, v long").distinct(), "links")
    discard(nodes.sparkSession, anchors)
    return out


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(``u``, ``root``) of every linked u that isn't its component's smallest; links are (u, v).

    Large-star and small-star rounds until each u has one neighbour and that is a root.
    """
    spark = links.sparkSession
    e = materialize(links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(limit):
        if is_stars(e):
            out = e.select("u", F.col("v").alias("root"))
            out.stored_at = e.stored_at
            return out
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(spark, old)
    raise RuntimeError("components did not converge")


def is_stars(e: DataFrame) -> bool:
    """Whether no u has two neighbours and no neighbour has one itself."""
    # a node's rows: how often it stands left, whether it stands right
    seen = e.select(F.col("u").alias("x"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(e.select("v", F.lit(0), F.lit(1)))
    bad = seen.groupBy("x").agg(F.sum("l").alias("l"), F.max("r").alias("r")).filter((F.col("l") > 1) | (F.col("l") * F.col("r") > 0))
    return bad.limit(1).count() == 0


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    threshold: int = 3,
    kind: str | None = None,
    cell_rows: int = CELL_ROWS,
    detail: bool = False,
) -> DataFrame:
    """``id``, ``fp``, ``component`` (the smallest id of the linked group) of each row.

    ``kind``: the code (None: as the count of distinct fingerprints asks for); the groups are the same.
    ``detail``: also ``h`` (a hash of the row's text as it stands) and ``grp`` (equal in a group).
    """
    spark = docs.sparkSession
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, detail), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    links = anchor_links(nodes, threshold, kind or code_for(nodes.count()), cell_rows)
    comp = components(links)
    discard(spark, links)
    roots = comp.select(F.col("root").alias("fp"), "root").distinct()
    member = materialize(comp.select(F.col("u").alias("fp"), "root").union(roots).join(nodes, "fp"), "members")
    named = member.select("fp", "root").join(member.groupBy("root").agg(F.min("rep").alias("least")), "root")
    label = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component"), F.coalesce("root", "fp").alias("grp"))
    out = fps.join(label, "fp", "left")
    return out.select("id", "fp", "component", *(["h", "grp"] if detail else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouping: Callable[..., DataFrame] = simhash_groups, **how) -> DataFrame:
    """docs with one row of each group; ``grouping`` gives ``id``, ``h``, ``component`` and ``grp`` of each row.

    Of a group the row with the smallest id stays, a row without id only where no other has one; of
    several texts of that id in the group, that with the least hash; of rows equal in both, one.
    """
    spark = docs.sparkSession
    g = materialize(grouping(docs, id_col, text_col, detail=True, **how).select("id", "h", "grp"), "groups")
    first = g.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "h")).alias("r")).select("r.id", "r.h")
    first = materialize(first, "first")
    # an id of one row is decided by the id alone
    times = g.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    several = materialize(times.filter("id is not null and n > 1").select("id"), "several")
    gone = materialize(times.filter("id is not null and n = 1").select("id").join(first, "id", "left_anti"), "gone")
    without = not g.filter("id is null").isEmpty()
    discard(spark, g)
    by_id = F.col(id_col) == F.col("_id")
    out = docs.join(sendable(gone.withColumnRenamed("id", "_id")), by_id, "left_anti")
    if several.isEmpty() and not without:
        return out
    several = sendable(several.withColumnRenamed("id", "_id"))
    clear = out.filter(F.col(id_col).isNotNull()).join(several, by_id, "left_anti")
    rest = docs.filter(F.col(id_col).isNull()).unionByName(docs.join(several, by_id, "left_semi"))
    rest = rest.withColumn("_h", F.xxhash64(F.col(text_col).cast("string")))
    chosen = first.select(F.col("id").alias("_id"), F.col("h").alias("_k"))
    rest = rest.join(chosen, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")), "left_semi")
    return clear.unionByName(rest.dropDuplicates([id_col, "_h"]).select(*docs.columns))
