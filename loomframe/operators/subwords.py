"""Subword tokens: byte pairs merged in the order of a public vocabulary's ranks, and back to text.

Texts are cut into pieces by the vocabulary's pattern in the JVM; a task merges each distinct piece that
it meets once and looks others up, so encoding needs no shuffle. The vocabulary is a file of lines
``base64(token) rank``; its path is a setting (``spark.loomframe.vocabulary``) or an argument, and it is
read by Spark. Vocabularies are not trained here.

A null text has no tokens; decoding gives back every text that was encoded, byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.loomframe.vocabulary"
#: Where the setting is absent.
VOCABULARY = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens that are sent to all executors at most; a larger vocabulary is an error.
MOST_TOKENS = 1_000_000
#: Pieces that a task remembers at most.
REMEMBERED = 200_000
#: Pieces whose tokens a task lays out at once; a row of more is laid out alone.
HELD = 1 << 17
#: Bytes of a piece up to which all its pairs are looked through for each merge.
SHORT = 128
NEVER = 1 << 60
#: White space of Unicode.
SPACE = r"\t-\r\x{85}\p{Z}"
#: How the public vocabulary cuts texts before merging (fixed values).
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
RUNS = rf" ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
PATTERN = rf"{CONTRACTIONS}|{RUNS}|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``token`` (bytes) and ``id`` (its rank) of a vocabulary file."""
    lines = spark.read.text(path or spark.conf.get(SETTING, VOCABULARY)).filter("value <> ''")
    parts = F.split("value", " ")
    return lines.select(F.unbase64(F.get(parts, F.lit(0))).alias("token"), F.get(parts, F.lit(1)).cast("int").alias("id"))


def pieces(text: Column) -> Column:
    """The pieces within which tokens are merged; together they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of all neighbours the pair of least rank becomes one, the leftmost first, until none has a rank."""
    n = len(piece)
    if n > SHORT:
        return _merged_long(piece, ranks)
    cuts = list(range(n + 1))
    pairs = [ranks.get(piece[i : i + 2], NEVER) for i in range(n - 1)]
    while pairs and (least := min(pairs)) != NEVER:
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], NEVER)
        if i:
            pairs[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], NEVER)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs, for pieces of many bytes."""
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
    pairs = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(pairs)
    while pairs:
        rank, i = heappop(pairs)
        # the pair may be gone: then what stands there now has another rank
        middle = ends[i]
        if middle < 0 or middle >= n or ranks.get(piece[i : ends[middle]]) != rank:
            continue
        ends[i], ends[middle] = ends[middle], -1
        if ends[i] < n:
            before[ends[i]] = i
            if (r := ranks.get(piece[i : ends[ends[i]]])) is not None:
                heappush(pairs, (r, i))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left : ends[i]])) is not None:
            heappush(pairs, (r, left))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def laid_out(texts: pa.ListArray, of: Callable[[str], list[int]]) -> Iterator[pa.ListArray]:
    """The ids of rows of pieces, some rows after others: what is held grows with ``HELD`` and the longest row, not with the batch."""
    bounds, a = texts.offsets.to_numpy(), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + HELD, "right")) - 1)
        rows = texts.slice(a, b - a)
        # each distinct piece of these rows is merged or looked up once, then ids are laid out by places
        coded = rows.flatten().dictionary_encode()
        tokens_of = [of(p) for p in coded.dictionary.to_pylist()]
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.array([len(t) for t in tokens_of], dtype=np.int64)
        pool = np.array([i for t in tokens_of for i in t], dtype=np.int32)
        begins, n = np.cumsum(counts) - counts, counts[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(ends[-1]) + np.repeat(begins[which] - ends[:-1], n)
        yield pa.ListArray.from_arrays(pa.array(ends[bounds[a : b + 1] - bounds[a]], pa.int32()), pa.array(pool[at]))
        a = b


_sent: dict[tuple[str, int], Broadcast] = {}


def encoder(tokens: DataFrame):
    """A column function from texts to arrays of token ids. A vocabulary is read and sent once in an application."""
    context = tokens.sparkSession.sparkContext
    known_as = (context.applicationId, tokens.semanticHash())
    if (ranks := _sent.get(known_as)) is None:
        rows = tokens.limit(MOST_TOKENS + 1).collect()
        if len(rows) > MOST_TOKENS:
            raise ValueError(f"a vocabulary has {MOST_TOKENS} tokens at most")
        ranks = _sent[known_as] = context.broadcast({bytes(r["token"]): r["id"] for r in rows})

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[int]] = {}

        def of(piece: str) -> list[int]:
            if (found := known.get(piece)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[piece] = merged(piece.encode(), ranks.value)
            return found

        for texts in batches:
            yield from laid_out(texts, of)

    return lambda text: ids(pieces(text))


def decoded(df: DataFrame, keys: list[str], ids: str, tokens: DataFrame, name: str = "decoded") -> DataFrame:
    """The keys of each row and the text of its ids; a row whose ids aren't all known has null."""
    at = df.select(*keys, F.posexplode(ids).alias("_pos", "id")).join(F.broadcast(tokens), "id", "left")
    whole = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "token"))).alias("_t"))
    text = F.decode(F.aggregate("_t", F.lit(b""), lambda done, x: F.concat(done, x["token"])), "UTF-8")
    kept = df.select(*keys, F.size(ids).alias("_n"))
    return kept.join(whole, keys, "left").select(*keys, F.when(F.col("_n") > 0, text).otherwise("").alias(name))
