"""Benchmark decontamination: seeds join passages to items, Smith-Waterman scores them.

Two kinds of seeds serve, and between them they lose no alignment that reaches the threshold. Take
an alignment of an item of L words with m matches and x edits (a replaced, missing or foreign word
costs 1, a match gives 2), so its score is (2m - x) / 2L:

- if n matches stand in a row somewhere, text and item share an n-gram, the first kind of seed;
- if not, the matches are cut by edits into runs of n - 1 at most, so x >= m / (n - 1) - 1 and
  m >= (2 * threshold * L - 1) / (2 - 1 / (n - 1)). So of the item's words all but a few stand within
  3L - 2 * threshold * L words of the text, and so do most of its rare words (those that stand in the
  fewest items). A stretch that holds enough of these is the second kind of seed.

Around the seeds the item is aligned with the words; a stretch that shares too few words with the
item to reach the threshold is passed over before the alignment. The best score over that of the
whole item is the result. Items of fewer than ``exact_below`` words must occur word for word, those
of fewer than ``n`` words as a whole line.

Words are runs of word characters, lower-cased; in scripts without spaces each character is one.
The benchmark is taken in blocks of at most ``block_words`` words, each against all
documents in one pass; only a block is sent to the executors. Very long texts are taken in
overlapping pieces of ``PIECE`` words.

Defined cases: a null or blank text, and an item without words, match nothing; equal items each
match; words that stand in equally many items count as rare in the order of their first place;
repeated rows each give their matches; a null id stays null; an empty table gives an empty result;
further columns are ignored (``contamination``) or kept (``drop_contaminated``), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scripts that are written without spaces (Kana and Han).
UNSPACED = "぀-ヿ㐀-鿿豈-﫿"
ANY_UNSPACED, WORD, MIXED_WORD = re.compile(f"[{UNSPACED}]"), re.compile(r"\w+"), re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of a long text that are looked at together.
PIECE = 500_000
#: Share of an item's words, the rare ones, whose places in a text are followed.
RARE = 0.6


def tokens(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (MIXED_WORD if ANY_UNSPACED.search(text) else WORD).findall(text)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``count`` entries that begins at ``first``: the run's number and the entry."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


class Items:
    """A block of items with its seeds, small enough to send."""

    def __init__(self, items: list[tuple[str | None, list[str]]], n: int, threshold: float, exact_below: int):
        self.n = n
        #: items that count as whole lines only
        self.lines: dict[tuple[str, ...], list[str | None]] = {}
        for i, t in items:
            if 0 < len(t) < n:
                self.lines.setdefault(tuple(t), []).append(i)
        items = [(i, t) for i, t in items if len(t) >= n]
        self.ids = [i for i, _ in items]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, t in items for w in t}))}
        self.coded = [np.array([self.vocab[w] for w in t], np.int64) for _, t in items]
        self.size = np.array([len(x) for x in self.coded], np.int64)
        self.need = np.where(self.size < exact_below, 1.0, threshold)
        self.counts = [np.unique(x, return_counts=True) for x in self.coded]
        #: most words of a text that an alignment reaches over
        self.reach = np.floor(3 * self.size - 2 * self.need * self.size).astype(np.int64)
        self.gap = int(self.reach.max(initial=0)) + n
        grams = [self.hashes(x) for x in self.coded]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.key_first, self.key_count = first, np.diff(np.append(first, len(h)))
        self.seed_item = np.repeat(np.arange(len(items)), [len(g) for g in grams])[order]
        self.seed_place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])[order]
        self._rare(threshold, exact_below)

    def _rare(self, threshold: float, exact_below: int) -> None:
        """Rare words of each item, and how many of their places a text must hold within reach."""
        stands = np.zeros(len(self.vocab), np.int64)
        for words, _ in self.counts:
            stands[words] += 1
        self.least = np.zeros(len(self.coded), np.int64)
        word, item = [], []
        for k, x in enumerate(self.coded):
            if len(x) < exact_below:
                continue
            matched = ceil((2 * threshold * len(x) - 1) / (2 - 1 / (self.n - 1)) - 1e-9)
            missing = len(x) - max(matched, 1)
            rare = min(len(x), max(ceil(RARE * len(x)), missing + 2))
            self.least[k] = max(rare - missing, 1)
            words = np.unique(x[np.argsort(stands[x], kind="stable")[:rare]])
            word.append(words)
            item.append(np.full(len(words), k))
        words = np.concatenate([*word, np.zeros(0, np.int64)])
        order = np.argsort(words, kind="stable")
        self.word_item = np.concatenate([*item, np.zeros(0, np.int64)])[order]
        self.word_count = np.bincount(words, minlength=len(self.vocab))
        self.word_first = np.cumsum(self.word_count) - self.word_count

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """A hash for each n-gram of word numbers."""
        if len(x) < self.n:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(x) - self.n + 1, np.uint64)
        for k in range(self.n):
            out = (out ^ x[k : len(x) - self.n + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out

    def encode(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))

    def grams_in(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, position, place in the item) of the n-grams that coded words share with items."""
        none = np.zeros(0, np.int64)
        h = self.hashes(x)
        if not len(h) or not len(self.keys):
            return none, none, none
        whole = np.concatenate([[0], np.cumsum(x >= 0)])
        at = np.flatnonzero(whole[self.n :] - whole[: -self.n] == self.n)
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        at, k = at[hit], k[hit]
        which, entry = _spread(self.key_first[k], self.key_count[k])
        return self.seed_item[entry], at[which], self.seed_place[entry]

    def rare_in(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first position, last position) of the stretches with enough rare words of an item."""
        at = np.flatnonzero(x >= 0)
        which, entry = _spread(self.word_first[x[at]], self.word_count[x[at]])
        item, place = self.word_item[entry], at[which]
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        other = np.arange(len(item)) + self.least[item] - 1
        inside = np.minimum(other, max(len(item) - 1, 0))
        ok = (other < len(item)) & (item[inside] == item) & (place[inside] - place < self.reach[item])
        return item[ok], place[ok], place[inside[ok]]

    def shared(self, item: int, x: np.ndarray) -> int:
        """How many words of an item coded words hold, repeats as often as in both."""
        words, counts = self.counts[item]
        k = np.minimum(np.searchsorted(words, x), len(words) - 1)
        return int(np.minimum(np.bincount(k[words[k] == x], minlength=len(words)), counts).sum())

    def line_matches(self, text: str | None) -> list[tuple[str | None, float, int, int]]:
        out, end = {}, 0
        longest = max(map(len, self.lines))
        for line in (text or "").split("\n"):
            t = tokens(line)
            end += len(t)
            if len(t) <= longest:
                for i in self.lines.get(tuple(t), ()):
                    out.setdefault(i, (i, 1.0, 0, end))
        return list(out.values())

    def matches(self, texts: list[str | None]) -> list[list[tuple[str | None, float, int, int]]]:
        """(item id, score, shared n-grams, end word) of the items in each text."""
        out: list[list] = [self.line_matches(t) if self.lines else [] for t in texts]
        if not self.ids:
            return out
        best: dict[tuple[int, int], tuple[int, int]] = {}
        seeds: dict[tuple[int, int], int] = {}
        held: list[tuple[int, int, np.ndarray]] = []  # (text, first word, coded words)
        size = 0
        for d, text in enumerate(texts):
            x = self.encode(tokens(text))
            for a in range(0, len(x), PIECE):
                held.append((d, a, x[a : a + PIECE + self.gap]))
                size += len(held[-1][2]) + self.gap
                if size > PIECE:
                    self._align(held, best, seeds)
                    held, size = [], 0
        if held:
            self._align(held, best, seeds)
        for (d, item), (score, end) in sorted(best.items()):
            whole = MATCH * len(self.coded[item])
            if score >= self.need[item] * whole:
                out[d].append((self.ids[item], score / whole, seeds.get((d, item), 0), end))
        return out

    def _align(self, pieces: list[tuple[int, int, np.ndarray]], best: dict, seeds: dict) -> None:
        blank = np.full(self.gap, -1, np.int64)
        x = np.concatenate([y for _, _, p in pieces for y in (p, blank)])
        size = np.array([len(p) for _, _, p in pieces])
        start = np.cumsum(size + self.gap) - size - self.gap
        g_item, g_at, g_place = self.grams_in(x)
        r_item, r_first, r_last = self.rare_in(x)
        item, at = np.concatenate([g_item, r_item]), np.concatenate([g_at, r_first])
        if not len(item):
            return
        piece = np.searchsorted(start, at, "right") - 1
        # the ends that an alignment through the seed can reach
        extra = self.reach[item]
        low = np.concatenate([g_at - g_place, r_last]) - extra
        high = at + extra + np.concatenate([self.size[g_item] - g_place, np.zeros(len(r_item), np.int64)])
        low, high = np.maximum(low, start[piece]), np.minimum(high, (start + size)[piece])
        # what overlaps for one item is one stretch
        order = np.lexsort((low, item))
        item, piece, low, high = item[order], piece[order], low[order], high[order]
        span = len(x) + 1
        until = np.maximum.accumulate(item * span + high) - item * span
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (low[1:] > until[:-1])
        first = np.flatnonzero(new)
        high = until[np.append(first[1:], len(item)) - 1]
        for i, p, a, z in zip(item[first].tolist(), piece[first].tolist(), low[first].tolist(), high.tolist(), strict=True):
            # a score is at most that of the shared words
            if self.shared(i, x[a:z]) < self.need[i] * len(self.coded[i]):
                continue
            score, stop = align(self.coded[i], x[a:z])
            d, offset, _ = pieces[p]
            if score > best.get((d, i), (0, 0))[0]:
                best[d, i] = score, int(offset + a - start[p] + stop)
        for i, p, a in zip(g_item.tolist(), (np.searchsorted(start, g_at, "right") - 1).tolist(), g_at.tolist(), strict=True):
            if a - start[p] < PIECE:  # else the next piece counts it
                key = (pieces[p][0], i)
                seeds[key] = seeds.get(key, 0) + 1


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best score and the position in words after its end."""
    best, end = 0, 0
    steps = np.arange(len(words) + 1) * -GAP
    above = np.zeros(len(words) + 1, np.int64)
    for w in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(words == w, MATCH, MISMATCH))
        # a gap along the row: max over k <= j of row[k] + GAP * (j - k)
        row = np.maximum.accumulate(row + steps) - steps
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
        above = row
    return best, end


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """Items as words, in blocks of at most ``limit`` words (or one item)."""
    block: list[tuple[str | None, list[str]]] = []
    held = 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        t = tokens(r["t"])
        if block and held + len(t) > limit:
            yield block
            block, held = [], 0
        if t:
            block.append((r["i"], t))
            held += len(t)
    if block:
        yield block


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 4,
    threshold: float = 0.55,
    exact_below: int = 8,
    block_words: int = 400_000,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` (1: the whole item, word for word), ``n_seeds`` (shared n-grams), ``end_word``."""
    spark = docs.sparkSession
    # ids go through Python as text: a null among longs would turn them into floats
    table = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = "doc_id string, item_id string, score double, n_seeds int, end_word long"
    out = None
    for block in item_blocks(items, item_col, item_text_col, block_words):
        ready = spark.sparkContext.broadcast(Items(block, n, threshold, exact_below))

        def score(batches: Iterator[pd.DataFrame], ready=ready) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = ready.value.matches(b["text"].tolist())
                rows = [(d, *m) for d, some in zip(b["doc_id"].tolist(), found, strict=True) for m in some]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "n_seeds", "end_word"])

        part = table.mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumns({"doc_id": F.col("doc_id").cast(kinds[0]), "item_id": F.col("item_id").cast(kinds[1])})


def holds_none(sent: Broadcast) -> Callable[..., Column]:
    """Whether a text holds none of the items that were sent."""

    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not m for m in sent.value.matches(texts.tolist())], dtype=bool)

    return clean


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 4,
    threshold: float = 0.55,
    exact_below: int = 8,
    block_words: int = 400_000,
) -> DataFrame:
    """docs without the rows whose text holds an item; each row is judged by its own text, whatever its id."""
    for block in item_blocks(items, item_col, item_text_col, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, n, threshold, exact_below))
        docs = docs.filter(holds_none(sent)(F.col(text_col).cast("string")))
    return docs
