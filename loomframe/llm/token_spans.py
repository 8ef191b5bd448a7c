"""Token counts of sections by offsets.

A whole document is encoded once. Its tokens' spans are joined with the spans of its sections (for
the query: its lines, each with the newline that ends it) and each token is given to sections by a
rule:

- ``start``: to the section that holds its first byte;
- ``most``: to that with most of its bytes, the first of equals;
- ``share``: to each section by the part of its bytes there.

Spans are bytes in UTF-8 within, and code points in ``token_spans``. The split pattern looks ahead
over white space and would go too deep on a very long run of it, so such a run is encoded apart: all
of it but its last character is one piece in any case, which makes the tokens the same.

Defined cases: a null or empty text has one empty section without tokens; a null id stays null;
repeated rows each give their sections; an empty table gives an empty result; further columns are
ignored, whatever their names; very long texts, words and white space take time and memory in
proportion to their length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "most", "share")
#: Split pattern of the byte-level vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is encoded apart; the pattern's \\s is that of Unicode, without the separators U+001C to U+001F.
LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{32,}")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Encoder:
    """A byte-level vocabulary; small enough to send (ranks of one vocabulary file)."""

    def __init__(self, lines: bytes, pattern: str = PATTERN):
        self.lines, self.pattern = lines, pattern
        self._ready: tuple[tiktoken.Encoding, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"lines": self.lines, "pattern": self.pattern, "_ready": None}

    def ready(self) -> tuple[tiktoken.Encoding, np.ndarray]:
        if self._ready is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines())}
            sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, k in ranks.items():
                sizes[k] = len(token)
            self._ready = tiktoken.Encoding("sections", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), sizes
        return self._ready

    def encode(self, text: str) -> list[int]:
        """Token numbers of a text."""
        encoding, _ = self.ready()
        out: list[int] = []
        at = 0
        for m in LONG_SPACE.finditer(text):
            # at the text's end the whole run is one piece, else its last character belongs to what follows
            end = m.end() - (m.end() < len(text))
            out += encoding.encode_ordinary(text[at : m.start()])
            out += encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + encoding.encode_ordinary(text[at:])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the tokens."""
        size = self.ready()[1][np.array(self.encode(text), np.int64)]
        end = np.cumsum(size)
        return end - size, end


def token_spans(encoder: Encoder, text: str) -> list[tuple[int, int]]:
    """Code-point spans of the tokens; a character that tokens share belongs to each of them."""
    start, end = encoder.spans(text)
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    return [(int(before[a + 1]) - 1, int(before[b])) for a, b in zip(start, end, strict=True)]


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section; section k spans bounds[k] to bounds[k + 1]."""
    n = len(bounds) - 1
    # empty sections hold nothing: the last section that begins at or before a byte has it
    first = np.minimum(np.searchsorted(bounds, start, "right") - 1, n - 1)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    last = np.minimum(np.searchsorted(bounds, end - 1, "right") - 1, n - 1)
    inside = first == last
    out = np.bincount(first[inside], minlength=n).astype(float)
    for k in np.flatnonzero(~inside).tolist():
        parts = np.arange(first[k], last[k] + 1)
        held = np.minimum(end[k], bounds[parts + 1]) - np.maximum(start[k], bounds[parts])
        if rule == "most":
            out[parts[int(np.argmax(held))]] += 1
        else:
            out[parts] += held / (end[k] - start[k])
    return out


def line_bounds(raw: bytes) -> np.ndarray:
    """Bounds of lines, each with its newline; text after the last newline is a line, if any."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    if not len(at) or at[-1] != len(raw):
        at = np.append(at, len(raw))
    return np.concatenate([[0], at])


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id``, ``section``, ``n_bytes``, ``n_tokens`` of each section of each row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(Encoder(file.read()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, n, sections, sizes, tokens = [], [], [], [], []
            for i, text in zip(b["id"], b["text"], strict=True):
                text = text or ""
                bounds = line_bounds(text.encode())
                ids.append(i)
                n.append(len(bounds) - 1)
                sections.append(np.arange(len(bounds) - 1))
                sizes.append(np.diff(bounds))
                tokens.append(attribute(*sent.value.spans(text), bounds, rule))
            if ids:
                yield pd.DataFrame({"id": np.repeat(np.array(ids, object), n), "section": np.concatenate(sections), "n_bytes": np.concatenate(sizes), "n_tokens": np.concatenate(tokens)})

    kind = docs.schema[id_col].dataType.simpleString()
    # ids go through Python as text: a null among longs would turn them into floats
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(count, "id string, section int, n_bytes long, n_tokens double")
    out = out.withColumn("id", F.col("id").cast(kind))
    return out if rule == "share" else out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
