"""Quality scores by pairwise ranking (Bradley-Terry).

Documents are described by the shape of their whole text. Pairs of a good and a bad labelled
document are preferences; the weights minimise the logistic loss of the differences of their
features. The scores' quantile at the bad documents' share is the threshold: scores are squashed
around it, so 0.5 parts the predicted classes.

The model is fitted on a bounded sample: the ``max_rows`` labelled rows that come first by a hash of
their id, and ``max_pairs`` pairs of them. Rows that are held out never take part.

Defined cases: a null text is the empty text and gets a score; a null id is not held out; a label
without a document or with a null is ignored; conflicting and repeated labels count each; rows that
repeat a labelled id count each, up to ``max_rows`` in all; a score at the quantile itself is 0.5 and
predicted 1; with one class only all scores follow its sign; very long texts take time and memory in
proportion to their length; further columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
CLIP = 5.0


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE, MARKS = _flags(b" \t\n\v\f\r"), _flags(b"#*$%&|<>!")
UPPER, LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
#: Letters, digits and all of other scripts.
WORDLIKE = UPPER | LOWER | _flags(bytes(range(48, 58))) | _flags(bytes(range(128, 256)))


def describe(text: str | None) -> np.ndarray:
    """Shape of a text: rates of kinds of characters, words and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    x = np.frombuffer(raw, np.uint8)
    c = np.bincount(x, minlength=256)
    edge = np.diff(np.concatenate([[1], SPACE[x], [1]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # of words
    lengths = end - start if len(start) else np.zeros(1, np.int64)
    words = raw.split()
    lines = [y for y in raw.split(b"\n") if y and not y.isspace()]
    n, m, size = max(1, len(words)), max(1, len(lines)), max(1, len(raw))
    first, last = x[start], x[end - 1]
    low, up = (np.concatenate([[0], np.cumsum(k[x])]) for k in (LOWER, UPPER))
    shouted = ((low[end] == low[start]) & (up[end] > up[start])).sum()
    upper, lower = c[65:91].sum(), c[97:123].sum()
    share = c[c > 0] / size
    return np.array(
        [
            np.log1p(len(words)),
            np.log1p(len(lines)),
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            c[SYMBOLS].sum() / n,
            c[124] / n,
            c[33] / n,
            c[63] / n,
            c[46] / n,
            c[44] / n,
            upper / max(1, upper + lower),
            c[48:58].sum() / size,
            c[128:].sum() / size,
            (upper + lower) / size,
            len(set(words)) / n,
            len(set(lines)) / m,
            np.log1p(len(words) / m),
            shouted / n,
            UPPER[first].sum() / n,
            sum(y.rstrip()[-1:] in b".!?" for y in lines) / m,
            float((lengths <= 3).mean()),
            float((lengths >= 12).mean()),
            -(share * np.log(share)).sum() if len(share) else 0.0,
            (c[34] + c[39] + c[40] + c[41] + c[58] + c[59] + c[45]) / n,
            (~WORDLIKE[first]).sum() / n,
            MARKS[last].sum() / n,
        ]
    )


def pair_loss(differences: np.ndarray, w: np.ndarray, ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """Mean of log(1 + exp(-d w)) over the preferences' differences, with a small ridge; its gradient."""
    z = np.clip(differences @ w, -30, 30)
    loss = float(np.log1p(np.exp(-z)).mean() + ridge / 2 * (w @ w))
    return loss, -(differences * (1 / (1 + np.exp(z)))[:, None]).mean(0) + ridge * w


class Ranker:
    """Weights of standardised features, their squares and magnitudes; the threshold and scale of scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, max_pairs: int = 100_000, seed: int = 3, steps: int = 300):
        self.mean, self.std = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(27), np.ones(27))
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        z = self.basis(x)
        self.w = np.zeros(z.shape[1])
        if len(good) and len(bad):
            r = np.random.default_rng(seed)
            d = z[r.choice(good, max_pairs)] - z[r.choice(bad, max_pairs)]
            m, v = np.zeros_like(self.w), np.zeros_like(self.w)
            for k in range(1, steps + 1):
                some = d[r.integers(0, len(d), 4096)]
                g = pair_loss(some, self.w)[1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                self.w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        raw = z @ self.w
        share = len(bad) / max(1, len(y))
        self.threshold = float(np.quantile(raw, share)) if len(good) and len(bad) else (-1.0 if len(good) or not len(bad) else 1.0)
        self.scale = (float(raw.std()) if len(raw) else 0.0) or 1.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -CLIP, CLIP)
        return np.hstack([z, z * z / CLIP, np.abs(z)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.basis(x) @ self.w - self.threshold) / self.scale * 4, -30, 30)))


def features_of() -> Callable[..., Column]:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def described(text: pd.Series) -> pd.Series:
        return pd.Series([describe(t) for t in text], dtype=object)

    return described


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, max_pairs: int = 100_000) -> Ranker:
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("i"), "i", "y").limit(max_rows)
    # at most max_rows ids are sent
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(known), "i")
    sample = sample.select("i", "y", features_of()("t").alias("x"))
    # an id may stand in many rows, so the rows are bounded once more
    sample = sample.orderBy(F.xxhash64("i"), "i", "y", "x").limit(max_rows)
    got = sample.toPandas().sort_values(["i", "y"], kind="stable")
    x = np.array(got["x"].tolist()).reshape(len(got), -1) if len(got) else np.zeros((0, 27))
    return Ranker(x, got["y"].to_numpy(), max_pairs)


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``score``, ``predicted`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(np.array([describe(t) for t in text]).reshape(len(text), -1)))

    out = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), scored(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
