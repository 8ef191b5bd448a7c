"""Density-ratio weights of unpaired data by a balanced logistic model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.scores import clamp


@dataclass
class Balanced:
    """A logistic model: ``weights`` of the features, ``bias``; ``rounds`` of Newton's method taken."""

    weights: np.ndarray
    bias: float
    rounds: int

    def probability(self, vector: str | Column) -> Column:
        """The probability of a vector's row to be desired, as a column expression."""
        terms = F.zip_with(vector, F.array(*[F.lit(float(w)) for w in self.weights]), lambda x, w: x * w)
        return 1 / (1 + F.exp(-(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) + float(self.bias))))


def _sums(d: DataFrame, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted logistic loss at w, added up by cell of the matrix over all tasks."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size))
        for b in batches:
            x = np.column_stack([np.stack(b["x"].to_numpy()).astype(float), np.ones(len(b))])
            p = 1 / (1 + np.exp(-(x @ w)))
            total[0] += x.T @ (b["s"].to_numpy() * (p - b["y"].to_numpy()))
            total[1:] += x.T @ (x * (b["s"].to_numpy() * p * (1 - p))[:, None])
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    cells = d.mapInPandas(part, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # (size + 1) * size at most
    out = np.zeros((size + 1) * size)
    for r in cells:
        out[r["cell"]] = r["value"]
    out = out.reshape(size + 1, size)
    return out[0], out[1:]


def fit_balanced(df: DataFrame, vector: str, desired: str, penalty: float = 1.0, rounds: int = 50) -> Balanced | None:
    """The model by Newton's method, one aggregate over the rows a round; None unless both classes have rows.

    Least is penalty / 2 * |weights| ** 2 + the sum of row weight * logistic loss; both classes weigh the
    same. Rows without a vector or a class are left out. What comes to the driver is a matrix of the
    features' size.
    """
    d = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(desired).cast("double").alias("y")).filter("x is not null and y is not null")
    n = d.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"), F.max(F.size("x")).alias("size")).first()
    if not n["n"] or n["good"] in (0.0, float(n["n"])):
        return None
    d = d.withColumn("s", F.when(F.col("y") == 1, n["n"] / (2 * n["good"])).otherwise(n["n"] / (2 * (n["n"] - n["good"]))))
    size = n["size"] + 1
    ridge = np.append(np.full(size - 1, float(penalty)), 0.0)
    w = np.zeros(size)
    for k in range(rounds):
        gradient, hessian = _sums(d, w, size)
        step = np.linalg.solve(hessian + np.diag(ridge), gradient + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-12 * max(1.0, np.abs(w).max()):
            break
    return Balanced(w[:-1], float(w[-1]), k + 1)


def density_weights(df: DataFrame, vector: str, desired: str, low: float = 0.1, high: float = 10.0, model: Balanced | None = None) -> DataFrame:
    """df with ``weight``: p / (1 - p) within bounds, p a row's probability to be desired by a model (fitted here if none is given).

    Without rows of both classes there is nothing to tell apart, and each weight is 1 within the bounds;
    a row without a vector has no weight.
    """
    model = model or fit_balanced(df, vector, desired)
    if model is None:
        return df.withColumn("weight", F.lit(min(max(1.0, low), high)))
    p = model.probability(F.col(vector).cast("array<double>"))
    return df.withColumn("weight", F.when(p.isNotNull(), clamp(p / (1 - p + 1e-8), low, high)))
