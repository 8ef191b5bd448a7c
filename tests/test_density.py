"""Balanced logistic weights against a dense solve, and the running delta."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import sequences
from loomframe.operators.density import density_weights, fit_balanced


def dense(x, y, penalty):
    """Newton's method on the whole matrix."""
    x = np.column_stack([x, np.ones(len(x))])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge, w = np.append(np.full(x.shape[1] - 1, penalty), 0.0), np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (s * (p - y)) + ridge * w)
    return w


def test_weights_equal_a_dense_solve(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 6))
    y = (x[:, 0] + 0.3 * r.normal(size=400) > 0.9).astype(float)
    rows = [(k, [float(v) for v in x[k]], bool(y[k])) for k in range(400)]
    df = spark.createDataFrame([*rows, (1000, None, True), (1001, [0.0] * 6, None)], "k long, v array<double>, good boolean").repartition(5)
    for penalty in (1.0, 0.01):
        model, want = fit_balanced(df, "v", "good", penalty), dense(x, y, penalty)
        assert np.abs(np.append(model.weights, model.bias) - want).max() < 1e-8
    p = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(400)]) @ dense(x, y, 1.0))))
    got = {t.k: t.weight for t in density_weights(df, "v", "good", 0.2, 3.0).collect()}
    assert all(got[k] == pytest.approx(min(max(p[k] / (1 - p[k] + 1e-8), 0.2), 3.0), abs=1e-8) for k in range(400))
    assert got[1000] is None and len(got) == 402
    one = df.filter("good")
    assert fit_balanced(one, "v", "good") is None and {t.weight for t in density_weights(one, "v", "good").collect()} == {1.0}
    assert fit_balanced(df.limit(0), "v", "good") is None


def test_running_delta(spark):
    rows = [(b, k, float(b * 3 + k) if k != 2 else None) for b in range(40) for k in range(1 + b % 4)] + [(None, 0, 5.0), (99, 0, None)]
    out = sequences.running_delta(spark.createDataFrame(rows, "b long, k long, r double").repartition(4), "b", F.col("r")).collect()
    assert len(out) == len(rows)
    for x in out:
        seen = [r for b, _, r in rows if r is not None and (b is None or (x.b is not None and b <= x.b))]
        assert x.delta == pytest.approx(sum(seen) / len(seen))
    none = spark.createDataFrame([(1, None)], "b long, r double")
    assert sequences.running_delta(none, "b", F.col("r")).first().delta == 0.0
