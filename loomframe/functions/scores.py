"""Preference and reward scores as column expressions over log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logsigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return -logsigmoid(-x)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def pairwise_terms(pc: Column, pr: Column, rc: Column, rr: Column, beta: float = 0.1) -> dict[str, Column]:
    """What the pairwise losses share: project these columns first, so that each is computed once."""
    return {"lc": pc - rc, "lr": pr - rr, "z": (pc - pr) - (rc - rr), "bz": beta * ((pc - pr) - (rc - rr))}


def pairwise(lc: Column, lr: Column, z: Column, beta: float = 0.1, eps: float = 0.1, delta: float | Column = 0.0, tau: float = 0.05, lengths: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Losses of chosen and rejected completions by their log-ratios ``lc``, ``lr`` and the difference ``z``.

    exo_pair takes 1e-3 for an eps of 0. ``lengths``: tokens of chosen and rejected, by which ipo averages the log-ratios.
    """
    b, ls, s = beta, logsigmoid, sigmoid
    m = s(b * z / tau)
    e = eps or 1e-3
    zi = z if lengths is None else lc / lengths[0] - lr / lengths[1]
    return {
        "sigmoid": -ls(b * z) * (1 - eps) - ls(-b * z) * eps,
        "robust": (-ls(b * z) * (1 - eps) + ls(-b * z) * eps) / (1 - 2 * eps),
        "exo_pair": s(b * z) * (ls(b * z) - F.log(F.lit(1 - e))) + s(-b * z) * (ls(-b * z) - F.log(F.lit(e))),
        "hinge": relu(1 - b * z),
        "ipo": (zi - 1 / (2 * b)) * (zi - 1 / (2 * b)),
        "bco_pair": -ls(b * lc - delta) - ls(-(b * lr - delta)),
        "sppo_hard": (lc - 0.5 / b) * (lc - 0.5 / b) + (lr + 0.5 / b) * (lr + 0.5 / b),
        "nca_pair": -ls(b * lc) - 0.5 * ls(-b * lc) - 0.5 * ls(-b * lr),
        "apo_zero": (1 - s(b * lc)) + s(b * lr),
        "apo_down": s(b * lc) + (1 - s(b * (lc - lr))),
        "discopop": -ls(b * z) * (1 - m) + F.exp(-b * z) * m,
    }


def divergence(lc: Column, lr: Column, beta: float = 0.1, alpha: float = 0.5, cap: float = 10.0) -> dict[str, Column]:
    """Sigmoid losses with the alpha and Jensen-Shannon divergences in place of the reverse KL."""
    capped = lambda x: F.exp(F.least(x, F.lit(cap)))
    za = (capped(-alpha * lr) - capped(-alpha * lc)) / alpha
    zj = (lc - lr) - (softplus(lc) - softplus(lr))
    return {"alpha": -logsigmoid(beta * za), "js": -logsigmoid(beta * zj)}


def reference_free(pc: Column, pr: Column, beta: float = 0.1, gamma: float = 0.5, a: float = 0.25) -> dict[str, Column]:
    """Losses without a reference: plain, with a margin, with transformed rewards, and by odds."""
    z = pc - pr
    zg = z - gamma / beta
    ta, tb = (1 - F.exp(-a * pc)) / a, (1 - F.exp(-a * pr)) / a
    odds = z - (F.log1p(-F.exp(pc)) - F.log1p(-F.exp(pr)))
    return {
        "plain_sigmoid": -logsigmoid(beta * z),
        "plain_hinge": relu(1 - beta * z),
        "plain_ipo": (z - 1 / (2 * beta)) * (z - 1 / (2 * beta)),
        "simpo": -logsigmoid(beta * zg),
        "alphapo": -logsigmoid(beta * (ta - tb)),
        "orpo_term": beta * logsigmoid(odds),
    }


def odds_total(nll: Column, terms: Column) -> Column:
    """Aggregate: mean likelihood loss less the mean odds term."""
    return F.avg(nll) - F.avg(terms)


def kl_estimate(new: Column, reference: Column, kind: str) -> Column:
    """Estimate of the divergence from a reference: k1 or k3."""
    if kind not in ("k1", "k3"):
        raise ValueError("kind is k1 or k3")
    return new - reference if kind == "k1" else k3(reference, new)


def sequence_log_ratio(new: Column, old: Column, mask: Column) -> Column:
    """Mean of a sequence's masked log-ratios: arrays of log-probabilities and a mask."""
    kept = F.zip_with(F.zip_with(new, old, lambda a, b: a - b), mask, lambda x, m: x * m)
    total = F.aggregate(kept, F.lit(0.0), lambda t, x: t + x)
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda t, x: t + x), F.lit(1.0))


def clipped(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> dict[str, Column]:
    """Whether a ratio is clipped from below, from above, or either."""
    below, above = (ratio < 1 - low) & (advantage < 0), (ratio > 1 + high) & (advantage > 0)
    return {"low": below, "high": above, "region": below | above}


def reduced(total: Column, rows: Column, tokens: Column, how: str) -> Column:
    """Aggregate of a divergence: over the count of rows (batchmean), its sum, or its mean over tokens."""
    if how not in ("batchmean", "sum", "mean"):
        raise ValueError("how is batchmean, sum or mean")
    return {"batchmean": F.sum(total) / F.sum(rows), "sum": F.sum(total), "mean": F.sum(total) / F.sum(tokens)}[how]


def ratio_objective(new: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, cap: float | None = None) -> Column:
    ratio = F.exp(new - old)
    first = ratio if cap is None else F.least(ratio, F.lit(cap))
    return -F.least(first * advantage, clamp(ratio, 1 - low, 1 + high) * advantage)


def k3(reference: Column, new: Column) -> Column:
    return F.exp(reference - new) - (reference - new) - 1


def weighted_loss(parts: dict[str, Column], weights: dict[str, float], nll: Column, alpha: float) -> Column:
    """Sum of weighted losses and a share of the likelihood's."""
    total = alpha * nll
    for k, w in weights.items():
        total = total + w * parts[k]
    return total


def null_skipping_sum(parts: list[tuple[float, Column]]) -> Column:
    """Weighted sum that skips nulls and NaN."""
    return sum((F.coalesce(F.nanvl(w * c, F.lit(0.0)), F.lit(0.0)) for w, c in parts), F.lit(0.0))


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda t, x: t + F.exp(x - top)))


def jensen_shannon(p: Column, q: Column, beta: float = 0.5) -> Column:
    """Generalised Jensen-Shannon divergence of two arrays of log-probabilities: q is the teacher's."""
    mix = F.zip_with(p, q, lambda a, b: F.log((1 - beta) * F.exp(a) + beta * F.exp(b)))

    def kl(a: Column) -> Column:
        return F.aggregate(F.zip_with(a, mix, lambda x, m: F.exp(x) * (x - m)), F.lit(0.0), lambda t, x: t + x)

    return beta * kl(q) + (1 - beta) * kl(p)


def policy_weight(logps: list[Column], squares: list[Column], masks: list[Column]) -> Column:
    """exp of the summed masked means of log-probability less the log of the expected probability, 1 at most.

    One array each for chosen and rejected: log-probabilities, logsumexp of twice the log-probabilities, masks.
    """
    total = F.lit(0.0)
    for p, s, m in zip(logps, squares, masks, strict=True):
        kept = F.zip_with(F.zip_with(p, s, lambda a, b: a - b), m, lambda x, on: F.when(on != 0, x).otherwise(0.0))
        count = F.size(F.filter(m, lambda on: on != 0))
        total = total + F.aggregate(kept, F.lit(0.0), lambda t, x: t + x) / F.greatest(count, F.lit(1))
    return F.least(F.exp(total), F.lit(1.0))
