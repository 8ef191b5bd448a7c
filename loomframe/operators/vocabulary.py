"""Log-probabilities over a whole vocabulary in long form: one row for each context and token id.

A context may have any number of ids: its log-sum-exp is merged of parts, each a maximum and a sum scaled by
it, so no task or array holds a context whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.scores import sigmoid
from loomframe.operators.ordering import join_safe
from loomframe.sources.shared import store

#: Parts that a context's ids are dealt to by hash.
PARTS = 32


def log_sum_exp(df: DataFrame, by: list[str], logit: Column, name: str = "lse") -> DataFrame:
    """``by`` and the logarithm of the summed exponentials of each context's finite logits; null ones count for nothing."""
    d = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))).select(*by, "_part", logit.alias("_x")).filter("_x is not null")
    d = d.withColumn("_m", F.max("_x").over(Window.partitionBy(*by, "_part")))
    parts = d.groupBy(*by, "_part").agg(F.max("_m").alias("m"), F.sum(F.exp(F.col("_x") - F.col("_m"))).alias("s"))
    parts = parts.groupBy(*by).agg(F.max("m").alias("_top"), F.collect_list(F.struct("m", "s")).alias("_parts"))  # PARTS at most
    total = F.aggregate("_parts", F.lit(0.0), lambda t, p: t + p["s"] * F.exp(p["m"] - F.col("_top")))
    return parts.select(*by, (F.col("_top") + F.log(total)).alias(name))


def log_softmax(df: DataFrame, by: list[str], logit: str, name: str = "logp") -> DataFrame:
    """df with the log-probability of each row within its context."""
    return join_safe(df, log_sum_exp(df, by, F.col(logit)), by).withColumn(name, F.col(logit) - F.col("lse")).drop("lse")


def bigrams(df: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """``keys``, ``pos``, ``context`` and ``id`` of each token that follows another."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    both = F.arrays_zip(F.slice(ids, F.lit(1), n).alias("context"), F.slice(ids, F.lit(2), n).alias("id"))
    return df.select(*keys, F.posexplode(both).alias("pos", "_x")).select(*keys, "pos", "_x.context", "_x.id")


def bigram_counts(df: DataFrame, ids: str, **subsets: Column) -> DataFrame:
    """``context``, ``id`` and how often they follow, as ``n``, and within each subset of the rows, by its name; written once.

    The rows' tokens are made once for all models of them, and no model counts them again.
    """
    names = list(subsets)
    tokens = bigrams(df.select(ids, *[c.alias(k) for k, c in subsets.items()]), names, ids)
    counts = tokens.groupBy("context", "id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(k)).alias(k) for k in names])
    return store(counts, "bigrams")


def model_of_counts(counts: DataFrame, n: str = "n") -> DataFrame:
    """A model of next tokens: ``context``, ``id`` and ``logp``, of counts; ids never seen after a context have no row."""
    seen = counts.filter(F.col(n) > 0).select("context", "id", F.log(F.col(n).cast("double")).alias("logit"))
    return log_softmax(seen, ["context"], "logit").drop("logit")


def bigram_model(df: DataFrame, ids: str) -> DataFrame:
    """The model of a table's arrays of ids."""
    return model_of_counts(bigram_counts(df, ids))


def sequence_sums(tokens: DataFrame, keys: list[str], policy: DataFrame, reference: DataFrame) -> DataFrame:
    """Per sequence the masked token sums of two models: the mask is on where both know the token.

    ``n`` tokens in the mask, ``logp`` and ``ref`` summed, ``kl`` (of logp - ref) and ``k3`` summed,
    ``weight``: exp of the mean of logp less the log of its expected probability, 1 at most.
    """
    square = log_sum_exp(policy, ["context"], 2 * F.col("logp"), "square")
    models = policy.join(reference.select("context", "id", F.col("logp").alias("ref")), ["context", "id"]).join(square, "context")
    t = tokens.join(models, ["context", "id"], "left")
    on, gap = F.col("ref").isNotNull(), F.col("ref") - F.col("logp")
    total = lambda c: F.coalesce(F.sum(F.when(on, c)), F.lit(0.0))
    out = t.groupBy(*keys).agg(
        F.count("ref").alias("n"), total(F.col("logp")).alias("logp"), total(F.col("ref")).alias("ref"),
        total(-gap).alias("kl"), total(F.exp(gap) - 1 - gap).alias("k3"), total(F.col("logp") - F.col("square")).alias("_w"),
    )
    return out.withColumn("weight", F.least(F.exp(F.col("_w") / F.greatest("n", F.lit(1))), F.lit(1.0))).drop("_w")


def clipped_reward(reward: Column, kl: Column, low: float, high: float, beta: float) -> Column:
    """A reward within bounds less the summed divergence of its tokens."""
    return F.least(F.greatest(reward, F.lit(low)), F.lit(high)) - beta * kl


def nash_score(model: Column, mixture: Column, logp: Column) -> Column:
    """How far the model is preferred to the mixture, times the summed log-probability."""
    return (sigmoid(model - mixture) - 0.5) * logp


def divergence(a: DataFrame, b: DataFrame, beta: float = 0.5) -> DataFrame:
    """``context`` and the generalised Jensen-Shannon divergence of two models there, b the teacher; an absent id has no mass."""
    d = a.select("context", "id", F.col("logp").alias("p")).join(b.select("context", "id", F.col("logp").alias("q")), ["context", "id"], "full")
    p, q = (F.coalesce(F.exp(c), F.lit(0.0)) for c in ("p", "q"))
    mix = F.log((1 - beta) * p + beta * q)
    part = lambda mass, c: F.coalesce(F.sum(mass * (F.col(c) - mix)), F.lit(0.0))
    return d.groupBy("context").agg((beta * part(q, "q") + (1 - beta) * part(p, "p")).alias("jsd"))
