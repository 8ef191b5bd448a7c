"""Queries on log-probabilities over the vocabulary: bigram models of the documents, scores of the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import scores as C
from loomframe.operators import subwords, vocabulary
from loomframe.plans.preference import ls, rounded, sg
from loomframe.plans.registry import query
from loomframe.plans.sequences import TOKENS_SQL, token_pairs
from loomframe.plans.subwords_sql import with_ids
from loomframe.plans.tables import table

# the policy is a model of all documents, the reference one of the English ones
MODELS_SQL = f"""d AS (SELECT lang, s FROM {with_ids("documents", s="text")}),
g AS (SELECT lang, unnest(s[:len(s) - 1]) AS context, unnest(s[2:]) AS id FROM d),
pm AS (SELECT context, id, ln(count(*)) AS x FROM g GROUP BY context, id), rm AS (SELECT context, id, ln(count(*)) AS x FROM g WHERE lang = 'en' GROUP BY context, id),
p AS (SELECT context, id, x - max(x) OVER w - ln(sum(exp(x)) OVER w / exp(max(x) OVER w)) AS logp FROM pm WINDOW w AS (PARTITION BY context)),
r AS (SELECT context, id, x - max(x) OVER w - ln(sum(exp(x)) OVER w / exp(max(x) OVER w)) AS logp FROM rm WINDOW w AS (PARTITION BY context))"""


def models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ids = subwords.encoder(subwords.vocabulary(spark))
    docs = table(spark, d, "documents").select("lang", ids(F.col("text")).alias("s"))
    counts = vocabulary.bigram_counts(docs, "s", english=F.col("lang") == "en")
    return vocabulary.model_of_counts(counts), vocabulary.model_of_counts(counts, "english")


@query(f"""WITH {MODELS_SQL}
SELECT coalesce(p.context, r.context) AS context, count(p.id) AS n_ids, round(coalesce(-sum(exp(p.logp) * p.logp), 0), 6) + 0.0 AS entropy,
 round(0.5 * coalesce(sum(exp(r.logp) * (r.logp - ln(0.5 * coalesce(exp(p.logp), 0) + 0.5 * exp(r.logp)))), 0) + 0.5 * coalesce(sum(exp(p.logp) * (p.logp - ln(0.5 * exp(p.logp) + 0.5 * coalesce(exp(r.logp), 0)))), 0), 6) + 0.0 AS jsd
FROM p FULL JOIN r ON r.context = p.context AND r.id = p.id GROUP BY 1""")
def ls_vocabulary_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of each context's next tokens and how far two models are apart there."""
    policy, reference = models(spark, d)
    shape = policy.groupBy("context").agg(F.count("id").alias("n_ids"), (-F.sum(F.exp("logp") * F.col("logp"))).alias("entropy"))
    return vocabulary.divergence(policy, reference).join(shape, "context").select("context", "n_ids", *rounded({"entropy": F.col("entropy"), "jsd": F.col("jsd")}, 6))


@query(f"""WITH {MODELS_SQL},
q AS (SELECT context, ln(sum(exp(2 * logp))) AS sq FROM p GROUP BY context),
t AS (SELECT conv_id, turn, 'p' AS part, unnest(p[:len(p) - 1]) AS context, unnest(p[2:]) AS id FROM {TOKENS_SQL} UNION ALL SELECT conv_id, turn, 'c', unnest(c[:len(c) - 1]), unnest(c[2:]) FROM {TOKENS_SQL}),
s AS (
 SELECT conv_id, turn, part, count(r.id) AS n, coalesce(sum(p.logp) FILTER (r.id IS NOT NULL), 0) AS logp, coalesce(sum(r.logp), 0) AS ref, coalesce(sum(p.logp - r.logp), 0) AS kl,
  coalesce(sum(exp(r.logp - p.logp) - 1 - (r.logp - p.logp)), 0) AS k3, least(exp(coalesce(sum(p.logp - q.sq) FILTER (r.id IS NOT NULL), 0) / greatest(count(r.id), 1)), 1.0) AS weight
 FROM t LEFT JOIN p ON p.context = t.context AND p.id = t.id LEFT JOIN r ON r.context = t.context AND r.id = t.id LEFT JOIN q ON q.context = t.context GROUP BY conv_id, turn, part)
SELECT c.conv_id, c.turn, c.n AS n_tokens, round(c.logp, 6) + 0.0 AS logp, round(c.k3, 6) + 0.0 AS k3, round(c.weight, 6) + 0.0 AS weight, round(least(greatest(c.n / 100.0, 1.0), 3.0) - 0.05 * c.kl, 6) + 0.0 AS clipped_reward,
 round(({sg('(c.logp - c.ref) / 100')} - 0.5) * c.logp, 6) + 0.0 AS nash, round(-{ls('0.01 * ((c.logp - p.logp) - (c.ref - p.ref))')} + 0.001 * c.ref, 6) + 0.0 AS xpo
FROM s c JOIN s p ON p.conv_id = c.conv_id AND p.turn = c.turn AND p.part = 'p' WHERE c.part = 'c'""")
def ls_token_sums(spark: SparkSession, d: str) -> DataFrame:
    """Rewards and losses of completions from masked sums over their tokens, under two models of the vocabulary."""
    policy, reference = models(spark, d)
    pairs, keys = token_pairs(spark, d), ["conv_id", "turn", "part"]
    tokens = [vocabulary.bigrams(pairs.withColumn("part", F.lit(c)), keys, c) for c in ("p", "c")]
    s = vocabulary.sequence_sums(tokens[0].unionByName(tokens[1]), keys, policy, reference)
    other = s.filter("part = 'p'").select("conv_id", "turn", F.col("logp").alias("other"), F.col("ref").alias("other_ref"))
    c = s.filter("part = 'c'").join(other, ["conv_id", "turn"])
    out = {
        "logp": F.col("logp"),
        "k3": F.col("k3"),
        "weight": F.col("weight"),
        "clipped_reward": vocabulary.clipped_reward(F.col("n") / 100.0, F.col("kl"), 1.0, 3.0, 0.05),
        "nash": vocabulary.nash_score(F.col("logp") / 100, F.col("ref") / 100, F.col("logp")),
        "xpo": -C.logsigmoid(0.01 * ((F.col("logp") - F.col("other")) - (F.col("ref") - F.col("other_ref")))) + 0.001 * F.col("ref"),
    }
    return c.select("conv_id", "turn", F.col("n").alias("n_tokens"), *rounded(out, 6))
