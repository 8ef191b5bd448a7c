"""Queries on preference pairs, scores and rewards; log-probabilities are made of lineitem's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions import scores as C
from loomframe.operators import sequences
from loomframe.operators.density import density_weights
from loomframe.plans.registry import query
from loomframe.plans.tables import table

KEYS = ("l_orderkey", "l_partkey", "l_linenumber")
LOGPS_SQL = """(SELECT l_orderkey, l_partkey, l_linenumber, -l_tax - 0.01 AS pc, -l_discount - 0.02 AS pr, -l_quantity / 100.0 AS rc, -l_tax * 2 - 0.05 AS rr,
  l_extendedprice / 10007.0 AS reward, l_quantity / 49.0 AS value, l_shipdate FROM lineitem)"""


def logps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        *KEYS,
        (-F.col("l_tax") - 0.01).alias("pc"),
        (-F.col("l_discount") - 0.02).alias("pr"),
        (-F.col("l_quantity") / 100.0).alias("rc"),
        (-F.col("l_tax") * 2 - 0.05).alias("rr"),
        (F.col("l_extendedprice") / 10007.0).alias("reward"),
        (F.col("l_quantity") / 49.0).alias("value"),
        "l_shipdate",
    )


def rounded(cols: dict[str, Column], n: int = 9) -> list[Column]:
    # zero for negative zero
    return [(F.round(c, n) + 0.0).alias(k) for k, c in cols.items()]


def ls(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN -ln(1 + exp(-({x}))) ELSE ({x}) - ln(1 + exp({x})) END)"


def sg(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def select_sql(cols: dict[str, str], source: str, keys: str = "l_orderkey, l_partkey, l_linenumber") -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({v}, 9) + 0.0 AS {k}" for k, v in cols.items()) + f" FROM {source}"


Z = "((pc - pr) - (rc - rr))"
BZ, LC, LR = f"(0.1 * {Z})", "(pc - rc)", "(pr - rr)"
PAIRWISE_SQL = {
    "sigmoid": f"-{ls(BZ)} * 0.9 - {ls('-' + BZ)} * 0.1",
    "robust": f"(-{ls(BZ)} * 0.9 + {ls('-' + BZ)} * 0.1) / 0.8",
    "exo_pair": f"{sg(BZ)} * ({ls(BZ)} - ln(0.9)) + {sg('-' + BZ)} * ({ls('-' + BZ)} - ln(0.1))",
    "hinge": f"greatest(1 - {BZ}, 0.0)",
    "ipo": f"({Z} - 5.0) * ({Z} - 5.0)",
    "bco_pair": f"-{ls(f'0.1 * {LC}')} - {ls(f'-(0.1 * {LR})')}",
    "sppo_hard": f"({LC} - 5.0) * ({LC} - 5.0) + ({LR} + 5.0) * ({LR} + 5.0)",
    "nca_pair": f"-{ls(f'0.1 * {LC}')} - 0.5 * {ls(f'-0.1 * {LC}')} - 0.5 * {ls(f'-0.1 * {LR}')}",
    "apo_zero": f"1 - {sg(f'0.1 * {LC}')} + {sg(f'0.1 * {LR}')}",
    "apo_down": f"{sg(f'0.1 * {LC}')} + 1 - {sg(f'0.1 * ({LC} - {LR})')}",
    "discopop": f"-{ls(BZ)} * (1 - {sg(f'{BZ} / 0.05')}) + exp(-{BZ}) * {sg(f'{BZ} / 0.05')}",
}


@query(select_sql(PAIRWISE_SQL, LOGPS_SQL))
def ls_pairwise(spark: SparkSession, d: str) -> DataFrame:
    shared = C.pairwise_terms(*[F.col(x) for x in ("pc", "pr", "rc", "rr")])
    c = C.pairwise(*[F.col(x) for x in ("lc", "lr", "z")])
    return logps(spark, d).select(*KEYS, *[v.alias(k) for k, v in shared.items()]).select(*KEYS, *rounded(c))


SP = lambda x: f"(-{ls(f'-({x})')})"
DIVERGENCE_SQL = {
    "alpha": "-" + ls(f"0.1 * ((exp(least(-0.5 * {LR}, 10.0)) - exp(least(-0.5 * {LC}, 10.0))) / 0.5)"),
    "js": "-" + ls(f"0.1 * (({LC} - {LR}) - ({SP(LC)} - {SP(LR)}))"),
    "weighted": f"0.7 * (-{ls(BZ)} * 0.9 - {ls('-' + BZ)} * 0.1) + 0.3 * greatest(1 - {BZ}, 0.0) + 0.5 * (-pc)",
}


@query(select_sql(DIVERGENCE_SQL, LOGPS_SQL))
def ls_divergence_and_weighted(spark: SparkSession, d: str) -> DataFrame:
    pc, pr, rc, rr = (F.col(x) for x in ("pc", "pr", "rc", "rr"))
    c = C.divergence(pc - rc, pr - rr)
    c["weighted"] = C.weighted_loss(C.pairwise(pc - rc, pr - rr, (pc - pr) - (rc - rr)), {"sigmoid": 0.7, "hinge": 0.3}, -pc, 0.5)
    return logps(spark, d).select(*KEYS, *rounded(c))


P = "(pc - pr)"
FREE_SQL = {
    "plain_sigmoid": "-" + ls(f"0.1 * {P}"),
    "plain_hinge": f"greatest(1 - 0.1 * {P}, 0.0)",
    "plain_ipo": f"({P} - 5.0) * ({P} - 5.0)",
    "simpo": "-" + ls(f"0.1 * ({P} - 5.0)"),
    "alphapo": "-" + ls("0.1 * ((1 - exp(-0.25 * pc)) / 0.25 - (1 - exp(-0.25 * pr)) / 0.25)"),
    "orpo_term": "0.1 * " + ls(f"{P} - (ln(1 - exp(pc)) - ln(1 - exp(pr)))"),
}


@query(select_sql(FREE_SQL, LOGPS_SQL))
def ls_reference_free(spark: SparkSession, d: str) -> DataFrame:
    return logps(spark, d).select(*KEYS, *rounded(C.reference_free(F.col("pc"), F.col("pr"))))


@query(f"""WITH k AS (SELECT greatest(avg(pc - rc), 0.0) AS kl FROM {LOGPS_SQL}), c AS (SELECT l_orderkey, l_partkey, l_linenumber, l_linenumber % 2 = 1 AS label, pc - rc AS l, kl FROM {LOGPS_SQL}, k)
SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN label THEN 1 - {sg('0.1 * (l - kl)')} ELSE 1.33 * (1 - {sg('0.1 * (kl - l)')}) END, 9) + 0.0 AS kto,
 round(CASE WHEN label THEN 1 - {sg('0.1 * l')} ELSE {sg('0.1 * l')} END, 9) + 0.0 AS apo_zero_unpaired, round(CASE WHEN label THEN -{ls('0.1 * l - 0.05')} ELSE -{ls('-(0.1 * l - 0.05)')} END, 9) + 0.0 AS bco FROM c""")
def ls_unpaired(spark: SparkSession, d: str) -> DataFrame:
    base = logps(spark, d).select(*KEYS, (F.col("l_linenumber") % 2 == 1).alias("label"), (F.col("pc") - F.col("rc")).alias("l"))
    kl = base.agg(F.greatest(F.avg("l"), F.lit(0.0)).alias("kl"))
    c, ll, k = base.join(F.broadcast(kl)), F.col("l"), F.col("kl")
    y = F.col("label")
    s, g = C.sigmoid, C.logsigmoid
    return c.select(
        *KEYS,
        *rounded(
            {
                "kto": F.when(y, 1 - s(0.1 * (ll - k))).otherwise(1.33 * (1 - s(0.1 * (k - ll)))),
                "apo_zero_unpaired": F.when(y, 1 - s(0.1 * ll)).otherwise(s(0.1 * ll)),
                "bco": F.when(y, -g(0.1 * ll - 0.05)).otherwise(-g(-(0.1 * ll - 0.05))),
            }
        ),
    )


@query(f"""WITH t AS (SELECT *, l_orderkey // 64 AS batch, l_linenumber % 2 = 1 AS label FROM {LOGPS_SQL}),
b AS (SELECT batch, sum(0.1 * (pc - rc)) AS s, sum(0.1 * (pc - rc) + 0.1 * (pr - rr)) AS p, count(*) AS n FROM t GROUP BY batch),
d AS (SELECT batch, sum(s) OVER w / sum(n) OVER w AS delta, sum(p) OVER w / (2 * sum(n) OVER w) AS pair_delta FROM b WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, l_partkey, l_linenumber, round(delta, 9) + 0.0 AS delta, round(CASE WHEN label THEN -{ls(f'0.1 * {LC} - delta')} ELSE -{ls(f'-(0.1 * {LC} - delta)')} END, 9) + 0.0 AS bco,
 round(-{ls(f'0.1 * {LC} - pair_delta')} - {ls(f'-(0.1 * {LR} - pair_delta)')}, 9) + 0.0 AS bco_pair FROM t JOIN d USING (batch)""")
def ls_running_delta(spark: SparkSession, d: str) -> DataFrame:
    """Losses against the running mean of rewards over the batches so far, unpaired and paired."""
    lc, lr = F.col("pc") - F.col("rc"), F.col("pr") - F.col("rr")
    t = logps(spark, d).withColumn("batch", F.floor(F.col("l_orderkey") / 64))
    t = sequences.running_delta(t, "batch", 0.1 * lc)
    t = sequences.running_delta(t, "batch", (0.1 * lc + 0.1 * lr) / 2, "pair_delta")
    gap = 0.1 * lc - F.col("delta")
    bco = F.when(F.col("l_linenumber") % 2 == 1, -C.logsigmoid(gap)).otherwise(-C.logsigmoid(-gap))
    pair = C.pairwise(lc, lr, lc - lr, delta=F.col("pair_delta"))["bco_pair"]
    return t.select(*KEYS, *rounded({"delta": F.col("delta"), "bco": bco, "bco_pair": pair}))


@query()
def ls_weighted_bco(spark: SparkSession, d: str) -> DataFrame:
    """Unpaired losses with the running delta, undesired rows weighed by how like desired ones their vectors are."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).alias("desired"), F.get("embedding", F.lit(0)).cast("double").alias("l"))
    e = density_weights(e, "embedding", "desired").withColumn("batch", F.floor(F.col("vec_id") / 32))
    e = sequences.running_delta(e, "batch", 0.1 * F.col("l"))
    gap = 0.1 * F.col("l") - F.col("delta")
    loss = F.when(F.col("desired"), -C.logsigmoid(gap)).otherwise(-C.logsigmoid(-gap) * F.col("weight"))
    return e.select("vec_id", *rounded({"weight": F.col("weight"), "delta": F.col("delta"), "loss": loss}))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, round(-{ls('pc - pr - 0.1')} + 0.01 * (pc + pr) * (pc + pr), 9) + 0.0 AS loss, pc > pr AS correct FROM {LOGPS_SQL}")
def ls_reward_model(spark: SparkSession, d: str) -> DataFrame:
    pc, pr = F.col("pc"), F.col("pr")
    return logps(spark, d).select(*KEYS, *rounded({"loss": -C.logsigmoid(pc - pr - 0.1) + 0.01 * (pc + pr) * (pc + pr)}), (pc > pr).alias("correct"))


@query(f"SELECT round(avg(pc), 9) AS chosen, round(avg(pr), 9) AS rejected, round(avg((pc > pr)::INT), 9) AS accuracy, round(avg(pc - pr), 9) AS margin, min(pc) AS low, max(pc) AS high, round(sum(pc) / count(pc) - sum(pr) / count(pr), 9) AS weighted_margin FROM {LOGPS_SQL}")
def agg_preference_metrics(spark: SparkSession, d: str) -> DataFrame:
    pc, pr = F.col("pc"), F.col("pr")
    r = lambda c, n: F.round(c, 9).alias(n)
    return logps(spark, d).agg(
        r(F.avg(pc), "chosen"), r(F.avg(pr), "rejected"), r(F.avg((pc > pr).cast("int")), "accuracy"), r(F.avg(pc - pr), "margin"),
        F.min(pc).alias("low"), F.max(pc).alias("high"), r(F.sum(pc) / F.count(pc) - F.sum(pr) / F.count(pr), "weighted_margin"),
    )


RATIO = "exp(pc - rc)"
ADV = "(reward - 3)"
RATIO_SQL = {
    "objective": f"-least({RATIO} * {ADV}, least(greatest({RATIO}, 0.8), 1.2) * {ADV})",
    "capped": f"-least(least({RATIO}, 1.1) * {ADV}, least(greatest({RATIO}, 0.8), 1.2) * {ADV})",
    "k3": "exp(rc - pc) - (rc - pc) - 1",
    "k1": "pc - rc",
    "importance": "least(exp(pc - pr), 1.05)",
    "kl_reward": "least(greatest(reward, 1.0), 8.0) - 0.1 * (exp(rc - pc) - 1 - (rc - pc))",
    "nash": f"({sg('pc - pr')} - 0.5) * pc",
    "xpo": f"-{ls(BZ)} + 0.01 * rc",
}


@query(select_sql(RATIO_SQL, LOGPS_SQL))
def ls_ratio_and_kl(spark: SparkSession, d: str) -> DataFrame:
    pc, pr, rc, rr, adv = F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"), F.col("reward") - 3
    z = (pc - pr) - (rc - rr)
    return logps(spark, d).select(
        *KEYS,
        *rounded(
            {
                "objective": C.ratio_objective(pc, rc, adv),
                "capped": C.ratio_objective(pc, rc, adv, cap=1.1),
                "k3": C.k3(rc, pc),
                "k1": pc - rc,
                "importance": F.least(F.exp(pc - pr), F.lit(1.05)),
                "kl_reward": C.clamp(F.col("reward"), 1.0, 8.0) - 0.1 * C.k3(rc, pc),
                "nash": (C.sigmoid(pc - pr) - 0.5) * pc,
                "xpo": -C.logsigmoid(0.1 * z) + 0.01 * rc,
            }
        ),
    )


@query(f"""SELECT l_orderkey, round(avg(({RATIO} < 0.8 AND {ADV} < 0)::INT), 9) AS low_clip, round(avg(({RATIO} > 1.2 AND {ADV} > 0)::INT), 9) AS high_clip FROM {LOGPS_SQL} GROUP BY l_orderkey""")
def ls_clip_ratios(spark: SparkSession, d: str) -> DataFrame:
    ratio, adv = F.exp(F.col("pc") - F.col("rc")), F.col("reward") - 3
    return logps(spark, d).groupBy("l_orderkey").agg(
        F.round(F.avg(((ratio < 0.8) & (adv < 0)).cast("int")), 9).alias("low_clip"), F.round(F.avg(((ratio > 1.2) & (adv > 0)).cast("int")), 9).alias("high_clip")
    )


@query("SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(0.5 * CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END, 0) + coalesce(2 * l_discount, 0) - CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END, 9) AS reward, (l_returnflag = 'R') AS missing FROM lineitem")
def ls_combined_reward(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    total = C.null_skipping_sum([(0.5, given), (2.0, F.col("l_discount"))]) - F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return table(spark, d, "lineitem").select(*KEYS, F.round(total, 9).alias("reward"), given.isNull().alias("missing"))


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 0.0001), 9) + 0.0 AS advantage, round(reward - avg(reward) OVER w, 9) + 0.0 AS centred,
 round(CASE WHEN count(*) OVER w > 1 THEN reward - (sum(reward) OVER w - reward) / (count(*) OVER w - 1) END, 9) + 0.0 AS loo, abs(stddev_samp(reward) OVER w) <= 1e-8 AS flat FROM {LOGPS_SQL} WINDOW w AS (PARTITION BY l_orderkey)""")
def win_group_advantage(spark: SparkSession, d: str) -> DataFrame:
    df, r = logps(spark, d), F.col("reward")
    flat = F.abs(F.stddev_samp(r).over(Window.partitionBy("l_orderkey"))) <= 1e-8
    cols = {"advantage": sequences.group_advantage(df, "l_orderkey", r), "centred": sequences.group_advantage(df, "l_orderkey", r, scaled=False), "loo": sequences.leave_one_out("l_orderkey", r)}
    return df.select(*KEYS, *rounded(cols), flat.alias("flat"))


@query(f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER w AS t, count(*) OVER (PARTITION BY l_orderkey) AS n, lead(value) OVER w AS nv FROM {LOGPS_SQL} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, reward, value, pc, pr)),
x AS (SELECT *, reward + 0.99 * coalesce(nv, 0.0) - value AS d FROM t),
a AS (SELECT l_orderkey, t, d AS adv FROM x WHERE t = n UNION ALL SELECT x.l_orderkey, x.t, x.d + 0.99 * 0.95 * a.adv FROM x JOIN a ON a.l_orderkey = x.l_orderkey AND a.t = x.t + 1)
SELECT x.l_orderkey, l_partkey, l_linenumber, round(adv, 9) + 0.0 AS advantage, round(adv + value, 9) + 0.0 AS returns FROM x JOIN a ON a.l_orderkey = x.l_orderkey AND a.t = x.t""")
def win_gae(spark: SparkSession, d: str) -> DataFrame:
    g = sequences.gae(logps(spark, d), "l_orderkey", ["l_linenumber", "l_partkey", "reward", "value", "pc", "pr"], "reward", "value", 0.99, 0.95)
    return g.select(*KEYS, *rounded({"advantage": F.col("advantage"), "returns": F.col("returns")}))


@query(f"""WITH RECURSIVE t AS (SELECT l_orderkey, l_partkey, l_linenumber, reward + 0.5 * coalesce(lead(value) OVER w, 0.0) - value AS d, row_number() OVER w AS t FROM {LOGPS_SQL} WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, reward, value, pc, pr)),
-- terms beyond 60 steps are below 1e-27 of the sum
k AS (SELECT range AS j FROM range(60)),
a AS (SELECT t.t, sum(x.d * 0.35 ** j) AS adv FROM t JOIN k ON true JOIN t x ON x.t = t.t + j GROUP BY t.t)
SELECT l_orderkey, l_partkey, l_linenumber, round(adv, 7) + 0.0 AS advantage FROM t JOIN a ON a.t = t.t""")
def win_gae_whole(spark: SparkSession, d: str) -> DataFrame:
    """The whole table is one trajectory."""
    t = logps(spark, d).select(F.lit(0).alias("run"), *KEYS, "reward", "value", "pc", "pr")
    g = sequences.gae(t, "run", ["l_orderkey", "l_linenumber", "l_partkey", "reward", "value", "pc", "pr"], "reward", "value", 0.5, 0.7)
    return g.select(*KEYS, *rounded({"advantage": F.col("advantage")}, 7))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, round((reward - m) / sqrt(v + 1e-8), 9) + 0.0 AS white, round((reward - m) / sqrt(v + 1e-8) + m, 9) + 0.0 AS shifted FROM {LOGPS_SQL}, (SELECT avg(reward) AS m, var_samp(reward) AS v FROM {LOGPS_SQL})")
def win_whiten(spark: SparkSession, d: str) -> DataFrame:
    df = logps(spark, d)
    white = (F.col("reward") - F.col("m")) / F.sqrt(F.col("v") + 1e-8)
    return df.join(F.broadcast(df.agg(F.avg("reward").alias("m"), F.var_samp("reward").alias("v")))).select(*KEYS, *rounded({"white": white, "shifted": white + F.col("m")}))


@query(f"""WITH b AS (SELECT l_orderkey, pc - pr + 0.0 AS c, rc - rr + 0.0 AS r, pc - rc + 0.0 AS lc, pr - rr + 0.0 AS lr FROM {LOGPS_SQL}),
x AS (SELECT l_orderkey, c, row_number() OVER (PARTITION BY l_orderkey ORDER BY c) AS rank FROM b), y AS (SELECT l_orderkey, r, row_number() OVER (PARTITION BY l_orderkey ORDER BY r) AS rank FROM b)
SELECT x.l_orderkey, x.rank::INT AS rank, round(-{ls('0.1 * (c - r)')}, 9) + 0.0 AS aot FROM x JOIN y ON x.l_orderkey = y.l_orderkey AND x.rank = y.rank""")
def jn_rank_aligned(spark: SparkSession, d: str) -> DataFrame:
    b = logps(spark, d).select("l_orderkey", (F.col("pc") - F.col("pr")).alias("c"), (F.col("rc") - F.col("rr")).alias("r"))
    a = sequences.rank_align(b, "l_orderkey", "c", "r")
    return a.select("l_orderkey", "rank", *rounded({"aot": -C.logsigmoid(0.1 * (F.col("c") - F.col("r")))}))


@query(f"""WITH b AS (SELECT pc - pr + 0.0 AS c, rc - rr + 0.0 AS r FROM {LOGPS_SQL}), x AS (SELECT c, row_number() OVER (ORDER BY c) AS rank FROM b), y AS (SELECT r, row_number() OVER (ORDER BY r) AS rank FROM b)
SELECT x.rank::INT AS rank, c, r, round(-{ls('0.1 * (c - r)')}, 9) + 0.0 AS aot FROM x JOIN y ON x.rank = y.rank""")
def jn_rank_aligned_whole(spark: SparkSession, d: str) -> DataFrame:
    """The whole table is one batch."""
    b = logps(spark, d).select(F.lit(0).alias("batch"), (F.col("pc") - F.col("pr")).alias("c"), (F.col("rc") - F.col("rr")).alias("r"))
    a = sequences.rank_align(b, "batch", "c", "r")
    return a.select("rank", "c", "r", *rounded({"aot": -C.logsigmoid(0.1 * (F.col("c") - F.col("r")))}))


@query(f"""WITH b AS (SELECT l_orderkey, pc - rc + 0.0 AS c, pr - rr + 0.0 AS r FROM {LOGPS_SQL}),
x AS (SELECT l_orderkey, c, row_number() OVER (PARTITION BY l_orderkey ORDER BY c) AS rank FROM b), y AS (SELECT l_orderkey, r, row_number() OVER (PARTITION BY l_orderkey ORDER BY r) AS rank FROM b)
SELECT x.l_orderkey, x.rank::INT AS rank, round(-{ls('0.1 * (c - r)')}, 9) + 0.0 AS aot_pair FROM x JOIN y ON x.l_orderkey = y.l_orderkey AND x.rank = y.rank""")
def ls_aot_pair(spark: SparkSession, d: str) -> DataFrame:
    b = logps(spark, d).select("l_orderkey", (F.col("pc") - F.col("rc")).alias("c"), (F.col("pr") - F.col("rr")).alias("r"))
    a = sequences.rank_align(b, "l_orderkey", "c", "r")
    return a.select("l_orderkey", "rank", *rounded({"aot_pair": -C.logsigmoid(0.1 * (F.col("c") - F.col("r")))}))


@query("""WITH r AS (SELECT d.doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY d.doc_id) AS k FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT a.lang, a.k::INT AS k, a.doc_id AS chosen, b.doc_id AS rejected FROM r a JOIN r b ON a.lang = b.lang AND a.k = b.k WHERE a.quality = 1 AND b.quality = 0""")
def jn_preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang", "quality").orderBy("doc_id")
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("k", F.row_number().over(w))
    good = r.filter("quality = 1").select("lang", "k", F.col("doc_id").alias("chosen"))
    return good.join(r.filter("quality = 0").select("lang", "k", F.col("doc_id").alias("rejected")), ["lang", "k"])


@query("""WITH r AS (SELECT d.doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY d.doc_id) AS k FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
p AS (SELECT a.lang, a.k, a.doc_id AS c, b.doc_id AS x FROM r a JOIN r b ON a.lang = b.lang AND a.k = b.k WHERE a.quality = 1 AND b.quality = 0)
SELECT c AS doc_id, true AS label FROM p UNION ALL SELECT x, false FROM p""")
def set_unpair(spark: SparkSession, d: str) -> DataFrame:
    pairs = jn_preference_pairs(spark, d)
    both = F.inline(F.array(F.struct(F.col("chosen").alias("doc_id"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("doc_id"), F.lit(False).alias("label"))))
    return pairs.select(both)


@query("""WITH b AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT a.conv_id, a.turn, md5(a.text || '|' || b.text) AS pair FROM b a JOIN b ON a.conv_id = b.conv_id AND a.p = b.n + 1 - b.p""")
def jn_mismatched(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    b = table(spark, d, "conversations").select("conv_id", "turn", "text", F.row_number().over(w.orderBy("turn")).alias("p"), F.count(F.lit(1)).over(w).alias("n"))
    other = b.select("conv_id", (F.col("n") + 1 - F.col("p")).cast("int").alias("p"), F.col("text").alias("other"))
    return b.join(other, ["conv_id", "p"]).select("conv_id", "turn", F.md5(F.concat_ws("|", "text", "other")).alias("pair"))


@query("SELECT l_orderkey, l_partkey, CASE WHEN l_tax >= l_discount THEN 'first' ELSE 'second' END AS best, greatest(l_tax, l_discount) AS score, CASE WHEN ('0x' || substr(md5('g|' || l_orderkey), 1, 8))::BIGINT / 4294967296.0 <= 0.3 THEN l_tax ELSE l_discount END AS mixed FROM lineitem")
def srt_best_of_two(spark: SparkSession, d: str) -> DataFrame:
    from loomframe.functions.text import unit_hash

    a, b = F.col("l_tax"), F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.when(a >= b, "first").otherwise("second").alias("best"), F.greatest(a, b).alias("score"), F.when(unit_hash(F.lit("g"), F.col("l_orderkey")) <= 0.3, a).otherwise(b).alias("mixed"))


@query()
def ls_udm_weight(spark: SparkSession, d: str) -> DataFrame:
    """Density-ratio weights from a logistic model on embeddings, with balanced classes."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).alias("desired"))
    return density_weights(e, "embedding", "desired").select("vec_id", "weight")
