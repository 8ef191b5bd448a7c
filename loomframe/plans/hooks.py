"""Queries through users' functions of columns, and token pairs cut to a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import scores as C
from loomframe.functions import tokens as K
from loomframe.operators import chat, hooks, subwords
from loomframe.plans.corpus import PAIRS_SQL
from loomframe.plans.registry import query
from loomframe.plans.sequences import TOKENS_SQL, joined, token_pairs
from loomframe.plans.subwords_sql import with_ids
from loomframe.plans.tables import table


@query("""SELECT event_id, CASE WHEN regexp_matches(event_type, '^(click|view)$') THEN 'look' WHEN regexp_matches(event_type, 'pur|sign') THEN 'act' ELSE 'other' END AS rule FROM events""")
def flt_first_rule(spark: SparkSession, d: str) -> DataFrame:
    rule = hooks.first_rule(F.col("event_type"), [("^(click|view)$", F.lit("look")), ("pur|sign", F.lit("act"))], F.lit("other"))
    return table(spark, d, "events").select("event_id", rule.alias("rule"))


@query(f"""WITH r AS (SELECT conv_id, turn, CASE WHEN length(completion) > 200 THEN length(completion) / 1000.0 END AS long_answer, CASE WHEN starts_with(completion, upper(completion[1])) THEN 1.0 END AS opening FROM {PAIRS_SQL})
SELECT conv_id, turn, long_answer, opening, coalesce(0.5 * long_answer, 0) + coalesce(2.0 * opening, 0) AS reward, (long_answer IS NULL AND opening IS NULL) AS unrewarded FROM r""")
def udf_rewards(spark: SparkSession, d: str) -> DataFrame:
    pairs, c = chat.chat_pairs(table(spark, d, "conversations")), F.col("completion")
    rewards = {
        "long_answer": lambda df: F.when(F.length(c) > 200, F.length(c) / 1000.0),
        "opening": lambda df: F.when(c.startswith(F.upper(F.substring(c, 1, 1))), F.lit(1.0)),
    }
    return hooks.with_rewards(pairs, rewards, {"long_answer": 0.5, "opening": 2.0}).select("conv_id", "turn", *rewards, "reward", "unrewarded")


@query(f"""SELECT conv_id, turn, CASE WHEN length(completion) >= length(prompt) THEN completion ELSE prompt END AS chosen, CASE WHEN length(completion) >= length(prompt) THEN prompt ELSE completion END AS rejected FROM {PAIRS_SQL}""")
def udf_judge(spark: SparkSession, d: str) -> DataFrame:
    pairs = chat.chat_pairs(table(spark, d, "conversations"))
    return hooks.judged(pairs, "completion", "prompt", lambda a, b: F.length(a) >= F.length(b)).select("conv_id", "turn", "chosen", "rejected")


@query("SELECT l_returnflag, round(avg((l_tax >= l_discount)::INT), 6) AS eval_accuracy, count(*) AS eval_n, round(quantile_cont(l_quantity, 0.8), 6) AS eval_q80 FROM lineitem GROUP BY l_returnflag")
def udf_metrics(spark: SparkSession, d: str) -> DataFrame:
    compute = {
        "accuracy": lambda df: F.round(F.avg((df.l_tax >= df.l_discount).cast("int")), 6),
        "n": lambda df: F.count(F.lit(1)),
        "q80": lambda df: F.round(F.percentile(df.l_quantity, 0.8), 6),
    }
    return hooks.metrics(table(spark, d, "lineitem"), ["l_returnflag"], compute)


@query(f"""SELECT conv_id, turn, 0 AS place, prompt || chr(10) || completion AS text FROM {PAIRS_SQL} UNION ALL SELECT conv_id, turn, 1, '[INST] ' || prompt || ' [/INST]' FROM {PAIRS_SQL}""")
def udf_formats(spark: SparkSession, d: str) -> DataFrame:
    pairs = chat.chat_pairs(table(spark, d, "conversations"))
    return hooks.formatted(pairs, lambda df: F.array(F.concat(df.prompt, F.lit("\n"), df.completion), F.concat(F.lit("[INST] "), df.prompt, F.lit(" [/INST]"))), ["conv_id", "turn"])


@query(f"""SELECT conv_id, turn, CASE WHEN CAST(('0x' || substr(md5('g|' || conv_id || '|' || turn), 1, 8)) AS BIGINT) / 4294967296.0 <= 0.3 THEN prompt ELSE completion END AS completion FROM {PAIRS_SQL}""")
def srt_sometimes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("completion")
    return chat.chat_pairs(table(spark, d, "conversations")).select("conv_id", "turn", hooks.sometimes(0.3, F.col("prompt"), c, F.lit("g"), F.col("conv_id"), F.col("turn")).alias("completion"))


@query(f"""WITH t AS (SELECT conv_id, turn, substr(prompt, 1, length(prompt) - turn % 3) AS head, substr(prompt, length(prompt) - turn % 3 + 1) || completion AS tail FROM {PAIRS_SQL}),
a AS (SELECT *, CASE WHEN f[1:len(p)] = p THEN len(p) ELSE greatest(len(p) - 1, 0) END AS k FROM {with_ids('t', p='head', f='head || tail')})
SELECT conv_id, turn, array_to_string(f[1:k], ',') AS prompt_ids, array_to_string(f[k + 1:], ',') AS answer_ids FROM a""")
def tok_split_at_prompt(spark: SparkSession, d: str) -> DataFrame:
    # some prompts end within a word, whose tokens may change when the rest of it is joined
    ids = subwords.encoder(subwords.vocabulary(spark))
    whole = F.concat("prompt", "completion")
    head = F.substring("prompt", F.lit(1), (F.length("prompt") - F.col("turn") % 3).cast("int"))
    t = chat.chat_pairs(table(spark, d, "conversations")).select("conv_id", "turn", ids(whole).alias("full"), ids(head).alias("p"))
    t = t.select("conv_id", "turn", K.split_at_prompt(F.col("full"), F.col("p")).alias("s"))
    return t.select("conv_id", "turn", *joined(prompt_ids=F.col("s.prompt"), answer_ids=F.col("s.answer")))


@query(f"""WITH a AS (SELECT conv_id, turn, c, CASE WHEN len(p) + len(c) > 300 THEN p[greatest(len(p) - 63, 1):] ELSE p END AS e, CASE WHEN len(p) + len(c) > 300 THEN p[1:64] ELSE p END AS s FROM {TOKENS_SQL})
SELECT conv_id, turn, array_to_string(e, ',') AS end_prompt, array_to_string(CASE WHEN len(e) + len(c) > 300 THEN c[1:236] ELSE c END, ',') AS end_answer,
 array_to_string(s, ',') AS start_prompt, array_to_string(CASE WHEN len(s) + len(c) > 300 THEN c[1:236] ELSE c END, ',') AS start_answer FROM a""")
def tok_fit_pair(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("p"), F.col("c")
    t = token_pairs(spark, d).select("conv_id", "turn", K.fit_pair(p, c, 300, 64, "keep_end").alias("e"), K.fit_pair(p, c, 300, 64, "keep_start").alias("s"))
    return t.select("conv_id", "turn", *joined(end_prompt=F.col("e.prompt"), end_answer=F.col("e.answer"), start_prompt=F.col("s.prompt"), start_answer=F.col("s.answer")))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, round(least(exp((-l_tax + l_discount + CASE WHEN l_returnflag = 'R' THEN -l_quantity / 50 + 0.2 ELSE 0 END) / CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END + (-l_discount + 0.05)), 1.0), 6) AS weight FROM lineitem""")
def ls_policy_weight(spark: SparkSession, d: str) -> DataFrame:
    t, disc, q = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    on = (F.col("l_returnflag") == "R").cast("int")
    weight = C.policy_weight([F.array(-t, -q / 50), F.array(-disc)], [F.array(-disc, F.lit(-0.2)), F.array(F.lit(-0.05))], [F.array(F.lit(1), on), F.array(F.lit(1))])
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(weight, 6).alias("weight"))
