"""Queries on columns chosen by name, further scopes of rewards and losses, masks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions import scores as C
from loomframe.functions import text as X
from loomframe.functions import tokens as K
from loomframe.operators import chat, columns, sequences, subwords
from loomframe.plans.corpus import PAIRS_SQL
from loomframe.plans.preference import KEYS, LOGPS_SQL, logps, ls, rounded, sg
from loomframe.plans.registry import query
from loomframe.plans.sequences import COMMA, ENDED, ENDS, STOP, TOKENS_SQL, TURNS_SQL, joined, token_pairs, token_turns
from loomframe.plans.tables import table
from loomframe.sources.shared import scratch_path


@query("SELECT event_id AS input_ids, user_id AS labels FROM events")
def tok_signature(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a reader's signature, in its order."""
    e = table(spark, d, "events").select(F.col("user_id").alias("labels"), "event_type", F.col("event_id").alias("input_ids"))
    return columns.keep_signature(e)


@query("SELECT doc_id, n_chars, 1 AS chosen_ids, 2 AS rejected_ids, lang AS kept FROM documents")
def prj_drop_if_all(spark: SparkSession, d: str) -> DataFrame:
    """A set of columns goes if all of another set are there; nothing goes if one lacks."""
    t = table(spark, d, "documents").select("doc_id", "n_chars", F.col("lang").alias("kept"), F.lit("x").alias("chosen"), F.lit(1).alias("chosen_ids"), F.lit(2).alias("rejected_ids"))
    t = columns.drop_if_all(t, ["chosen"], ["chosen_ids", "rejected_ids"])
    return columns.drop_if_all(t, ["kept"], ["chosen_ids", "prompt_ids"])


@query(f"SELECT conv_id, turn, len(p)::INT AS n_tokens, len(p)::INT AS n_given FROM {TOKENS_SQL}")
def tok_skip_if_given(spark: SparkSession, d: str) -> DataFrame:
    """Tokens are made where the table has none and left alone where it has."""
    t = chat.chat_pairs(table(spark, d, "conversations"))
    ids = subwords.encoder(subwords.vocabulary(spark))
    make = lambda df: ids(df.prompt)
    made = columns.tokenized(t, make)
    again = columns.tokenized(made, lambda df: F.array().cast("array<int>"))
    return again.select("conv_id", "turn", F.size("input_ids").alias("n_tokens"), F.size(columns.tokenized(again, make)["input_ids"]).alias("n_given"))


@query(f"SELECT conv_id, prompt AS chosen_prompt, completion AS chosen_completion, turn FROM {PAIRS_SQL}")
def prj_prefixed(spark: SparkSession, d: str) -> DataFrame:
    return columns.prefixed(chat.chat_pairs(table(spark, d, "conversations")), ["prompt", "completion"], "chosen_")


@query("""SELECT conv_id, string_agg(CASE WHEN role <> 'system' THEN role || ':' || coalesce(nullif(substr(text, 1, 1), 'T'), '-') END, ',' ORDER BY turn) AS kept, count(*) FILTER (role <> 'system') AS n FROM conversations GROUP BY conv_id""")
def prj_strip_nested_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Null elements go from arrays of structs; a struct's null fields stay."""
    first = F.nullif(F.substring("text", 1, 1), F.lit("T"))
    turn = F.when(F.col("role") != "system", F.struct("role", first.alias("first")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("m")))).alias("g"))
    g = g.select("conv_id", F.transform("g", lambda x: x["m"]).alias("m"))
    clean = columns.without_nulls(F.col("m"), g.schema["m"].dataType)
    shown = F.array_join(F.transform(clean, lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["first"], F.lit("-")))), ",")
    return g.select("conv_id", F.nullif(shown, F.lit("")).alias("kept"), F.size(clean).cast("long").alias("n"))


@query(f"""WITH t AS (SELECT conv_id, turn, prompt || ' ' || completion AS c, prompt || ' ' || reverse(completion) AS r FROM {PAIRS_SQL}),
n AS (SELECT *, coalesce((SELECT min(i) - 1 FROM range(1, least(length(c), length(r)) + 1) g(i) WHERE substr(c, i, 1) <> substr(r, i, 1)), least(length(c), length(r))) AS n FROM t),
m AS (SELECT *, CASE WHEN n < least(length(c), length(r)) AND n > 0 AND substr(c, n, 1) = ' ' THEN n - 1 ELSE n END AS m FROM n)
SELECT conv_id, turn, substr(c, 1, m) AS prompt, substr(c, m + 1) AS chosen, substr(r, m + 1) AS rejected FROM m""")
def prj_shared_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = chat.chat_pairs(table(spark, d, "conversations"))
    s = X.shared_prompt(F.concat("prompt", F.lit(" "), "completion"), F.concat("prompt", F.lit(" "), F.reverse("completion")))
    return p.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.*")


@query(f"""WITH t AS (SELECT conv_id, turn, 'x COMMAND: ' || prompt || chr(10) || 'y' AS o FROM {PAIRS_SQL})
SELECT conv_id, turn, split_part(split_part(o, 'COMMAND: ', 2), chr(10), 1) AS expected, CASE WHEN turn % 2 = 0 THEN trim(split_part(split_part(o, 'COMMAND: ', 2), chr(10), 1)) ELSE 'x' END AS predicted FROM t""")
def scl_expected_command(spark: SparkSession, d: str) -> DataFrame:
    """The gold command is not trimmed, a predicted one is; without a tag the first line is the prediction."""
    t = chat.chat_pairs(table(spark, d, "conversations")).withColumn("o", F.concat(F.lit("x COMMAND: "), "prompt", F.lit("\ny")))
    answer = F.when(F.col("turn") % 2 == 0, F.col("o")).otherwise(F.lit(" x \nCOMMAND:"))
    return t.select("conv_id", "turn", X.expected_command(F.col("o")).alias("expected"), X.command_of(answer).alias("predicted"))


@query("""SELECT event_id, round_even(value::DECIMAL(18, 9), 2)::DECIMAL(18, 2)::VARCHAR AS two, round_even((user_id / 150.0)::DECIMAL(18, 9) * 100, 0)::BIGINT || '%' AS share, round_even((user_id / 150.0)::DECIMAL(18, 9) * 100, 1)::DECIMAL(18, 1) || '%' AS fine, round(event_id * 1.0 / 1048576, 2) AS mib FROM events""")
def scl_number_formats(spark: SparkSession, d: str) -> DataFrame:
    share = F.round(F.col("user_id") / 150.0, 9)
    return table(spark, d, "events").select("event_id", X.two_places(F.round("value", 9)).alias("two"), X.percent(share).alias("share"), X.percent(share, 1).alias("fine"), X.mebibytes(F.col("event_id")).alias("mib"))


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(c, lambda x: CASE WHEN {ENDED} THEN 1 ELSE 0 END), ',') AS mask,
 array_to_string(list_transform(c, lambda x, i: CASE WHEN i = len(p) % greatest(len(c), 1) + 1 THEN x + 100 ELSE x END), ',') AS scored FROM {TOKENS_SQL}""")
def tok_masks_of_cut_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that were cut off keep no token in their mask; a score is added at one position only."""
    t, c = token_pairs(spark, d), F.col("c")
    mask = K.mask_cut(F.transform(c, lambda x: F.lit(1)), K.cut_off(c, ENDS))
    scored = K.add_at(c, F.size("p") % F.greatest(F.size("c"), F.lit(1)), F.lit(100))
    return t.select("conv_id", "turn", *joined(mask=mask, scored=scored))


@query(f"""WITH m AS (SELECT *, list_transform(p, lambda x: (x % 2)) AS m FROM {TOKENS_SQL})
SELECT conv_id, turn, array_to_string(list_transform(m, lambda x, i: CASE WHEN x = 1 THEN coalesce(c[list_sum(m[1:i])::INT], -1) ELSE 0 END), ',') AS scattered,
 array_to_string(list_concat(list_filter(p, lambda x: x <> {COMMA}), list_filter(p, lambda x: x = {COMMA}))[1:12], ',') AS flushed FROM m""")
def tok_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Values at the ones of a mask; padding moved right and the rest cut."""
    t = token_pairs(spark, d)
    mask = F.transform("p", lambda x: x % 2)
    out = F.transform(K.scatter(mask, F.concat("c", F.array_repeat(F.lit(-1), F.size("p"))), 0.0), lambda x: x.cast("int"))
    return t.select("conv_id", "turn", *joined(scattered=out, flushed=K.flush_left(F.col("p"), COMMA, 12)))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM {TURNS_SQL}),
f AS (SELECT conv_id, flatten(list(list_append(s, -3) ORDER BY turn) FILTER (k > 1)) AS a, flatten(list(list_concat(list_transform(s, lambda x: -100), [CASE WHEN k < n THEN -100 WHEN role = 'assistant' THEN 1 ELSE 0 END]) ORDER BY turn) FILTER (k > 1)) AS y, first(s) FILTER (k = 1) AS p FROM n GROUP BY conv_id)
SELECT conv_id, array_to_string(list_concat(p[greatest(len(p) - 15, 1):], coalesce(a, [])[1:40])[1:48], ',') AS ids, array_to_string(list_concat(list_transform(p[greatest(len(p) - 15, 1):], lambda x: -100), coalesce(y, [])[1:40])[1:48], ',') AS labels FROM f""")
def tok_step_examples(spark: SparkSession, d: str) -> DataFrame:
    """Steps closed by a separator, the last one labelled, all cut to their limits."""
    g = token_turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s", (F.col("role") == "assistant").alias("y")))).alias("g"))
    later = F.slice("g", F.lit(2), F.size("g"))
    e = K.step_example(F.get("g", F.lit(0))["s"], F.transform(later, lambda x: x["s"]), F.transform(later, lambda x: x["y"]), -3, 16, 40, 48, last_only=True)
    return g.select("conv_id", e.alias("e")).select("conv_id", *joined(ids=F.col("e.ids"), labels=F.col("e.labels")))


@query("""WITH a AS (SELECT l_orderkey AS k, l_partkey AS q, l_linenumber AS n, [-l_tax, -l_discount, -l_quantity / 50.0] AS p, [CASE WHEN l_returnflag = 'R' THEN -100 ELSE 1 END, 2, CASE WHEN l_linestatus = 'O' THEN -100 ELSE 3 END] AS y FROM lineitem),
b AS (SELECT *, list_filter(list_transform(p, lambda x, i: CASE WHEN y[i] <> -100 THEN x END), lambda x: x IS NOT NULL) AS z FROM a)
SELECT k, q, n, round(list_sum(z), 6) + 0.0 AS total, round(list_sum(z) / len(z), 6) + 0.0 AS mean FROM b""")
def tok_sequence_logprob(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    p = F.array(-F.col("l_tax"), -F.col("l_discount"), -F.col("l_quantity") / 50.0)
    y = F.array(F.when(F.col("l_returnflag") == "R", -100).otherwise(1), F.lit(2), F.when(F.col("l_linestatus") == "O", -100).otherwise(3))
    sums = {"total": K.sequence_logprob(p, y), "mean": K.sequence_logprob(p, y, average=True)}
    return t.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("q"), F.col("l_linenumber").alias("n"), *rounded(sums, 6))


@query(f"""WITH b AS (SELECT *, reward - avg(reward) OVER w AS c, CASE WHEN count(*) OVER w > 1 THEN reward - (sum(reward) OVER w - reward) / (count(*) OVER w - 1) END AS loo, stddev_samp(reward) OVER w AS s FROM {LOGPS_SQL} WINDOW w AS (PARTITION BY l_orderkey)),
m AS (SELECT stddev_samp(reward) AS sd, avg(loo) AS lm, stddev_samp(loo) AS ls FROM b)
SELECT l_orderkey, l_partkey, l_linenumber, round(c / (sd + 0.0001), 9) + 0.0 AS batch_scaled, round((loo - lm) / (ls + 0.0001), 9) + 0.0 AS loo_score FROM b, m""")
def win_batch_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Advantages over the deviation of the whole batch; leave-one-out ones as a z-score of the batch."""
    r = F.col("reward")
    df = sequences.with_batch_moments(logps(spark, d), r)
    df = df.withColumns({"batch_scaled": sequences.group_advantage(df, "l_orderkey", r, "batch"), "loo_score": sequences.leave_one_out("l_orderkey", r)})
    df = sequences.standardised(df.drop("_mean", "_std"), "loo_score")
    return df.select(*KEYS, *rounded({k: F.col(k) for k in ("batch_scaled", "loo_score")}))


@query(f"SELECT round(avg((abs(s) <= 1e-8)::INT), 9) AS flat_share, count(s) AS n_groups FROM (SELECT stddev_samp(reward) AS s FROM {LOGPS_SQL} GROUP BY l_orderkey)")
def agg_flat_groups(spark: SparkSession, d: str) -> DataFrame:
    s = logps(spark, d).groupBy("l_orderkey").agg(F.stddev_samp("reward").alias("s"))
    return s.agg(F.round(F.avg((F.abs("s") <= 1e-8).cast("int")), 9).alias("flat_share"), F.count("s").alias("n_groups"))


@query(f"""WITH k AS (SELECT *, l_linenumber % 3 <> 0 AS kept FROM {LOGPS_SQL}), m AS (SELECT avg(reward) AS m, var_samp(reward) AS v FROM k WHERE kept)
SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN kept THEN (reward - m) / sqrt(v + 1e-8) ELSE 0 END, 9) + 0.0 AS white, round(CASE WHEN kept THEN (reward - m) / sqrt(v + 1e-8) + m ELSE 0 END, 9) + 0.0 AS shifted FROM k, m""")
def win_masked_whiten(spark: SparkSession, d: str) -> DataFrame:
    kept = F.col("l_linenumber") % 3 != 0
    df = sequences.masked_moments(logps(spark, d), "reward", kept)
    return df.select(*KEYS, *rounded({"white": sequences.whiten(df, "reward", kept), "shifted": sequences.whiten(df, "reward", kept, shift_mean=False)}))


@query(f"""WITH b AS (SELECT conv_id, turn, (row_number() OVER (ORDER BY md5('r|' || conv_id || '|' || turn), conv_id, turn) - 1) // 32 AS batch FROM {PAIRS_SQL})
SELECT conv_id, turn, batch::BIGINT AS batch, r::INT AS repeat, g::INT AS copy, row_number() OVER (PARTITION BY batch, r ORDER BY md5('b|' || r || '|' || conv_id || '|' || turn || '|' || g), conv_id, turn, g) AS place FROM b, range(0, 2) x(r), range(0, 3) y(g)""")
def win_repeat_batches(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in shuffled batches, each batch twice, each prompt three times in it, shuffled anew in each repeat."""
    p = chat.chat_pairs(table(spark, d, "conversations")).select("conv_id", "turn")
    md5 = lambda *c: F.md5(F.concat_ws("|", *[x.cast("string") for x in c]))
    ranked = sequences.hash_rank(p, md5(F.lit("r"), F.col("conv_id"), F.col("turn")), ["conv_id", "turn"])
    b = ranked.select("conv_id", "turn", F.floor(F.col("rank") / 32).alias("batch"))
    b = b.withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    w = Window.partitionBy("batch", "repeat").orderBy(md5(F.lit("b"), *[F.col(c) for c in ("repeat", "conv_id", "turn", "copy")]), "conv_id", "turn", "copy")
    return b.withColumn("place", F.row_number().over(w).cast("long"))


@query(f"""WITH o AS (SELECT -pc AS nll, 0.1 * {ls('(pc - pr) - (ln(1 - exp(pc)) - ln(1 - exp(pr)))')} AS term FROM {LOGPS_SQL}) SELECT round(avg(nll) - avg(term), 9) AS total FROM o""")
def ls_odds_total(spark: SparkSession, d: str) -> DataFrame:
    pc, pr = F.col("pc"), F.col("pr")
    return logps(spark, d).agg(F.round(C.odds_total(-pc, C.reference_free(pc, pr)["orpo_term"]), 9).alias("total"))


@query(f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, reward, value, pc, pr) AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {LOGPS_SQL}),
k AS (SELECT greatest(avg(b.pc - o.rc), 0.0) AS kl FROM b JOIN b o ON o.l_orderkey = b.l_orderkey AND o.p = b.n + 1 - b.p)
SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 1 THEN 1 - {sg('0.1 * (pc - rc - kl)')} ELSE 1.33 * (1 - {sg('0.1 * (kl - (pc - rc))')}) END, 9) + 0.0 AS kto FROM b, k""")
def ls_mismatched_kl(spark: SparkSession, d: str) -> DataFrame:
    """The divergence is taken over pairs of a prompt with another prompt's completion."""
    w = Window.partitionBy("l_orderkey")
    b = logps(spark, d).withColumns({"p": F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "reward", "value", "pc", "pr")), "n": F.count(F.lit(1)).over(w)})
    other = b.select("l_orderkey", (F.col("n") + 1 - F.col("p")).cast("int").alias("p"), F.col("rc").alias("other"))
    kl = b.join(other, ["l_orderkey", "p"]).agg(F.greatest(F.avg(F.col("pc") - F.col("other")), F.lit(0.0)).alias("kl"))
    ll, k = F.col("pc") - F.col("rc"), F.col("kl")
    kto = F.when(F.col("l_linenumber") % 2 == 1, 1 - C.sigmoid(0.1 * (ll - k))).otherwise(1.33 * (1 - C.sigmoid(0.1 * (k - ll))))
    return b.crossJoin(F.broadcast(kl)).select(*KEYS, *rounded({"kto": kto}))


@query("""WITH s AS (SELECT *, exp(((-l_tax + l_discount) + CASE WHEN l_returnflag = 'R' THEN -l_quantity / 50.0 + 0.2 ELSE 0 END) / CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) AS r, l_extendedprice / 10007.0 - 3 AS a FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, round(-least(r * a, least(greatest(r, 0.8), 1.2) * a), 9) + 0.0 AS objective, (r < 0.8 AND a < 0) AS low, (r > 1.2 AND a > 0) AS high, ((r < 0.8 AND a < 0) OR (r > 1.2 AND a > 0)) AS region FROM s""")
def ls_sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The ratio of whole sequences, and where it is clipped."""
    t = table(spark, d, "lineitem")
    mask = F.array(F.lit(1.0), (F.col("l_returnflag") == "R").cast("double"))
    log = C.sequence_log_ratio(F.array(-F.col("l_tax"), -F.col("l_quantity") / 50.0), F.array(-F.col("l_discount"), F.lit(-0.2)), mask)
    t = t.withColumns({"log": log, "a": F.col("l_extendedprice") / 10007.0 - 3})
    clip = C.clipped(F.exp("log"), F.col("a"))
    return t.select(*KEYS, *rounded({"objective": C.ratio_objective(F.col("log"), F.lit(0.0), F.col("a"))}), *[c.alias(k) for k, c in clip.items()])


@query("""WITH n AS (SELECT l_returnflag, l_quantity * l_tax AS total, l_linenumber AS tokens FROM lineitem)
SELECT l_returnflag, round(sum(total) / count(*), 6) AS batchmean, round(sum(total), 6) AS summed, round(sum(total) / sum(tokens), 6) AS mean, round(min(total), 6) AS low, round(max(total), 6) AS high, sum(tokens)::BIGINT AS n_tokens FROM n GROUP BY l_returnflag""")
def ls_reductions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") * F.col("l_tax")).alias("total"), F.col("l_linenumber").alias("tokens"), F.lit(1).alias("one"))
    how = {k: F.round(C.reduced(F.col("total"), F.col("one"), F.col("tokens"), h), 6).alias(k) for k, h in (("batchmean", "batchmean"), ("summed", "sum"), ("mean", "mean"))}
    return n.groupBy("l_returnflag").agg(*how.values(), F.round(F.min("total"), 6).alias("low"), F.round(F.max("total"), 6).alias("high"), F.sum("tokens").cast("long").alias("n_tokens"))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, round(-0.1 * (pc - rc), 9) + 0.0 AS k1_reward, round(-0.1 * (exp(rc - pc) - 1 - (rc - pc)), 9) + 0.0 AS k3_reward FROM {LOGPS_SQL}")
def ls_kl_rewards(spark: SparkSession, d: str) -> DataFrame:
    new, ref = F.col("pc"), F.col("rc")
    return logps(spark, d).select(*KEYS, *rounded({f"{k}_reward": -0.1 * C.kl_estimate(new, ref, k) for k in ("k1", "k3")}))


@query(f"SELECT conv_id, turn, (CASE WHEN list_contains(c, {STOP}) THEN 1.0 ELSE 0.0 END - CASE WHEN {ENDED} THEN 0 ELSE 0.5 END)::DOUBLE AS score FROM {TOKENS_SQL}")
def ls_missing_end(spark: SparkSession, d: str) -> DataFrame:
    """A completion without an end token at its end loses a penalty."""
    c = F.col("c")
    score = F.when(F.array_contains(c, STOP), 1.0).otherwise(0.0) - F.when(K.cut_off(c, ENDS), 0.5).otherwise(0.0)
    return token_pairs(spark, d).select("conv_id", "turn", score.alias("score"))


@query("SELECT event_type, count(value)::BIGINT AS n, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS mean, round(stddev_samp(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS std, round(min(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS low, round(max(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS high, round(sum(CASE WHEN event_id % 5 <> 0 THEN value ELSE 0 END), 4) AS total FROM events GROUP BY event_type")
def agg_nan_skipping(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth value is not a number and counts for nothing."""
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    kept = F.when(~F.isnan(v), v)
    r = lambda c, k, n=6: F.round(c, n).alias(k)
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("value").alias("n"), r(F.avg(kept), "mean"), r(F.stddev_samp(kept), "std"), r(F.min(kept), "low"), r(F.max(kept), "high"), r(F.sum(kept), "total", 4)
    )


@query(f"SELECT conv_id, turn, array_to_string(list_concat(p, list_transform(range(greatest(len(c) - len(p), 0)), lambda x: 0)), ',') AS p, array_to_string(list_concat(c, list_transform(range(greatest(len(p) - len(c), 0)), lambda x: 0)), ',') AS c FROM {TOKENS_SQL}")
def set_common_width(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("p"), F.col("c")
    n = K.common_width(p, c)
    return token_pairs(spark, d).select("conv_id", "turn", *joined(p=K.pad_to(p, n, 0), c=K.pad_to(c, n, 0)))


@query(f"SELECT conv_id, turn FROM {TOKENS_SQL} WHERE len(p) <= 100 AND len(c) <= 300")
def flt_length(spark: SparkSession, d: str) -> DataFrame:
    return token_pairs(spark, d).filter((F.size("p") <= 100) & (F.size("c") <= 300)).select("conv_id", "turn")


@query("SELECT 0 AS epoch, doc_id, (row_number() OVER (ORDER BY md5('p0|' || doc_id), doc_id) - 1)::BIGINT AS place FROM documents UNION ALL SELECT 1, doc_id, (row_number() OVER (ORDER BY md5('p1|' || doc_id), doc_id) - 1)::BIGINT FROM documents")
def srt_epoch_permutations(spark: SparkSession, d: str) -> DataFrame:
    """Another permutation of the whole table in each epoch."""
    docs = table(spark, d, "documents").select("doc_id")

    def permuted(e: int) -> DataFrame:
        ranked = sequences.hash_rank(docs, F.md5(F.concat(F.lit(f"p{e}|"), F.col("doc_id").cast("string"))), ["doc_id"])
        return ranked.select(F.lit(e).alias("epoch"), "doc_id", F.col("rank").cast("long").alias("place"))

    return permuted(0).unionByName(permuted(1))


@query("SELECT doc_id, n_chars * 2 AS doubled, lang || '!' AS marked FROM documents")
def udf_batched_map(spark: SparkSession, d: str) -> DataFrame:
    """A function of batches of columns as lists, with a further argument."""

    def marked(batch: dict, mark: str) -> dict:
        return {"doc_id": batch["doc_id"], "doubled": [2 * x for x in batch["n_chars"]], "marked": [x + mark for x in batch["lang"]]}

    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return columns.map_batches(docs, marked, "doc_id long, doubled long, marked string", mark="!")


@query("SELECT doc_id, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS es, length(text)::DOUBLE AS chars FROM documents")
def udf_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by a function of a batch of texts."""
    e = columns.embedded(table(spark, d, "documents").select("doc_id", "text"), "text", lambda s: s.map(lambda t: [float(t.count("e")), float(len(t))]))
    return e.select("doc_id", F.get("embedding", F.lit(0)).alias("es"), F.get("embedding", F.lit(1)).alias("chars"))


@query("SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm, '<s>[INST] ' || text || ' [/INST]' AS inst FROM conversations WHERE length(text) <= 400")
def str_stateless(spark: SparkSession, d: str) -> DataFrame:
    """The stateless operators on a stream of files: formatting, normalising and the length filter."""
    schema = table(spark, d, "conversations").schema
    # a stream takes a folder or a pattern; the table may be a folder of files or one file
    stream = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]")
    out = stream.filter(F.length("text") <= 400).select("conv_id", "turn", X.normalize(F.col("text")).alias("norm"), X.inst_prompt(F.col("text")).alias("inst"))
    path = scratch_path(spark, "stream")
    running = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")
