"""Queries on token arrays: encoding, trimming, masks, packing, log-probabilities, on subword tokens of the public vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions import scores as C
from loomframe.functions import tokens as K
from loomframe.functions.text import common_prefix_length
from loomframe.operators import chat, sequences, subwords
from loomframe.plans.corpus import PAIRS_SQL
from loomframe.plans.registry import query
from loomframe.plans.subwords_sql import with_ids
from loomframe.plans.tables import table

#: Ids of the public vocabulary (fixed values) that stand for a stop, an end, padding and a word, as the tables' texts hold them.
STOP, QUESTION, COMMA, THE = 13, 30, 11, 262
ENDS = [STOP, QUESTION]
ENDED = f"c[len(c)] IN ({STOP}, {QUESTION})"
#: A completion is generated up to so many tokens.
GENERATED = 400
TOKENS_SQL = f"(SELECT conv_id, turn, p, c[1:{GENERATED}] AS c, prompt, completion FROM {with_ids(PAIRS_SQL, p='prompt', c='completion')})"
TURNS_SQL = f"(SELECT conv_id, turn, role, s FROM {with_ids('conversations', s='text')})"


def token_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and completions as tokens, a completion as far as it was generated."""
    ids = subwords.encoder(subwords.vocabulary(spark))
    pairs = chat.chat_pairs(table(spark, d, "conversations"))
    return pairs.select("conv_id", "turn", ids(F.col("prompt")).alias("p"), K.keep_first(ids(F.col("completion")), GENERATED).alias("c"), "prompt", "completion")


def token_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's tokens ``s``."""
    ids = subwords.encoder(subwords.vocabulary(spark))
    return table(spark, d, "conversations").withColumn("s", ids(F.col("text")))


def joined(**cols) -> list:
    return [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(k) for k, c in cols.items()]


@query(f"SELECT conv_id, turn, len(s)::INT AS n_tokens, md5(array_to_string(s, ',')) AS ids, md5(text) AS decoded FROM {with_ids('conversations', s='text')}")
def tok_subwords(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as subword tokens and back; the text comes back exactly."""
    tokens = subwords.vocabulary(spark)
    ids = subwords.encoder(tokens)
    t = table(spark, d, "conversations").select("conv_id", "turn", ids(F.col("text")).alias("s"))
    back = subwords.decoded(t, ["conv_id", "turn"], "s", tokens)
    listed = F.md5(F.array_join(F.transform("s", lambda x: x.cast("string")), ","))
    return t.select("conv_id", "turn", F.size("s").alias("n_tokens"), listed.alias("ids")).join(back, ["conv_id", "turn"]).withColumn("decoded", F.md5("decoded"))


@query(f"SELECT doc_id, len(s)::INT AS n_tokens, md5(array_to_string(s[1:512], ',')) AS kept, md5(array_to_string(s, ',')) AS ids FROM {with_ids('documents', s='text')}")
def tok_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as subword tokens, and their first 512."""
    ids = subwords.encoder(subwords.vocabulary(spark))
    t = table(spark, d, "documents").select("doc_id", ids(F.col("text")).alias("s"))
    listed = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return t.select("doc_id", F.size("s").alias("n_tokens"), listed(K.keep_first(F.col("s"), 512)).alias("kept"), listed(F.col("s")).alias("ids"))


@query(f"""SELECT conv_id, turn, array_to_string(p[greatest(len(p) - 15, 1):], ',') AS prompt_kept, array_to_string(list_append(c, -1)[1:24], ',') AS answer_kept,
 array_to_string(list_concat(list_transform(p, lambda x: -100), c), ',') AS labels, array_to_string(list_prepend(-2, p), ',') AS opened,
 array_to_string(list_concat(p, list_transform(range(greatest(64 - len(p), 0)), lambda x: 0)), ',') AS padded_right, array_to_string(list_concat(list_transform(range(greatest(64 - len(p), 0)), lambda x: 0), p), ',') AS padded_left,
 array_to_string(list_concat(list_filter(p, lambda x: x <> {COMMA}), list_filter(p, lambda x: x = {COMMA})), ',') AS packed_left, array_to_string(list_transform(p, lambda x: CASE WHEN x = {THE} THEN -5 ELSE x END), ',') AS remapped,
 array_to_string(CASE WHEN list_position(c, {STOP}) > 0 THEN c[1:list_position(c, {STOP})] ELSE c END, ',') AS stopped, list_contains(c, {STOP}) AS has_stop, NOT coalesce({ENDED}, false) AS cut_off, (len(p) <= 80 AND len(c) <= 300) AS short
FROM {TOKENS_SQL}""")
def tok_trim_and_mask(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("p"), F.col("c")
    return token_pairs(spark, d).select(
        "conv_id",
        "turn",
        *joined(
            prompt_kept=K.keep_last(p, 16),
            answer_kept=K.keep_first(K.close(c, -1), 24),
            labels=K.mask_labels(p, c),
            opened=K.open_with(p, -2),
            padded_right=K.pad_right(p, 64, 0),
            padded_left=K.pad_left(p, 64, 0),
            packed_left=K.pack_left(p, COMMA),
            remapped=K.replace_token(p, THE, -5),
            stopped=K.until_first(c, STOP),
        ),
        F.array_contains(c, STOP).alias("has_stop"),
        K.cut_off(c, ENDS).alias("cut_off"),
        ((F.size(p) <= 80) & (F.size(c) <= 300)).alias("short"),
    )


@query(f"""SELECT conv_id, turn, len(list_filter(list_zip(p[1:least(len(p), len(c))], c[1:least(len(p), len(c))]), lambda z: z[1] <> z[2]))::INT AS n_differ, abs(len(p) - len(c)) <= 1 AS near,
 coalesce((SELECT min(i) - 1 FROM range(1, least(length(prompt), length(completion)) + 1) t(i) WHERE substr(prompt, i, 1) <> substr(completion, i, 1)), least(length(prompt), length(completion)))::INT AS common
FROM {TOKENS_SQL}""")
def tok_boundary_checks(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("p"), F.col("c")
    return token_pairs(spark, d).select(
        "conv_id", "turn", K.differing(p, c).alias("n_differ"), (F.abs(F.size(p) - F.size(c)) <= 1).alias("near"), common_prefix_length(F.col("prompt"), F.col("completion")).cast("int").alias("common")
    )


@query(f"""SELECT conv_id, string_agg(array_to_string(list_concat(list_transform(range(len(s) - 1), lambda x: -100), [CASE WHEN role = 'assistant' THEN 1 ELSE 0 END]), ','), ',' ORDER BY turn) FILTER (len(s) > 0) AS labels
FROM {TURNS_SQL} GROUP BY conv_id""")
def tok_step_labels(spark: SparkSession, d: str) -> DataFrame:
    g = token_turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s", (F.col("role") == "assistant").alias("y")))).alias("g"))
    steps, labels = F.transform("g", lambda x: x["s"]), F.transform("g", lambda x: x["y"])
    return g.select("conv_id", *joined(labels=K.step_labels(steps, labels)))


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(list_concat(p, c), lambda x, i: CASE WHEN i > len(p) AND x <> {COMMA} THEN 1 ELSE 0 END), ',') AS mask, array_to_string(p[2:], ',') AS next_tokens,
  coalesce(list_min(list_filter(list_transform(p, lambda x, i: CASE WHEN x <> {COMMA} THEN i - 1 END), lambda y: y IS NOT NULL)), len(p))::INT AS left_padding FROM {TOKENS_SQL}""")
def tok_completion_mask(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("p"), F.col("c")
    return token_pairs(spark, d).select(
        "conv_id", "turn", *joined(mask=K.completion_mask(F.size(p), F.concat(p, c), COMMA), next_tokens=F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))), K.left_padding(p, COMMA).cast("int").alias("left_padding")
    )


@query(f"""SELECT count(*) AS n, round(avg(len(c)), 6) AS mean, min(len(c))::INT AS low, max(len(c))::INT AS high, round(avg((NOT coalesce({ENDED}, false))::INT), 6) AS clipped,
 round(coalesce(avg(CASE WHEN {ENDED} THEN len(c) END), 0), 6) AS ended_mean, coalesce(min(CASE WHEN {ENDED} THEN len(c) END), 0)::INT AS ended_low, coalesce(max(CASE WHEN {ENDED} THEN len(c) END), 0)::INT AS ended_high, sum(len(p) + len(c))::BIGINT AS n_tokens FROM {TOKENS_SQL}""")
def agg_completion_lengths(spark: SparkSession, d: str) -> DataFrame:
    n, cut = F.size("c"), K.cut_off(F.col("c"), ENDS)
    ended = F.when(~cut, n)
    return token_pairs(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("low"), F.max(n).alias("high"), F.round(F.avg(cut.cast("int")), 6).alias("clipped"),
        F.round(F.coalesce(F.avg(ended), F.lit(0.0)), 6).alias("ended_mean"),
        F.coalesce(F.min(ended), F.lit(0)).alias("ended_low"), F.coalesce(F.max(ended), F.lit(0)).alias("ended_high"), F.sum(F.size("p") + n).cast("long").alias("n_tokens"),
    )


@query("""WITH t AS (SELECT doc_id, source, n_chars::BIGINT AS size, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM documents)
SELECT doc_id, source, size, (e - size)::BIGINT AS start, floor((e - size) / 2048)::BIGINT AS first_pack, floor(greatest(e - 1, e - size) / 2048)::BIGINT AS last_pack FROM t""")
def tok_pack_wrapped(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("long").alias("size"))
    return sequences.pack_wrapped(docs, "source", "doc_id", "size", 2048).select("doc_id", "source", "size", "start", "first_pack", "last_pack")


@query("""WITH RECURSIVE o AS (SELECT doc_id, n_chars::BIGINT AS size, least(n_chars, 8192)::BIGINT AS kept, row_number() OVER (ORDER BY least(n_chars, 8192) DESC, doc_id) AS i FROM documents),
f AS (
 SELECT 0::BIGINT AS i, []::BIGINT[] AS rooms, 0::BIGINT AS pack
 UNION ALL
 SELECT i + 1, CASE WHEN k IS NULL THEN list_append(rooms, 8192 - kept) ELSE list_concat(rooms[:k - 1], [rooms[k] - kept], rooms[k + 1:]) END, coalesce(k - 1, len(rooms)) FROM (
  SELECT f.i, rooms, kept, list_min(list_filter(rooms, lambda x: x >= kept)) AS best, CASE WHEN best IS NOT NULL THEN list_position(rooms, best) END AS k FROM f JOIN o ON o.i = f.i + 1))
SELECT doc_id, size, kept, pack FROM o JOIN f ON f.i = o.i""")
def tok_pack_best_fit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("size"))
    return sequences.pack_best_fit(docs, "doc_id", "size", 8192)


OPENED_SQL = "(SELECT conv_id, turn, CASE WHEN role = 'user' THEN '<s>' ELSE '' END || text AS text FROM conversations)"


@query(f"SELECT conv_id, turn, array_to_string((CASE WHEN starts_with(text, '<s>') THEN s ELSE list_prepend(-2, s) END)[1:6], ',') AS opened FROM {with_ids(OPENED_SQL, s='text')}")
def tok_open_once(spark: SparkSession, d: str) -> DataFrame:
    """Texts that a template has opened are not opened again."""
    ids = subwords.encoder(subwords.vocabulary(spark))
    t = table(spark, d, "conversations").withColumn("text", F.concat(F.when(F.col("role") == "user", "<s>").otherwise(""), "text"))
    return t.select("conv_id", "turn", *joined(opened=K.keep_first(K.open_once(ids(F.col("text")), F.col("text"), "<s>", -2), 6)))


LOGP_SQL = "(SELECT l_orderkey AS k, l_partkey AS q, [-l_tax, -l_discount, -l_quantity / 50.0] AS p, [-l_discount - 0.1, -l_tax - 0.2, -l_quantity / 40.0] AS q2, l_linenumber FROM lineitem)"
LSE = "(list_max({0}) + ln(list_sum(list_transform({0}, lambda x: exp(x - list_max({0}))))))"


@query(f"""WITH n AS (SELECT k, q, l_linenumber, p, list_transform(p, lambda x: x - {LSE.format('p')}) AS a, list_transform(q2, lambda x: x - {LSE.format('q2')}) AS b FROM {LOGP_SQL}),
m AS (SELECT *, list_transform(list_zip(a, b), lambda z: ln(0.5 * exp(z[1]) + 0.5 * exp(z[2]))) AS m FROM n)
SELECT k, q, round(a[(l_linenumber % 3 + 1)::INT], 6) + 0.0 AS chosen, round(list_sum(p), 6) + 0.0 AS total,
 round(0.5 * list_sum(list_transform(list_zip(b, m), lambda z: exp(z[1]) * (z[1] - z[2]))) + 0.5 * list_sum(list_transform(list_zip(a, m), lambda z: exp(z[1]) * (z[1] - z[2]))), 6) + 0.0 AS jsd FROM m""")
def tok_logprobs_and_jsd(spark: SparkSession, d: str) -> DataFrame:
    t, disc, q = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("q"), F.array(-t, -disc, -q / 50.0).alias("p"), F.array(-disc - 0.1, -t - 0.2, -q / 40.0).alias("q2"), (F.col("l_linenumber") % 3).alias("i"))
    for c in ("p", "q2"):
        df = df.withColumn(c + "z", C.logsumexp(F.col(c)))
    df = df.withColumns({"a": F.expr("transform(p, x -> x - pz)"), "b": F.expr("transform(q2, x -> x - q2z)")})
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    z = lambda c: F.round(c, 6) + 0.0
    return df.select("k", "q", z(K.selected_logprob(F.col("p"), F.col("i"))).alias("chosen"), z(total).alias("total"), z(C.jensen_shannon(F.col("a"), F.col("b"))).alias("jsd"))


@query("""WITH t AS (SELECT quantile_cont(l_tax, 0.8) AS q FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey, l_partkey, l_linenumber, (l_tax >= q AND l_returnflag <> 'R') AS high FROM lineitem, t""")
def tok_entropy_mask(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    cut = sequences.exact_quantile(li.filter("l_returnflag <> 'R'"), "l_tax", 0.8)
    high = F.coalesce((F.col("l_tax") >= F.col("cut")) & (F.col("l_returnflag") != "R"), F.lit(False))
    return li.crossJoin(F.broadcast(cut)).select("l_orderkey", "l_partkey", "l_linenumber", high.alias("high"))


@query("""WITH t AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_tax END) AS s, sum((l_returnflag <> 'R')::INT) AS n FROM lineitem GROUP BY l_orderkey)
SELECT round(avg(s / greatest(n, 1)), 6) AS by_sequence, round(sum(s) / greatest(sum(n), 1), 6) AS by_token, round(sum(s) / (count(*) * 7), 6) AS by_length, round(sum(s) / 1000, 6) AS by_items FROM t""")
def agg_masked_means(spark: SparkSession, d: str) -> DataFrame:
    on = F.col("l_returnflag") != "R"
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(on, F.col("l_tax")).otherwise(0.0)).alias("s"), F.sum(on.cast("int")).alias("n"))
    s, n = F.col("s"), F.col("n")
    r = lambda c, k: F.round(c, 6).alias(k)
    return t.agg(r(F.avg(s / F.greatest(n, F.lit(1))), "by_sequence"), r(F.sum(s) / F.greatest(F.sum(n), F.lit(1)), "by_token"), r(F.sum(s) / (F.count(F.lit(1)) * 7), "by_length"), r(F.sum(s) / 1000, "by_items"))


@query(f"SELECT conv_id, turn, g::INT AS copy, ntile(4) OVER (ORDER BY md5('n|' || conv_id || '|' || turn), conv_id, turn, g)::INT AS slice FROM {PAIRS_SQL}, range(1, 4) t(g)")
def win_repeat_and_slice(spark: SparkSession, d: str) -> DataFrame:
    p = chat.chat_pairs(table(spark, d, "conversations")).select("conv_id", "turn", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit("n"), F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    ranked = sequences.hash_rank(p, key, ["conv_id", "turn", "copy"])
    return ranked.select("conv_id", "turn", "copy", sequences.tile(F.col("rank"), F.col("total"), 4).alias("slice"))
