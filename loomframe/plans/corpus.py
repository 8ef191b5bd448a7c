"""Queries on corpora: formatting, parsing, validation, sampling, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions import text as X
from loomframe.operators import chat, sampling
from loomframe.plans.registry import query
from loomframe.plans.tables import table
from loomframe.streaming import history
from loomframe.streaming.recent import recent_rows


#: Consecutive user and assistant turns.
PAIRS_SQL = """(SELECT conv_id, turn, text AS prompt, nt AS completion FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nr = 'assistant')"""


#: White space by its code points.
WHITE = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


# other kinds of white space are put into the texts, which have none
@query(f"SELECT doc_id, lower(trim(regexp_replace(chr(160) || replace(text, ' the ', chr(8195) || 'the' || chr(9) || chr(12288)), '{WHITE}', ' ', 'g'))) AS norm FROM documents")
def scl_normalize(spark: SparkSession, d: str) -> DataFrame:
    odd = F.concat(F.lit("\u00a0"), F.replace(F.col("text"), F.lit(" the "), F.lit("\u2003the\t\u3000")))
    return table(spark, d, "documents").select("doc_id", X.normalize(odd).alias("norm"))


@query(f"SELECT * FROM {PAIRS_SQL}")
def prj_chat_pairs(spark: SparkSession, d: str) -> DataFrame:
    return chat.chat_pairs(table(spark, d, "conversations"))


@query(r"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
l AS (SELECT conv_id, text || chr(10) || chr(10) AS s FROM t WHERE k = 1 AND role = 'system'),
n AS (SELECT t.conv_id, turn, role, text, k - 1 - (l.s IS NOT NULL)::INT AS i, coalesce(CASE WHEN k - 1 - (l.s IS NOT NULL)::INT = 0 THEN l.s END, '') AS s
      FROM t LEFT JOIN l ON l.conv_id = t.conv_id WHERE NOT (k = 1 AND role = 'system'))
SELECT c.conv_id, '<bos>' || coalesce(string_agg('<start_of_turn>' || CASE WHEN role = 'assistant' THEN 'model' ELSE role END || chr(10) || s || trim(text, chr(32) || chr(9) || chr(10) || chr(13)) || '<end_of_turn>' || chr(10), '' ORDER BY turn), '') AS rendered,
  coalesce(bool_and((role = 'user') = (i % 2 = 0)), true) AS alternates
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id = c.conv_id GROUP BY c.conv_id""")
def prj_chat_render(spark: SparkSession, d: str) -> DataFrame:
    return chat.render(table(spark, d, "conversations"))


@query(f"""
SELECT conv_id, turn, 'Translate to docs: ' || prompt AS instruction, '' AS input,
  'COMMAND: ' || completion || chr(10) || 'CONFIDENCE: 0.90' || chr(10) || 'EXPLANATION: turn ' || turn || chr(10) AS output,
  'Translate this to a docker command: ' || prompt AS docker_instruction,
  '<start_of_turn>user' || chr(10) || prompt || CASE WHEN turn % 2 = 0 THEN chr(10) || 'in' ELSE '' END || '<end_of_turn>' || chr(10)
    || '<start_of_turn>model' || chr(10) || completion || '<end_of_turn><eos>' AS chat,
  '<s>[INST] ' || prompt || ' [/INST]' AS inst,
  '### Instruction:' || chr(10) || prompt || chr(10) || chr(10) || '### Response:' || chr(10) || completion AS headed,
  CASE WHEN completion LIKE '%.' THEN completion ELSE completion || '.' END AS closed
FROM {PAIRS_SQL}""")
def prj_formats(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("prompt"), F.col("completion")
    given = F.when(F.col("turn") % 2 == 0, "in").otherwise("")
    output = F.concat_ws("\n", F.concat(F.lit("COMMAND: "), c), F.lit("CONFIDENCE: 0.90"), F.concat(F.lit("EXPLANATION: turn "), F.col("turn").cast("string")), F.lit(""))
    return chat.chat_pairs(table(spark, d, "conversations")).select(
        "conv_id",
        "turn",
        F.concat(F.lit("Translate to docs: "), p).alias("instruction"),
        F.lit("").alias("input"),
        output.alias("output"),
        F.concat(F.lit("Translate this to a docker command: "), p).alias("docker_instruction"),
        X.chat_turns(X.with_input(p, given), c).alias("chat"),
        X.inst_prompt(p).alias("inst"),
        X.header_prompt(p, c).alias("headed"),
        X.ends_with_once(c, ".").alias("closed"),
    )


TAGGED = """(SELECT doc_id, 'note' || chr(10) || 'COMMAND: old' || chr(10) || 'COMMAND: ' || source || ' ' || lang || CASE doc_id % 5 WHEN 1 THEN '; rm' WHEN 2 THEN ' | wc' ELSE '' END || chr(10)
  || 'CONFIDENCE: ' || CASE doc_id % 7 WHEN 0 THEN '95%' WHEN 1 THEN 'nan' WHEN 2 THEN '7' WHEN 3 THEN '1.0d' ELSE '0.' || (doc_id % 90 + 10) END || chr(10)
  || 'EXPLANATION:  EXPLANATION: n ' || n_chars || ' ' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'ALTERNATIVES: a | b ||' || lang ELSE 'x' END AS t FROM documents)"""


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Model output in tagged lines, made of the documents' columns, with its defects."""
    i = F.col("doc_id")
    tail = F.when(i % 5 == 1, "; rm").when(i % 5 == 2, " | wc").otherwise("")
    conf = F.when(i % 7 == 0, "95%").when(i % 7 == 1, "nan").when(i % 7 == 2, "7").when(i % 7 == 3, "1.0d").otherwise(F.concat(F.lit("0."), (i % 90 + 10).cast("string")))
    lines = [
        F.lit("note"),
        F.lit("COMMAND: old"),
        F.concat(F.lit("COMMAND: "), "source", F.lit(" "), "lang", tail),
        F.concat(F.lit("CONFIDENCE: "), conf),
        F.concat(F.lit("EXPLANATION:  EXPLANATION: n "), F.col("n_chars").cast("string"), F.lit(" ")),
        F.when(i % 3 == 0, F.concat(F.lit("ALTERNATIVES: a | b ||"), "lang")).otherwise("x"),
    ]
    return table(spark, d, "documents").select("doc_id", F.concat_ws("\n", *lines).alias("t"))


PARSED_SQL = f"""(SELECT doc_id, t, trim(replace(list_last(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, 'COMMAND:'))), 'COMMAND:', '')) AS command,
  trim(replace(list_last(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, 'CONFIDENCE:'))), 'CONFIDENCE:', '')) AS conf,
  trim(replace(list_last(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, 'EXPLANATION:'))), 'EXPLANATION:', '')) AS explanation,
  coalesce(trim(replace(list_last(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, 'ALTERNATIVES:'))), 'ALTERNATIVES:', '')), '') AS alt FROM {TAGGED})"""
NUM_SQL = "CASE WHEN regexp_full_match(conf, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(conf AS DOUBLE) WHEN conf = 'nan' THEN -1.0 ELSE 0.0 END"
SAFE_SQL = "(command <> '' AND starts_with(command, 'src1') AND NOT regexp_matches(command, ';|&&|[|][|]|`|[$]|<|>'))"


@query(f"""SELECT doc_id, command, {NUM_SQL} AS confidence, explanation,
  array_to_string(list_filter(list_transform(string_split(alt, '|'), lambda x: trim(x)), lambda x: x <> ''), ',') AS alternatives FROM {PARSED_SQL}""")
def scl_parse_output(spark: SparkSession, d: str) -> DataFrame:
    p = tagged(spark, d).select("doc_id", X.parse_output(F.col("t")).alias("p"))
    # -1 for what is not a number
    return p.select("doc_id", "p.command", F.nanvl("p.confidence", F.lit(-1.0)).alias("confidence"), "p.explanation", F.array_join("p.alternatives", ",").alias("alternatives"))


@query(f"""SELECT doc_id, {SAFE_SQL} AS safe, ({SAFE_SQL} AND {NUM_SQL} >= 0.6) AS success,
  split_part(command, ' ', 1) IN ('src1', 'src2') AS allowed,
  CASE WHEN {SAFE_SQL} AND conf <> 'nan' THEN 'Command: ' || command || chr(10) || 'Confidence: ' || round_even(({NUM_SQL})::DECIMAL(18, 9) * 100, 0)::BIGINT || '%' || chr(10) || 'Explanation: ' || explanation
    || CASE WHEN alts <> [] THEN chr(10) || 'Alternatives:' || array_to_string(list_transform(alts, lambda x: chr(10) || '  - ' || x), '') ELSE '' END ELSE 'No command found' END AS preview,
  CASE WHEN len(string_split(command, ' ')) > 1 THEN string_split(command, ' ')[2] ELSE command END AS sub
FROM (SELECT *, list_filter(list_transform(string_split(alt, '|'), lambda x: trim(x)), lambda x: x <> '') AS alts FROM {PARSED_SQL})""")
def flt_validate(spark: SparkSession, d: str) -> DataFrame:
    p = tagged(spark, d).select("doc_id", X.parse_output(F.col("t")).alias("p")).select("doc_id", "p.*")
    c = F.col("command")
    safe = X.is_safe(c, "src1")
    return p.select(
        "doc_id",
        safe.alias("safe"),
        X.passes(c, F.col("confidence"), "src1").alias("success"),
        X.first_word_in(c, ["src1", "src2"]).alias("allowed"),
        X.preview(c, F.col("confidence"), F.col("explanation"), F.col("alternatives"), safe & ~F.isnan("confidence")).alias("preview"),
        X.subcommand(c).alias("sub"),
    )


@query("SELECT page_id, (starts_with(url, 'https') AND NOT regexp_matches(url, ';|&&|[|][|]|`|[$]|<|>')) AS safe, url LIKE '%?%' AS has_query, url LIKE '%/' AS is_folder FROM pages")
def flt_url_predicates(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", X.is_safe(u, "https").alias("safe"), u.contains("?").alias("has_query"), u.endswith("/").alias("is_folder"))


@query("""SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, round(avg(length(text)), 6) AS avg_chars, round(1.0 - count(DISTINCT text) / count(*), 9) AS repeat_rate,
  count(DISTINCT source) AS n_sources FROM documents""")
def agg_dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    # one row for each digest of 128 bits, so whole texts aren't moved
    docs = table(spark, d, "documents").select(F.md5("text").alias("h"), F.length("text").alias("chars"), "source")
    texts = docs.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.sum("chars").alias("chars"))
    found = texts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("h").alias("n_distinct"), F.sum("chars").alias("chars"), F.sum(F.when(F.col("h").isNotNull(), F.col("c"))).alias("known"))
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("c")).agg(F.count("source").alias("n_sources"))
    return found.crossJoin(F.broadcast(sources)).select(
        "n", "n_distinct", F.round(F.col("chars") / F.nullif("known", F.lit(0)), 6).alias("avg_chars"), F.round(1 - F.col("n_distinct") / F.nullif("n", F.lit(0)), 9).alias("repeat_rate"), "n_sources"
    )


@query("SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY source ORDER BY source")
def agg_source_distribution(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total)).select("source", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct")).orderBy("source")


@query("""
WITH t(kind, pattern, command, confidence) AS (VALUES ('ls', 'list {name} in {path}', 'tool ls {path}/{name}', 0.95), ('scan', 'scan {path} for {name}', 'tool scan {path} -n {name}', 0.9), ('stats', 'size of {path}', 'tool stats {path}', 0.85))
SELECT kind, replace(replace(pattern, '{name}', n_name), '{path}', r_name) AS instruction, replace(replace(command, '{name}', n_name), '{path}', r_name) AS command, CAST(confidence AS DOUBLE) AS confidence
FROM t, nation, region WHERE n_regionkey = r_regionkey""")
def gen_expand_templates(spark: SparkSession, d: str) -> DataFrame:
    templates = spark.createDataFrame(
        [("ls", "list {name} in {path}", "tool ls {path}/{name}", 0.95), ("scan", "scan {path} for {name}", "tool scan {path} -n {name}", 0.9), ("stats", "size of {path}", "tool stats {path}", 0.85)],
        "kind string, pattern string, command string, confidence double",
    )
    slots = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("path"))
    return sampling.expand_templates(templates, slots, ["name", "path"])


@query("""
WITH p AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, CAST(floor(CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.3 ELSE 0.1 END * 601) AS INT) AS quota FROM p),
r AS (SELECT d.doc_id, d.lang, quota, row_number() OVER (PARTITION BY d.lang ORDER BY md5('q1|' || doc_id), doc_id) AS rank FROM documents d JOIN q ON q.lang = d.lang)
SELECT doc_id, lang, quota, rank::INT AS rank FROM r WHERE rank <= quota""")
def gen_quota_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    shares = docs.select("lang").distinct().withColumn("share", F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "de", 0.3).otherwise(0.1))
    quotas = sampling.quota_plan(shares, 601).select("lang", "quota")
    return sampling.quota_sample(docs, "lang", "doc_id", quotas, "q1").select("doc_id", "lang", "quota", "rank")


UNIT = "(CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT) / 4294967296.0)"


@query(f"SELECT doc_id, CASE WHEN {UNIT.format("'42|' || md5(text)")} < 0.1 THEN 'validation' ELSE 'train' END AS part FROM documents")
def srt_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_split(table(spark, d, "documents"), F.md5("text"), 0.1, "42").select("doc_id", "part")


@query("""WITH r AS (SELECT text, row_number() OVER (ORDER BY doc_id DESC) <= 150 AS tail, CAST(('0x' || substr(md5('42|' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1 AS v FROM documents)
SELECT count(*) AS n_tail, sum((EXISTS (SELECT 1 FROM r x WHERE NOT x.v AND x.text = r.text))::INT)::BIGINT AS n_leaked FROM r WHERE tail""")
def srt_split_leakage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    tail = docs.orderBy(F.desc("doc_id")).limit(150)
    trained = docs.filter(X.unit_hash(F.lit("42"), F.col("doc_id")) >= 0.1).select("h").distinct().withColumn("seen", F.lit(1))
    return tail.join(trained, "h", "left").agg(F.count(F.lit(1)).alias("n_tail"), F.sum(F.coalesce("seen", F.lit(0))).cast("long").alias("n_leaked"))


@query("""SELECT doc_id, source, (row_number() OVER (ORDER BY md5('s7|' || doc_id)) - 1)::BIGINT AS place FROM documents ORDER BY place LIMIT 100""")
def srt_shuffle_head(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "documents").select("doc_id", "source").orderBy(sampling.order_key("s7", F.col("doc_id"))).limit(100)
    w = Window.orderBy(sampling.order_key("s7", F.col("doc_id")))
    return top.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


@query(f"""WITH p AS (SELECT n_nationkey, n_name FROM nation), g AS (SELECT range AS draw, CAST(floor({UNIT.format("'w3|' || range")} * 25) AS BIGINT) AS k FROM range(500))
SELECT draw, n_name FROM g JOIN p ON p.n_nationkey = g.k""")
def srt_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return sampling.take_with_replacement(pool, "k", 500, 25, "w3").select("draw", "n_name")


@query("SELECT text_md5, doc_id FROM (SELECT md5(text) AS text_md5, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def set_drop_repeated(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return sampling.drop_repeated(docs, ["text_md5"], ["doc_id"])


@query("SELECT doc_id, 'a' AS part FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'b' FROM documents WHERE n_chars > 1000")
def set_bag_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.filter("lang = 'en'").select("doc_id", F.lit("a").alias("part")).unionByName(docs.filter("n_chars > 1000").select("doc_id", F.lit("b").alias("part")))


@query("SELECT user_id, sum((event_type IN ('click', 'purchase', 'error'))::INT)::BIGINT AS n_executed, round(coalesce(sum((event_type = 'purchase')::INT) / nullif(sum((event_type IN ('click', 'purchase', 'error'))::INT), 0), 0.0), 9) AS success_rate FROM events GROUP BY user_id")
def agg_success_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"executed": F.col("event_type").isin("click", "purchase", "error"), "successful": F.col("event_type") == "purchase"})
    return history.success_rate(e, "user_id").withColumn("success_rate", F.round("success_rate", 9))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def agg_metric_windows(spark: SparkSession, d: str) -> DataFrame:
    return history.metric_windows(table(spark, d, "events"), "ts", "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, 'eval_' || event_type AS name, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.8), 6) AS q80 FROM events GROUP BY event_type")
def agg_metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(
        F.concat(F.lit("eval_"), F.first("event_type")).alias("name"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.round(F.percentile("value", 0.8), 6).alias("q80"),
    )


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def win_recent_log(spark: SparkSession, d: str) -> DataFrame:
    return recent_rows(table(spark, d, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM events")
def agg_running_mean(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 9).alias("running_mean"))


@query("SELECT round(avg((p = quality)::INT), 9) AS accuracy, count(*) AS n FROM (SELECT quality, (n_chars > 1000)::INT AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)")
def agg_exact_match(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    hit = ((F.col("n_chars") > 1000).cast("int") == F.col("quality")).cast("int")
    return j.agg(F.round(F.avg(hit), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("""SELECT d, u, round(u * 1.0 / d, 9) AS low_d, round(u * 1.0 / d * 1.33, 9) AS high_d, round(d * 1.0 / u / 1.33, 9) AS low_u, round(d * 1.0 / u, 9) AS high_u
FROM (SELECT greatest(sum(quality), 1)::BIGINT AS d, greatest(count(*) - sum(quality), 1)::BIGINT AS u FROM labels)""")
def agg_class_balance(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "labels").agg(F.greatest(F.sum("quality"), F.lit(1)).cast("long").alias("d"), F.greatest(F.count(F.lit(1)) - F.sum("quality"), F.lit(1)).cast("long").alias("u"))
    up, down = F.col("u") / F.col("d"), F.col("d") / F.col("u")
    return c.select("d", "u", F.round(up, 9).alias("low_d"), F.round(up * 1.33, 9).alias("high_d"), F.round(down / 1.33, 9).alias("low_u"), F.round(down, 9).alias("high_u"))


@query(f"""SELECT conv_id, turn, CASE WHEN n <= 5 THEN 0.9 WHEN n <= 10 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN regexp_matches(prompt, '^[A-M]') THEN 'early' WHEN regexp_matches(prompt, '^[N-Z]') THEN 'late' ELSE 'other' END AS rule,
 split_part(list_last(string_split(prompt, ' ')), '.', 1) AS last_part, md5(prompt) AS h FROM (SELECT *, len(list_filter(regexp_split_to_array(prompt, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM {PAIRS_SQL})""")
def scl_rough_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prompt")
    rule = F.when(p.rlike("^[A-M]"), "early").when(p.rlike("^[N-Z]"), "late").otherwise("other")
    return chat.chat_pairs(table(spark, d, "conversations")).select("conv_id", "turn", X.rough_confidence(p).alias("confidence"), rule.alias("rule"), X.after_marker(p, " ", ".").alias("last_part"), F.md5(p).alias("h"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, greatest(least(value, 50.0), 5.0) AS clamped, value * 1.0 / 1048576 AS mib, user_id % 4 AS epoch, [0.1, 0.2, 0.4][least(user_id % 4 + 1, 3)]::DOUBLE AS coef FROM events""")
def prj_schedule(spark: SparkSession, d: str) -> DataFrame:
    epoch = F.col("user_id") % 4
    coef = F.element_at(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.4)), F.least(epoch + 1, F.lit(3)).cast("int"))
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.greatest(F.least("value", F.lit(50.0)), F.lit(5.0)).alias("clamped"), (F.col("value") / 1048576).alias("mib"), epoch.alias("epoch"), coef.alias("coef"))
