"""Queries on generated corpora, files and reshaped tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import text as X
from loomframe.functions import tokens as K
from loomframe.operators import chat, generation, sequences, subwords
from loomframe.plans.corpus import PAIRS_SQL, UNIT
from loomframe.plans.registry import query
from loomframe.plans.sequences import TOKENS_SQL, token_pairs
from loomframe.plans.tables import table
from loomframe.sources import files, lines, log, schemas
from loomframe.sources.shared import scratch_path


def values(rows) -> str:
    spell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(spell, r)) + ")" for r in rows)


POOLS_SQL = f"""(SELECT kind, instruction, command FROM (VALUES {values((k, i, c) for k, i, c, named in generation.container_patterns() if not named)}) v(kind, instruction, command)
UNION ALL SELECT kind, replace(instruction, '{{name}}', s_name), replace(command, '{{name}}', s_name) FROM (VALUES {values((k, i, c) for k, i, c, named in generation.container_patterns() if named)}) v(kind, instruction, command), supplier)"""
CONTAINER_SQL = f"""WITH s(kind, share) AS (VALUES {values(generation.CONTAINER_SHARES)}), x AS {POOLS_SQL},
r AS (SELECT x.*, floor(share * (SELECT 20 * count(*) FROM supplier))::INT AS quota, row_number() OVER (PARTITION BY x.kind ORDER BY md5('d4|' || command || '|' || instruction), command || '|' || instruction) AS rank FROM x JOIN s ON s.kind = x.kind)
SELECT kind, instruction, command FROM r WHERE rank <= quota"""


def services(spark: SparkSession, d: str) -> DataFrame:
    """The names of services: those of the suppliers."""
    return table(spark, d, "supplier").select(F.col("s_name").alias("name"))


@query(CONTAINER_SQL)
def gen_container_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Twenty examples for each service, in the corpus's shares, of pools that hold every service."""
    names = services(spark, d)
    shares = spark.createDataFrame(list(generation.CONTAINER_SHARES), "kind string, share double")
    key = F.concat_ws("|", "command", "instruction")
    return generation.sample_pools(generation.named_pool(names), shares, 20 * names.count(), "d4", key).select("kind", "instruction", "command")


@query(f"SELECT kind, count(*) AS n, count(DISTINCT command) AS n_commands, count(DISTINCT instruction) AS n_instructions FROM {POOLS_SQL} GROUP BY kind")
def gen_container_pools(spark: SparkSession, d: str) -> DataFrame:
    return generation.pool_sizes(services(spark, d))


@query(f"SELECT 'Translate this to a docker command: ' || instruction AS instruction, '' AS input, command AS output FROM ({CONTAINER_SQL})")
def gen_corpus_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The sampled corpus, shuffled, written as JSON lines and read back."""
    corpus = gen_container_corpus(spark, d)
    corpus = corpus.select("kind", F.concat(F.lit("Translate this to a docker command: "), "instruction").alias("instruction"), F.lit("").alias("input"), F.col("command").alias("output"))
    path = scratch_path(spark, "corpus")
    generation.write_corpus(corpus, path, "s9", "kind", "instruction")
    return files.read_jsonl(spark, path)


TOOL_SCHEMA = "kind string, t int, pattern string, command string, base double, explanation string"


def slotted(column: str) -> str:
    """SQL that fills the slots of a column by the drawn values."""
    for s in generation.SLOTS:
        column = f"replace({column}, '{{{s}}}', v_{s})"
    return column


#: Slots whose values are the rows of a table: names are nations, projects are parts.
FROM_TABLES = ("name", "project")
DRAWS_SQL = ", ".join(f"[{', '.join(repr(x) for x in v)}][floor({UNIT.format(chr(39) + s + '|' + chr(39) + ' || kind || ' + chr(39) + '|' + chr(39) + ' || i')} * {len(v)})::INT + 1] AS v_{s}" for s, v in generation.SLOTS.items() if s not in FROM_TABLES)


def numbered(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Values of slots, numbered."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value"))
    parts = sequences.positions(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("value")), "p_partkey").withColumnRenamed("position", "k")
    return {"name": nations, "project": parts.select("k", "value")}


@query(f"""WITH s(kind, share) AS (VALUES {values(generation.TOOL_SHARES)}), t(kind, t, pattern, command, base, explanation) AS (VALUES {values(generation.tool_templates())}),
c AS (SELECT kind, count(*) AS m FROM t GROUP BY kind), q AS (SELECT s.kind, m, unnest(range(floor(share * (SELECT count(*) FROM customer))::BIGINT))::INT AS i FROM s JOIN c ON c.kind = s.kind),
n AS (SELECT n_nationkey AS k, n_name AS v_name FROM nation), p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS k, p_name AS v_project FROM part),
x AS (SELECT kind, i, floor({UNIT.format("'t|' || kind || '|' || i")} * m)::INT AS t, {UNIT.format("'c|' || kind || '|' || i")} AS u, {DRAWS_SQL},
 floor({UNIT.format("'name|' || kind || '|' || i")} * (SELECT count(*) FROM nation))::INT AS kn, floor({UNIT.format("'project|' || kind || '|' || i")} * (SELECT count(*) FROM part))::INT AS kp FROM q)
SELECT x.kind, i, {slotted('pattern')} AS instruction, {slotted('command')} AS command, {slotted('explanation')} AS explanation, round(base + (-0.03 + 0.05 * u), 6)::DOUBLE AS confidence
FROM x JOIN t ON t.kind = x.kind AND t.t = x.t JOIN n ON n.k = x.kn JOIN p ON p.k = x.kp""")
def gen_tool_corpus(spark: SparkSession, d: str) -> DataFrame:
    """As many examples as there are customers, with names and projects from tables."""
    templates = spark.createDataFrame(generation.tool_templates(), TOOL_SCHEMA)
    shares = spark.createDataFrame(list(generation.TOOL_SHARES), "kind string, share double")
    n = table(spark, d, "customer").count()
    return generation.draw_templates(templates, shares, n, tables=numbered(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH t(kind, t, pattern, command, base, explanation) AS (VALUES {values(generation.tool_templates())})
SELECT kind, count(*) AS n, count(DISTINCT replace(pattern, '{{name}}', n_name)) AS n_instructions, count(DISTINCT replace(command, '{{name}}', n_name)) AS n_commands FROM t, nation GROUP BY kind""")
def gen_tool_templates(spark: SparkSession, d: str) -> DataFrame:
    """The tool's templates with the name of each nation in their slot."""
    templates = spark.createDataFrame(generation.tool_templates(), TOOL_SCHEMA)
    x = table(spark, d, "nation").select(F.col("n_name").alias("name")).crossJoin(F.broadcast(templates))
    return x.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(X.fill(F.col("pattern"), name=F.col("name"))).alias("n_instructions"), F.countDistinct(X.fill(F.col("command"), name=F.col("name"))).alias("n_commands")
    )


@query("""SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS image, 8000 + p_size AS port, CASE WHEN p_size % 2 = 0 THEN '-d' ELSE '-d --rm' END AS flags,
 'docker run ' || flags || ' -p ' || port || ' ' || image AS command FROM part""")
def gen_pool_configs(spark: SparkSession, d: str) -> DataFrame:
    """Each image (a brand) with the configurations that its parts allow, as a pool, and one command for each."""
    part = table(spark, d, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("image"), (8000 + F.col("p_size")).alias("port"), F.when(F.col("p_size") % 2 == 0, "-d").otherwise("-d --rm").alias("flags"))
    # a brand has as many configurations as there are sizes at most
    pools = part.distinct().groupBy("image").agg(F.array_sort(F.collect_list(F.struct("port", "flags"))).alias("configs"))
    x = generation.explode_pool(pools, "image", "configs")
    return x.withColumn("command", F.concat(F.lit("docker run "), "flags", F.lit(" -p "), F.col("port").cast("string"), F.lit(" "), "image"))


@query(f"SELECT md5('Translate: ' || prompt) AS instruction, '' AS input, md5('COMMAND: ' || completion) AS output FROM {PAIRS_SQL}")
def src_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "alpaca")
    p = chat.chat_pairs(table(spark, d, "conversations"))
    files.write_jsonl(p.select(F.concat(F.lit("Translate: "), "prompt").alias("instruction"), F.lit("").alias("input"), F.concat(F.lit("COMMAND: "), "completion").alias("output")), path)
    return files.read_jsonl(spark, path).select(F.md5("instruction").alias("instruction"), "input", F.md5("output").alias("output"))


@query(r"SELECT md5(norm) AS block FROM (SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS norm FROM documents) WHERE norm <> '' ORDER BY doc_id LIMIT 100")
def snk_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "blocks")
    docs = table(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("norm")).filter("norm <> ''")
    files.write_blocks(docs, "norm", "doc_id", path)
    return files.read_blocks(spark, path).select(F.md5("value").alias("block"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def snk_table_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "table")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    files.write_table(e, path)
    return spark.read.schema(e.schema).option("header", True).csv(path)


@query()
def src_listing(spark: SparkSession, d: str) -> DataFrame:
    return files.list_files(spark, d, "*.parquet")


@query("SELECT doc_id, md5(text) AS h FROM documents ORDER BY doc_id DESC LIMIT 150")
def src_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")).orderBy(F.desc("doc_id")).limit(150)


def _json_lines(spark: SparkSession, df: DataFrame, order: str) -> str:
    """A folder of JSON lines in several files, in an order."""
    path = scratch_path(spark, "lines")
    df.repartitionByRange(order).sortWithinPartitions(order).write.json(path)
    return path


@query("SELECT (SELECT count(*) FROM documents) - row_number() OVER (ORDER BY doc_id DESC) AS line, doc_id, md5(text) AS h FROM documents ORDER BY doc_id DESC LIMIT 150")
def src_tail_lines(spark: SparkSession, d: str) -> DataFrame:
    """The last 150 lines of several files by their place."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    last = lines.last_lines(spark, _json_lines(spark, docs, "doc_id"), 150).withColumn("r", F.from_json("value", docs.schema))
    return last.select("line", "r.doc_id", F.md5("r.text").alias("h"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS line FROM embeddings)
SELECT line, doc_id, vec_id FROM a FULL JOIN b USING (line)""")
def jn_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two sets of files side by side."""
    docs, vectors = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "embeddings").select("vec_id", "label")
    both = lines.zip_lines(spark, _json_lines(spark, docs, "doc_id"), _json_lines(spark, vectors, "vec_id"))
    return both.select("line", F.get_json_object("left", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("right", "$.vec_id").cast("long").alias("vec_id"))


@query("""SELECT 'rows' AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids, round(sum(CASE WHEN lang = 'en' THEN n_chars ELSE n_chars / 4.0 END), 2)::DOUBLE AS chars FROM documents WHERE lang <> 'fr'
UNION ALL SELECT 'broken', count(*), NULL, sum(length('{"doc_id":' || doc_id))::DOUBLE FROM documents WHERE lang = 'fr'""")
def src_schema_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Files whose numbers are whole in some and not in others, and some with broken lines, read without a schema."""
    docs, path = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), scratch_path(spark, "shapes")
    docs.filter("lang = 'en'").write.json(f"{path}/whole")
    docs.filter("lang not in ('en', 'fr')").withColumn("n_chars", F.col("n_chars") / 4.0).write.json(f"{path}/parts")
    docs.filter("lang = 'fr'").select(F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"))).write.text(f"{path}/broken")
    found = schemas.discover(spark, [f"{path}/{x}" for x in ("whole", "parts", "broken")])
    rows = found.rows.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").cast("long").alias("ids"), F.round(F.sum("n_chars").cast("double"), 2).alias("chars"))
    broken = found.broken.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("ids"), F.sum(F.length("value")).cast("double").alias("chars"))
    return rows.withColumn("part", F.lit("rows")).unionByName(broken.withColumn("part", F.lit("broken")))


@query("SELECT event_id, user_id, event_type, value FROM events")
def snk_event_log(spark: SparkSession, d: str) -> DataFrame:
    """Batches appended to a log, one of them delivered twice."""
    path = scratch_path(spark, "log")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for k in (0, 1, 2, 1):
        log.append(e.filter(F.pmod("event_id", F.lit(3)) == k), path, batch=f"third-{k}")
    return log.read(spark, path, "event_id long, user_id long, event_type string, value double")


@query("""WITH a AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents), b AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings)
SELECT a.position::BIGINT AS position, doc_id, lang, vec_id, label FROM a LEFT JOIN b ON b.position = a.position""")
def jn_positional(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    return sequences.zip_rows(table(spark, d, "documents").select("doc_id", "lang"), vectors, "doc_id", "vec_id").select("position", "doc_id", "lang", "vec_id", "label")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents), b AS (SELECT label, row_number() OVER (ORDER BY vec_id) AS p FROM embeddings)
SELECT doc_id, label AS extra FROM a LEFT JOIN b ON a.p = b.p""")
def prj_add_column(spark: SparkSession, d: str) -> DataFrame:
    return sequences.add_column(table(spark, d, "documents").select("doc_id"), "doc_id", "extra", table(spark, d, "embeddings"), "vec_id", "label")


@query("""SELECT doc_id, '{"doc_id":' || doc_id || CASE WHEN lang = 'en' THEN ',"lang":"en"' ELSE '' END || CASE WHEN n_chars > 500 THEN ',"n_chars":' || n_chars ELSE '' END || '}' AS js, CASE WHEN n_chars > 500 THEN n_chars END::BIGINT AS n_chars FROM documents""")
def prj_strip_nulls(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "en").alias("lang"), F.when(F.col("n_chars") > 500, F.col("n_chars").cast("long")).alias("n_chars"))
    js = docs.select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("js"))
    return js.select("doc_id", "js", F.from_json("js", "n_chars long")["n_chars"].alias("n_chars"))


@query(f"SELECT conv_id, turn, prompt, completion AS policy, reverse(completion) AS reference FROM {PAIRS_SQL}")
def prj_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    pairs = chat.chat_pairs(table(spark, d, "conversations"))
    told = pairs.select("conv_id", "turn", "prompt", F.concat("prompt", "completion").alias("policy"), F.concat("prompt", F.reverse("completion")).alias("reference"))
    return told.select("conv_id", "turn", "prompt", X.without_prompt(F.col("policy"), F.col("prompt")).alias("policy"), X.without_prompt(F.col("reference"), F.col("prompt")).alias("reference"))


@query(f"SELECT conv_id, turn, prompt AS decoded FROM {PAIRS_SQL}")
def tok_decode(spark: SparkSession, d: str) -> DataFrame:
    """Prompts from their subword tokens."""
    return subwords.decoded(token_pairs(spark, d), ["conv_id", "turn"], "p", subwords.vocabulary(spark))


@query(f"SELECT CASE WHEN len(w) > 1 THEN w[2] ELSE prompt END AS sub, count(*) AS n FROM (SELECT prompt, list_filter(regexp_split_to_array(prompt, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {PAIRS_SQL}) GROUP BY 1")
def agg_subcommand_counts(spark: SparkSession, d: str) -> DataFrame:
    return chat.chat_pairs(table(spark, d, "conversations")).groupBy(X.subcommand(F.col("prompt")).alias("sub")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS n_rejected, round(avg(l_tax) FILTER (l_returnflag = 'R'), 9) AS rejected, round(avg(l_tax) FILTER (l_returnflag <> 'R'), 9) AS chosen,
 round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS weighted, round(exp(avg(l_discount)), 9) AS perplexity FROM lineitem GROUP BY l_linestatus""")
def agg_scores_by_label(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("l_returnflag") == "R"
    r = lambda c, n: F.round(c, 9).alias(n)
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.count_if(bad).alias("n_rejected"), r(F.avg(F.when(bad, F.col("l_tax"))), "rejected"), r(F.avg(F.when(~bad, F.col("l_tax"))), "chosen"),
        r(F.sum(F.col("l_tax") * F.col("l_quantity")) / F.sum("l_quantity"), "weighted"), r(F.exp(F.avg("l_discount")), "perplexity"),
    )


@query(" UNION ALL ".join(f"(SELECT {e} AS epoch, doc_id FROM documents ORDER BY md5('e{e}|' || doc_id), doc_id LIMIT 50)" for e in range(3)))
def srt_epoch_samples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    parts = [generation.take_some(docs, "doc_id", 50, f"e{e}").select(F.lit(e).alias("epoch"), "doc_id") for e in range(3)]
    return reduce(DataFrame.unionByName, parts)


PAD = "array_to_string(list_concat({0}, list_transform(range(greatest(96 - len({0}), 0)), lambda x: 0)), ',')"


@query(f"SELECT conv_id, turn, 'chosen' AS part, {PAD.format('p')} AS ids FROM {TOKENS_SQL} UNION ALL SELECT conv_id, turn, 'rejected', {PAD.format('c')} FROM {TOKENS_SQL}")
def set_stack_padded(spark: SparkSession, d: str) -> DataFrame:
    t = token_pairs(spark, d)
    ids = lambda c: F.array_join(F.transform(K.pad_right(F.col(c), 96, 0), lambda x: x.cast("string")), ",").alias("ids")
    return t.select("conv_id", "turn", F.lit("chosen").alias("part"), ids("p")).unionByName(t.select("conv_id", "turn", F.lit("rejected").alias("part"), ids("c")))


@query(f"SELECT conv_id, turn, {PAD.format('p')} AS chosen, {PAD.format('c')} AS rejected FROM {TOKENS_SQL}")
def set_unstack(spark: SparkSession, d: str) -> DataFrame:
    half = lambda k: F.max(F.when(F.col("part") == k, F.col("ids"))).alias(k)
    return set_stack_padded(spark, d).groupBy("conv_id", "turn").agg(half("chosen"), half("rejected"))
