"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import decontaminate, host_rules, html_crf, merkle, mixing, prefix_trie, quality, reply_trees, secrets, sharding, simhash, token_spans, zip_warc
from loomframe.llm._shared import materialize, read_table
from loomframe.operators.ordering import places


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_crf.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = zip_warc.round_trip(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = host_rules.host_quality(docs, carry=["doc_id"], store_features=True)
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return out.withColumnRenamed("id", "doc_id")


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard_rows(docs, shards=24, carry=["doc_id"])
    return out.select(
        "row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.section_tokens(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, carry=["doc_id"]).select("row.doc_id", "source", "n_tokens", "block", "epoch")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read_table(spark, sf_dir, "documents").select(*fields)
    # what is claimed of some rows differs from what the manifest was built of
    tampered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in fields]
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = docs.withColumn("claim", F.when(marked, F.unhex(merkle.leaf_digest(tampered))))
    out = merkle.proofs(merkle.build(docs, fields, "source", "doc_id", carry=["doc_id", "claim"]))
    leaf, root = merkle.as_hex(F.col("digest")), merkle.as_hex(F.col("root"))
    out = out.select(
        "row.doc_id",
        leaf.alias("leaf"),
        merkle.as_hex(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(merkle.as_hex(merkle.siblings(F.col("path"))), 256).alias("proof_sha256"),
        merkle.fold(F.coalesce(merkle.as_hex(F.col("row.claim")), leaf), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    turns = places(turns.unionByName(hard), ["conv_id"], ["turn", F.xxhash64("role", "text")], keep=materialize)
    # each turn replies to the one before it
    turns = turns.withColumn("parent", F.when(F.col("place") > 0, F.col("place") - 1))
    out = reply_trees.conversations(reply_trees.numbered(turns, "conv_id", "place", "parent", "role", "text"), best=1)
    said, learned = F.col("said"), F.col("learned")
    out = out.select("tree", "text", reply_trees.parsed(F.col("text")).alias("said"), F.array_join(reply_trees.learned_texts(F.col("text"), F.col("turns")), "").alias("learned"))
    lines = F.transform(said, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size(said).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").filter("conv_id is not null").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    turns = places(turns, ["conv"], ["turn", F.xxhash64("role", "text")], keep=materialize)
    turns = materialize(turns.select("conv", "place", "role", "text"), "turns")
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    # the first turns of another conversation stand before what is left of a conversation's own
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h")
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    members = sizes.select("conv", h, (F.col("conv") - F.col("conv") % 20).alias("base")).join(base, "base", "left")
    members = materialize(members.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))), "members")
    first = turns.filter("place < 3").withColumnRenamed("conv", "base")
    given = members.select("conv", "base", "taken").join(first, "base").filter("place < taken").select("conv", "place", "role", "text")
    own = turns.join(members.select("conv", "h", "taken"), "conv").filter("place >= h").withColumn("place", F.col("taken") + F.col("place") - F.col("h"))
    out = prefix_trie.prefix_trie(members.select("conv"), given.unionByName(own.select("conv", "place", "role", "text")))
    return out.withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_crf,
        op2_decontaminate,
        op3_zip_warc,
        op4_host_rules,
        op5_pairwise_quality,
        op6_feistel_shards,
        op7_simhash,
        op8_section_tokens,
        op9_mixing,
        op10_secrets,
        op11_merkle,
        op12_reply_trees,
        op13_prefix_trie,
    )
}

#: DuckDB's \s is wider than the contract's white space, so classes are spelled out.
ORACLES: dict[str, str] = {
    "op3_zip_warc": r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
-- 20 bits of a digest are five hexadecimal digits and four letters
q AS (SELECT rid, g, CAST('0x' || substr(x, 5 * g + 1, 5) AS BIGINT) AS v FROM d, range(8) t(g)),
l AS (
  SELECT rid, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (15 - 5 * j)) & 31)::INT + 1, 1), '' ORDER BY g, j) AS payload_digest
  FROM q, range(4) t(j) GROUP BY rid),
o AS (SELECT x, max(page_id) AS owner FROM d GROUP BY x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d JOIN l ON l.rid = d.rid JOIN o ON o.x = d.x""",
    "op4_host_rules": r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (
  SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
g AS (SELECT rid, i, list_aggregate(w[i:i+7], 'string_agg', ' ') AS s FROM p),
d AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g),
r AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM d WHERE c > 1),
c AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM r GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, host, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
         n_symbols::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c ON c.rid = w.rid),
x AS (
  SELECT *, coalesce(wc, 0) AS word_chars, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         (10 * n_symbols > n_words)::INT AS s1, (100 * n_dup_lines > 30 * n_lines)::INT AS s2,
         (coalesce(wc, 0) < 2 * n_words OR coalesce(wc, 0) > 15 * n_words)::INT AS s3 FROM f),
h AS (
  SELECT host, count(*) AS n, sum(base_failed::INT) AS f0, sum(s1) AS f1, sum(s2) AS f2, sum(s3) AS f3 FROM x GROUP BY host),
m AS (
  SELECT host, n, unnest([f0, f1, f2, f3]) AS f, unnest([0, 1, 2, 3]) AS k FROM h),
b AS (
  SELECT k, count(*) AS hosts, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS nn, sum(f)::DOUBLE AS f, sum(f * (f / n)) AS ff FROM m GROUP BY k),
q AS (
  SELECT k, f / n AS m, hosts, n - nn / n - (hosts - 1) AS beyond, ff - f * (f / n) AS spread FROM b),
o AS (
  SELECT k, m, CASE WHEN m > 0 AND m < 1 AND beyond > 0 THEN (spread / (m * (1 - m)) - (hosts - 1)) / beyond ELSE 0 END AS rho FROM q),
e AS (
  SELECT k, m, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2.0), 1000.0) ELSE 1000.0 END AS z FROM o),
v AS (
  SELECT host, bool_or((f + e.m * z) / (n + z) > 0.5) AS strict FROM m JOIN e ON e.k = m.k GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND s1 + s2 + s3 <= CASE WHEN strict THEN 0 ELSE 1 END) AS kept
FROM x JOIN v ON v.host = x.host""",
}

#: CRC-32 of a number's decimal digits, bit by bit, as DuckDB has no such function.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""
FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"

ORACLES["op11_merkle"] = f"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         {FIELD_SQL.format('doc_id')} || {FIELD_SQL.format('source')} || {FIELD_SQL.format('lang')} || {FIELD_SQL.format('n_chars')} AS h,
         {FIELD_SQL.format('text')} AS t, translate(text, '{UPPER}', '{LOWER}') AS low,
         coalesce({CRC32_SQL.format('doc_id')} % 5 = 0, false) AS tampered FROM documents),
l AS (
  SELECT rid, doc_id, source, sha256(h || t) AS leaf, CASE WHEN tampered THEN sha256(h || {FIELD_SQL.format('low')}) ELSE sha256(h || t) END AS claim FROM f),
p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
a AS (
  SELECT 0 AS lev, source, i, n, leaf AS d FROM p
  UNION ALL
  SELECT lev + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY lev, source, i // 16, n),
s AS (
  SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (
  SELECT 0 AS lev, i, n, d FROM s
  UNION ALL
  SELECT lev + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY lev, i // 16, n),
ra AS (SELECT lev, source, i // 16 AS up, list(d ORDER BY i) AS ds FROM a WHERE n > 1 GROUP BY lev, source, i // 16),
rb AS (SELECT lev, i // 16 AS up, list(d ORDER BY i) AS ds FROM b WHERE n > 1 GROUP BY lev, i // 16),
u AS (
  SELECT rid, source, 0 AS lev, i, n, claim AS node, '' AS others FROM p
  UNION ALL
  SELECT u.rid, u.source, u.lev + 1, u.i // 16, (u.n + 15) // 16,
         sha256(list_aggregate(list_concat(ds[1:(u.i % 16)::INT], [u.node], ds[(u.i % 16 + 2)::INT:]), 'string_agg', '')),
         u.others || coalesce(list_aggregate(list_concat(ds[1:(u.i % 16)::INT], ds[(u.i % 16 + 2)::INT:]), 'string_agg', ''), '')
  FROM u JOIN ra ON ra.lev = u.lev AND ra.source IS NOT DISTINCT FROM u.source AND ra.up = u.i // 16 WHERE u.n > 1),
v AS (
  SELECT u.rid, 0 AS lev, s.i, s.n, u.node, u.others FROM u JOIN s ON s.source IS NOT DISTINCT FROM u.source WHERE u.n = 1
  UNION ALL
  SELECT v.rid, v.lev + 1, v.i // 16, (v.n + 15) // 16,
         sha256(list_aggregate(list_concat(ds[1:(v.i % 16)::INT], [v.node], ds[(v.i % 16 + 2)::INT:]), 'string_agg', '')),
         v.others || coalesce(list_aggregate(list_concat(ds[1:(v.i % 16)::INT], ds[(v.i % 16 + 2)::INT:]), 'string_agg', ''), '')
  FROM v JOIN rb ON rb.lev = v.lev AND rb.up = v.i // 16 WHERE v.n > 1)
SELECT p.doc_id, p.leaf, s.d AS subroot, b.d AS root, sha256(v.others) AS proof_sha256, v.node AS folded_root, v.node = b.d AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN v ON v.rid = p.rid AND v.n = 1 JOIN b ON b.n = 1"""

# the escapes add a character for each backslash, end of a turn and second #; a role's colons too
ESCAPED_SQL = r"""length({0}) + (length({0}) - length(replace({0}, '\', ''))) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7
  + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#+'), lambda x: (length(x) - 1) // 2)), 0)"""
ORACLES["op12_reply_trees"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
         sum(14 + {ESCAPED_SQL.format('role')} + length(role) - length(replace(role, ':', '')) + {ESCAPED_SQL.format('text')}) AS n FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, n::BIGINT AS formatted_chars FROM g"""

ORACLES["op13_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT c, c - c % 20 AS b, {CRC32_SQL.format('c')} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT m.c, 0 AS own, t.i, t.role, t.text FROM m JOIN t ON t.c = m.b AND t.i < m.h
  UNION ALL SELECT m.c, 1, t.i, t.role, t.text FROM m JOIN t ON t.c = m.c AND t.i >= m.h),
-- lengths before the values make the code of a prefix a prefix of the codes of what begins with it
e AS (
  SELECT c, row_number() OVER w AS d, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS k,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words, text FROM r WINDOW w AS (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING)),
x AS (SELECT c, d, k, lag(k, 1, '') OVER (PARTITION BY c ORDER BY d) AS up, n_words FROM e UNION ALL SELECT c, 0, '', NULL, 0 FROM m),
z AS (SELECT c, max(d) AS d FROM x GROUP BY c),
q AS (
  SELECT k, max(up) AS up, max(x.d) AS d, min(x.c) AS c, count(*) AS n, max(n_words) AS n_words,
         coalesce(string_agg(CASE WHEN z.d = x.d THEN x.c::VARCHAR END, ',' ORDER BY x.c), '') AS ends FROM x JOIN z ON z.c = x.c GROUP BY k),
o AS (SELECT up AS k, count(*) AS n FROM q WHERE up IS NOT NULL GROUP BY up),
a AS (
  SELECT q.k, count(*) FILTER (o.n IS NULL) AS n_leaves, sum((w.n - 1) * w.n_words) AS saved FROM q JOIN q w ON starts_with(w.k, q.k) LEFT JOIN o ON o.k = w.k GROUP BY q.k)
SELECT q.c AS conv_id, q.d::BIGINT AS depth, p.c AS parent_conv_id, q.n AS n_convs, coalesce(o.n, 0)::BIGINT AS n_children, a.n_leaves::BIGINT AS n_leaves,
       a.saved::BIGINT AS saved_tokens, sha256(q.ends) AS ends_sha256
FROM q JOIN a ON a.k = q.k LEFT JOIN q p ON p.k = q.up LEFT JOIN o ON o.k = q.k"""
