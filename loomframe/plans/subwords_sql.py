"""DuckDB SQL that encodes texts by the ranks of the public vocabulary, for checking."""

from __future__ import annotations

from loomframe.operators.subwords import CONTRACTIONS, RUNS, SPACE, VOCABULARY

#: A character of private use, which the tables don't hold, before the last of several spaces: RE2 can't look ahead.
CUT = "chr(57344)"
SPLIT = f"regexp_replace(coalesce(txt, ''), '([{SPACE}])([{SPACE}][^{SPACE}])', '\\1' || {CUT} || '\\2', 'g')"
PIECE = f"({CONTRACTIONS}|{RUNS}|[{SPACE}]+)".replace("'", "''")


def with_ids(source: str, **texts: str) -> str:
    """A derived table: the source's columns and for each text expression a list of token ids."""
    each = " UNION ALL ".join(f"SELECT rid, '{k}' AS col, {e} AS txt FROM src" for k, e in texts.items())
    joins = " ".join(f"LEFT JOIN q q_{k} ON q_{k}.rid = src.rid AND q_{k}.col = '{k}'" for k in texts)
    lists = ", ".join(f"coalesce(q_{k}.ids, []) AS {k}" for k in texts)
    return f"""(WITH RECURSIVE src AS (SELECT *, row_number() OVER () AS rid FROM {source}),
 ranks AS (SELECT hex(from_base64(t)) AS t, r FROM read_csv('{VOCABULARY.removeprefix("file://")}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'INT'}})),
 pc AS (SELECT rid, col, flatten(list_transform(string_split({SPLIT}, {CUT}), lambda x: regexp_extract_all(x, '{PIECE}'))) AS pieces FROM ({each})),
 b AS (
  SELECT piece, list_transform(range(0, octet_length(encode(piece))), lambda i: substr(hex(encode(piece)), (2 * i + 1)::INT, 2)) AS parts FROM (SELECT DISTINCT unnest(pieces) AS piece FROM pc)
  UNION ALL
  SELECT piece, list_concat(parts[:i - 1], [parts[i] || parts[i + 1]], parts[i + 2:]) FROM (
   SELECT piece, any_value(parts) AS parts, arg_min(i, r * 100000::BIGINT + i) AS i FROM (SELECT piece, parts, unnest(range(1, len(parts))) AS i FROM b)
   JOIN ranks ON t = parts[i] || parts[i + 1] GROUP BY piece)),
 f AS (SELECT piece, arg_min(parts, len(parts)) AS parts FROM b GROUP BY piece),
 e AS (SELECT piece, list(r ORDER BY i) AS ids FROM (SELECT piece, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM f) JOIN ranks ON t = p GROUP BY piece),
 q AS (SELECT rid, col, flatten(list(ids ORDER BY i)) AS ids FROM (SELECT rid, col, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM pc) x JOIN e ON e.piece = x.piece GROUP BY rid, col)
 SELECT src.* EXCLUDE (rid), {lists} FROM src {joins})"""
