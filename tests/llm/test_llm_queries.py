"""The registered queries of the training-data operators: their columns and rows against SQL or brute force."""

import base64
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash

from pyspark.sql import functions as F

from loomframe.llm import html_crf, mixing, quality, queries, secrets, sharding, token_spans

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def table(name, columns="*"):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def run(spark):
    held = {}

    def rows(name):
        if name not in held:
            df = queries.QUERIES[name](spark, SF)
            held[name] = df, df.collect()
        return held[name]

    return rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(run, name):
    df, got = run(name)
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = c.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    assert sorted((tuple(r[x] for x in cols) for r in got), key=str) == sorted(c.sql(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall(), key=str)


def test_op1(run):
    df, got = run("op1_html_crf")
    assert dict(df.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    model = html_crf.default_model()
    html = {i: (u, h) for i, u, h in table("pages", "page_id, url, html")}
    assert sorted(r.page_id for r in got) == sorted(html)
    for r in got:
        assert r.url == html[r.page_id][0] and r.n_chars == len(r.text) and r.text == html_crf.main_text(model, html[r.page_id][1])


def test_op2(run):
    from test_operators import unseeded

    df, got = run("op2_decontaminate")
    assert {"doc_id", "item_id", "score"} <= set(df.columns)
    docs = [(i, t) for i, t in table("documents", "doc_id, text") if len(t or "") < 8000]
    small = {i for i, _ in docs}
    want = unseeded(docs, table("benchmark", "item_id, text"))
    assert {(r.doc_id, r.item_id): r.score for r in got if r.doc_id in small} == want


def test_op3(run):
    _, got = run("op3_zip_warc")
    pages = {i: (h or "").encode() for i, h in table("pages", "page_id, html")}
    owner = {}
    for i, p in pages.items():
        owner[p] = max(owner.get(p, i), i)
    for r in got:
        p = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if owner[p] == r.page_id else ("revisit", owner[p]))
    assert len(got) == len(pages)


def test_op5(spark, run):
    df, got = run("op5_pairwise_quality")
    docs = dict(table("documents", "doc_id, text"))
    labels = table("labels", "doc_id, quality")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    train = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in docs]
    train.sort()
    model = quality.Ranker(np.array([quality.describe(docs[i]) for i, _ in train]), np.array([y for _, y in train]))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)
        assert abs(r.score - model.scores(quality.describe(docs[r.doc_id])[None])[0]) < 1e-9


def test_op5_loss_and_quantile():
    r = np.random.default_rng(3)
    d, w = r.normal(size=(50, 4)), r.normal(size=4)
    loss, g = quality.pair_loss(d, w)
    assert abs(loss - np.mean([math.log(1 + math.exp(-x @ w)) for x in d]) - 5e-5 * (w @ w)) < 1e-12
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert abs((quality.pair_loss(d, w + step)[0] - quality.pair_loss(d, w - step)[0]) / 2e-6 - g[k]) < 1e-6
    x = r.normal(size=(300, 27))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * r.normal(size=300) > -0.8).astype(int)
    model = quality.Ranker(x, y)
    z = model.basis(x)
    pairs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    # a full-batch descent on all pairs finds hardly less loss
    best = model.w.copy()
    for _ in range(300):
        best -= 0.5 * quality.pair_loss(pairs, best)[1]
    assert quality.pair_loss(pairs, model.w)[0] < quality.pair_loss(pairs, best)[0] + 0.02
    # the quantile at the bad rows' share parts the classes
    assert abs((model.scores(x) < 0.5).sum() - (y == 0).sum()) <= 1
    assert ((model.scores(x) >= 0.5) == (y == 1)).mean() > 0.9


def test_op5_awkward_rows(spark):
    rows = [(k, "fine words here. " * 5 if k % 3 else "## || $$ " * 9, "clash") for k in range(60)] + [(2, "fine words", "clash")] * 50 + [(None, None, "x"), (70, "long " * 300_000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)] + [(2, 0), (2, None)], "doc_id long, quality int")
    model = quality.fit(d, labels, max_rows=30)
    got = quality.score(d, model)
    assert got.columns == ["id", "held_out", "score", "predicted"] and got.count() == len(rows)
    one = quality.Ranker(np.ones((3, 27)), np.ones(3, int))
    assert (one.scores(np.ones((1, 27))) >= 0.5).all()


def test_op6(spark, run):
    df, got = run("op6_feistel_shards")
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    docs = {i: (t or "").encode() for i, t in table("documents", "doc_id, text")}
    slots = {k: [] for k in range(24)}
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id]), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # shard and slot can be computed from the row number, and the row from them
    from loomframe.llm._shared import read_table

    numbered = sharding.shard_rows(read_table(spark, SF, "documents"), carry=["doc_id"]).collect()
    n = np.array([r.row_number for r in numbered])
    p = sharding.feistel(n, len(n), 20)
    assert [(r.shard, r.slot) for r in numbered] == [(int(x % 24), int(x // 24)) for x in p]
    assert (sharding.unfeistel(np.array([24 * r.slot + r.shard for r in numbered]), len(n), 20) == n).all()
    assert {(r.row.doc_id, r.shard, r.slot) for r in numbered} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_op7(run):
    _, got = run("op7_simhash")
    docs = dict(table("documents", "doc_id, text"))
    fp = {}
    for i, t in docs.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in sorted(docs)}
    changed = True
    while changed:
        changed = False
        for a in docs:
            least = min(group[b] for b in docs if (fp[a] ^ fp[b]).bit_count() <= 3)
            changed |= least != group[a]
            group[a] = least
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", group[i]) for i in docs}


def brute_tokens(text, rule):
    """Tokens of each line by going through all bytes of all tokens."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(token_spans.VOCABULARY, "rb").read().splitlines())}
    encoding = tiktoken.Encoding("t", pat_str=token_spans.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lines = re.findall(r"[^\n]*\n|[^\n]+", text or "") or [""]
    owner = [k for k, x in enumerate(lines) for _ in x.encode()]
    out, at = [0.0] * len(lines), 0
    for token in encoding.encode_ordinary(text or ""):
        size = len(encoding.decode_single_token_bytes(token))
        held = owner[at : at + size]
        if rule == "start":
            out[held[0]] += 1
        elif rule == "most":
            out[max(sorted(set(held)), key=held.count)] += 1
        else:
            for k in held:
                out[k] += 1 / size
        at += size
    return [(k, len(x.encode()), n) for k, (x, n) in enumerate(zip(lines, out, strict=True))]


def test_op8(run):
    _, got = run("op8_section_tokens")
    rows = {}
    for r in got:
        rows.setdefault(r.doc_id, []).append((r.section, r.n_bytes, r.n_tokens))
    docs = dict(table("documents", "doc_id, text"))
    assert set(rows) == set(docs)
    for i in sorted(docs, key=lambda i: len(docs[i] or ""))[:40]:
        assert sorted(rows[i]) == brute_tokens(docs[i], "start")


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_op8_rules_and_awkward_rows(spark, rule):
    # tokens of several newlines, and characters of several bytes, cross the bounds of lines
    texts = ["a\n\n\n\nb \n\n c", "", None, "é😀\n\n\n\n日本語\n\n", "\n", " " * 100 + "\n" * 50 + "x", "x\n" * 3]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "a\nb", "x", 2), (0, texts[0], "clash", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, section string, n_tokens int")
    got = {}
    for r in token_spans.section_tokens(d, rule=rule).collect():
        got.setdefault(r.id, []).append((r.section, r.n_bytes, round(r.n_tokens, 9)))
    for k, t in [*enumerate(texts), (None, "a\nb")]:
        want = [(a, b, round(n, 9)) for a, b, n in brute_tokens(t, rule)]
        assert sorted(got[k]) == sorted(want * (2 if k == 0 else 1))


def test_op8_long_white_space():
    """A run of ten million spaces or words of millions of letters end neither the worker nor the hour."""
    encoder = token_spans.Encoder(open(token_spans.VOCABULARY, "rb").read())
    plain = encoder.ready()[0]
    for text in ["a" + " " * 40 + "b", " \n" * 30 + "c", "x" + "  " * 50, " " * 33, "q " + "\n" * 64 + "'s", "a\x1c" * 20 + "\x1c " * 40 + "b", "　" * 99 + "1"]:
        assert encoder.encode(text) == plain.encode_ordinary(text)
    assert len(encoder.encode("a" + " " * 10_000_000 + "b")) == 10_000_001
    assert len(encoder.encode("x" * 2_000_000)) > 1000


def test_op9(spark, run):
    """All rows: exponent, budgets, and the blocks that a partial reading takes."""
    _, got = run("op9_mixing")
    from loomframe.llm._shared import read_table

    d = read_table(spark, SF, "documents")
    keys = {r.doc_id: r.k for r in d.select("doc_id", F.xxhash64(F.lit(7), "doc_id", F.col("text").cast("string")).alias("k")).collect()}
    docs = [(i, s or "", len(WORD.findall(t or "")), keys[i]) for i, t, s in table("documents", "doc_id, text, source")]
    tokens, count = {}, {}
    for _, s, n, _ in docs:
        tokens[s], count[s] = tokens.get(s, 0) + n, count.get(s, 0) + 1
    total = sum(tokens.values())
    lp = {s: math.log(t / total) for s, t in tokens.items() if t}
    gap = max(lp.values()) - min(lp.values())
    closed = max(0.0, 1 - math.log(2) / gap) if gap else 0.0
    exponent = mixing.find_exponent(spark.createDataFrame([(t,) for t in tokens.values()], "tokens long"))
    assert abs(exponent - closed) < 1e-8
    raw = {s: (t / total) ** exponent if t else 0.0 for s, t in tokens.items()}
    cover = max(t / raw[s] for s, t in tokens.items() if t)
    want = {}
    for s, t in tokens.items():
        quota = round(raw[s] * cover)
        epochs = quota // t if t else 1
        rest = max(quota - epochs * t, 0)
        blocks = {}
        for i, x, n, k in docs:
            if x == s:
                blocks.setdefault(k % math.ceil(count[s] / mixing.BLOCK_ROWS), []).append((k, i, n))
        before = 0
        for b in sorted(blocks):
            for _, i, n in sorted(blocks[b]):
                want[i] = (s, n, b, epochs + (before < rest))
                before += n
    read = {}
    for r in got:
        read.setdefault((r.doc_id, r.source, r.n_tokens, r.block), []).append(r.epoch)
    assert {k[0]: (*k[1:], len(e)) for k, e in read.items()} == {i: x for i, x in want.items() if x[3]}
    assert all(sorted(e) == list(range(len(e))) for e in read.values())


def test_op10(run):
    """Base spans by plain scanning, the digest, and the order of all spans."""
    _, got = run("op10_secrets")
    model, threshold = secrets.default_model()
    docs = dict(table("documents", "doc_id, text"))
    assert sorted(r.doc_id for r in got) == sorted(docs)
    name = re.compile(r"(?i:password|passwd|secret|token|api_?key)", re.A)
    for r in got:
        t = docs[r.doc_id] or ""
        spans, at = [], 0
        while m := name.search(t, at):
            k = m.end() + (t[m.end() : m.end() + 1] in ("'", '"') and m.end() < len(t))
            while t[k : k + 1] == " ":
                k += 1
            at = m.start() + 1
            if t[k : k + 1] in (":", "=") and k < len(t):
                k += 1
                while t[k : k + 1] == " ":
                    k += 1
                k += t[k : k + 1] in ("'", '"') and k < len(t)
                value = re.match("[A-Za-z0-9+/_.=-]*", t[k:])[0]
                if value:
                    at = k + len(value)
                    if len(value) >= 6:
                        spans.append((m.start(), 0, at))
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
        spans.sort()
        kinds = [k for _, k, _ in spans]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in range(3))
        spell = lambda x: ",".join(f"{('assign', 'access', 'hex', 'markov')[k]}:{a}:{b}" for a, k, b in sorted(x))
        assert r.base_sha256 == hashlib.sha256(spell(spans).encode()).hexdigest()
        assert r.spans == spell(spans + secrets.markov_spans(t, spans, model, threshold))
