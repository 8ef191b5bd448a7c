"""The pipeline against brute force on the smallest tables, and its stages on awkward rows."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from loomframe.llm import _shared, decontaminate

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def features(text):
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    times = Counter(windows)
    covered = {p for k, x in enumerate(windows) if times[x] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols = len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text))
    dup = len(lines) - len(set(lines))
    base = n < 20 or 100 * len(covered) > 30 * n
    return base, 10 * symbols > n, 100 * dup > 30 * len(lines), chars < 2 * n or chars > 15 * n


def moments(counts):
    """Mean and strength of a beta prior: the strength at which the expected spread of the rates is the observed."""
    n = sum(c for c, _ in counts)
    m = sum(f for _, f in counts) / n
    if not 0 < m < 1:
        return m, 1000.0
    spread = sum(c * (f / c - m) ** 2 for c, f in counts)

    def expected(s):
        rho = 1 / (s + 1)
        rates = [m * (1 - m) * ((1 - rho) / c + rho) for c, _ in counts]  # variance of each rate
        return sum(c * v for (c, _), v in zip(counts, rates, strict=True)) - sum(c * c * v for (c, _), v in zip(counts, rates, strict=True)) / n

    low, high = 2.0, 1000.0
    if expected(high) >= spread:
        return m, high
    if expected(low) <= spread:
        return m, low
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) > spread else (low, mid)
    return m, low


def rules(rows):
    fails = {i: features(text or "") for i, text, _ in rows}
    hosts = {}
    for i, _, host in rows:
        hosts.setdefault(host or "", []).append(fails[i])
    strict = dict.fromkeys(hosts, False)
    for k in range(4):
        count = {h: (len(f), sum(x[k] for x in f)) for h, f in hosts.items()}
        m, s = moments(list(count.values()))
        for h, f in hosts.items():
            strict[h] |= bool((sum(x[k] for x in f) + m * s) / (len(f) + s) > 0.5)
    return [r for r in rows if not fails[r[0]][0] and sum(fails[r[0]][1:]) <= (0 if strict[r[2] or ""] else 1)]


def dedup(rows):
    sets = {}
    for i, text, _ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [r for r in rows if root(r[0]) == r[0]]


def clean(rows, items):
    code = {}
    number = lambda words: np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    known = [x for x in (number(decontaminate.tokens(t)) for t in items) if len(x) >= 8]
    assert len(known) == len(items)
    out = []
    for r in rows:
        x = number(decontaminate.tokens(r[1]))
        # the whole text is aligned with every item, without seeds
        if not any(decontaminate.align(k, x)[0] >= 0.55 * 2 * len(k) for k in known):
            out.append(r)
    return out


def test_run_equals_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(_shared, "shared_dir", lambda s: f"file://{tmp_path}")
    rows = duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()
    items = [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    want = clean(dedup(rules(rows)), items)
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    # nothing but the result is left of what the stages wrote
    assert {p.split("/")[-2] for p in out.inputFiles()} == {out.stored_at.split("/")[-1]}
    assert sorted(os.listdir(_shared.shared_dir(spark).removeprefix("file://"))) == [out.stored_at.split("/")[-1]]
    read = Counter(r.doc_id for r in got)
    assert set(read) == {r[0] for r in want}
    # mixing: read wholly as often as the source's share of the budget, some documents once more
    tokens, used = Counter(), Counter()
    for i, text, source in want:
        tokens[source] += len(WORD.findall(text or ""))
        used[source] += read[i] * len(WORD.findall(text or ""))
    most = max(tokens, key=tokens.get)
    assert used[most] == tokens[most] and all(1 <= used[s] / tokens[s] <= 2.5 for s in tokens if tokens[s])
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, name, stage):
    r = random.Random(5)
    text = " ".join(f"w{r.randrange(300)}" for _ in range(50))
    rows = [(1, text, "s"), (1, text, "s"), (2, None, None), (None, text, None), (3, "", "s"), (4, "long " * 40000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # names that the operators use themselves
    extra = ["row", "host", "kept", "id", "component", "n_tokens", "block", "shard", "slot", "size", "strict", "fp", "n", "key"]
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])
    out = stage(spark, docs, SF)
    assert len(set(out.columns)) == len(out.columns) and set(docs.columns) == set(out.columns)
    assert name == "sharding" or out.columns == docs.columns
    out.write.format("noop").mode("overwrite").save()
    assert out.count() >= 1 and stage(spark, docs.limit(0), SF).count() == 0
