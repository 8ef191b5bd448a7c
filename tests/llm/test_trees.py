"""Manifest, reply trees and prefix trie on awkward tables, against brute force."""

import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from loomframe.llm import merkle, prefix_trie, reply_trees
from loomframe.operators.ordering import places


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_tree(leaves, fan_out):
    """Root and, for each leaf, its place and siblings in each run from the bottom up."""
    proofs, below = [[] for _ in leaves], [[k] for k in range(len(leaves))]
    while len(leaves) > 1:
        runs = [range(k, min(k + fan_out, len(leaves))) for k in range(0, len(leaves), fan_out)]
        for run in runs:
            for k in run:
                for leaf in below[k]:
                    proofs[leaf].append((k - run[0], "".join(leaves[j] for j in run if j != k)))
        below = [[x for k in run for x in below[k]] for run in runs]
        leaves = [sha("".join(leaves[k] for k in run)) for run in runs]
    return leaves[0], proofs


@pytest.mark.parametrize("fan_out", [2, 16])
def test_merkle(spark, fan_out):
    r = random.Random(4)
    rows = [(k if k % 11 else None, r.choice(["a", "é", "", None]), r.choice(["x" * 4000, "B\nc", "", None]), k) for k in range(150)]
    rows += [(7, "a", "same", 1)] * 20 + [(500, "alone", None, None)]
    df = spark.createDataFrame(rows, "id long, grp string, text string, digest long").repartition(5)
    m = merkle.build(df, ["id", "text"], "grp", "id", fan_out=fan_out)
    out = merkle.proofs(m).withColumn("folded", merkle.fold(merkle.as_hex(F.col("digest")), F.col("path"))).collect()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for x in rows:
        groups.setdefault(x[1], []).append((x[0] is not None, x[0] or 0, sha(enc(x[0]) + enc(x[2])), x))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan_out) for g in names}
    root, ends = brute_tree([trees[g][0] for g in names], fan_out)
    assert len(out) == len(rows) and m.root.collect()[0][0].hex() == root
    for x in out:
        want = trees[x.group][1][x.place] + ends[names.index(x.group)]
        assert [(s.at, s.others.hex()) for s in x.path] == want
        assert (x.subroot.hex(), x.root.hex(), x.folded) == (trees[x.group][0], root, root)
        assert x.digest.hex() == sha(enc(x.row.id) + enc(x.row.text))
    assert sorted(map(str, (tuple(x.row) for x in out))) == sorted(map(str, rows))
    # a changed leaf, a sibling or a place leads elsewhere
    x = max(out, key=lambda x: len(x.path))
    other = sha("other")
    bad = spark.createDataFrame([(other, x.path)], f"leaf string, path {merkle.PATH}").select(merkle.fold(F.col("leaf"), F.col("path")))
    assert bad.first()[0] != root


def test_merkle_empty(spark):
    df = spark.createDataFrame([], "id long, grp string, text string")
    m = merkle.build(df, ["id", "text"], "grp", "id")
    assert m.root.collect() == [] and merkle.proofs(m).collect() == []


TREE = "tree string, id long, parent long, role string, text string, score double, node string, place int"
HARD = ["", "a: b", "x </turn>\ny", "\\### assistant: </turn> ok", "#######", "<\\/turn>\\", "\\", "## #", "<</turn>/turn>", "é\U0001f600" * 50, "\n### user: hi</turn>\n"]


def brute_paths(rows):
    """tree -> [(score, ids of the path)]"""
    out = {}
    for tree in {x[0] for x in rows}:
        own = {x[1]: x for x in rows if x[0] == tree and x[1] is not None}
        rest = [x for x in rows if x[0] == tree and x[1] is None]
        has = {x[2] for x in [*own.values(), *rest]}
        for x in [*own.values(), *rest]:
            if x[1] is not None and x[1] in has:
                continue
            path, seen = [x], set()
            while path[-1][2] in own and path[-1][2] not in seen:
                seen.add(path[-1][2])
                path.append(own[path[-1][2]])
            if path[-1][2] not in own:
                out.setdefault(tree, []).append(path[::-1])
    return out


def test_reply_trees(spark):
    r = random.Random(6)
    rows = []
    for t in ["t1", "t2", None]:
        for k in range(60):
            parent = None if k == 0 else 999 if k == 7 else r.randrange(max(0, k - 6), k)
            rows.append((t, k, parent, r.choice(["user", "assistant", "tool: x\\", None]), r.choice([*HARD, None]), r.choice([None, 0.5, 1.0, 2.0]), "clash", 3))
    rows += [("chain", k, k - 1 if k else None, "assistant", f"m{k}", 1.0, None, None) for k in range(300)]
    rows += [("ring", 1, 2, "user", "a", 9.0, None, None), ("ring", 2, 1, "user", "b", 9.0, None, None), ("ring", 3, 2, "user", "c", 9.0, None, None), ("ring", 4, 4, "user", "d", 9.0, None, None)]
    rows += [("anon", 1, None, "user", "q", None, None, None), ("anon", None, 1, "assistant", "p", 1.0, None, None), ("anon", None, 1, "assistant", "o", 2.0, None, None)]
    rows += [("star", 0, None, "user", "q", None, None, None)] + [("star", k, 0, "assistant", f"a{k}", float(-k), None, None) for k in range(1, 200)]
    df = spark.createDataFrame(rows, TREE).repartition(6)
    nodes = reply_trees.numbered(df, "tree", "id", "parent", "role", "text", F.col("score"))
    want = brute_paths(rows)
    for best in (None, 1, 3):
        out = reply_trees.conversations(nodes, best)
        out = out.withColumns({"said": reply_trees.parsed(F.col("text")), "learned": reply_trees.learned_texts(F.col("text"), F.col("turns"))}).collect()
        assert {x.tree for x in out} == set(want)
        for tree, paths in want.items():
            paths = [(sum(x[5] or 0 for x in p), [(x[3] or "", x[4] or "") for x in p]) for p in paths]
            got = sorted((x for x in out if x.tree == tree), key=lambda x: x["rank"])
            assert [x["rank"] for x in got] == list(range(len(paths) if best is None else min(best, len(paths))))
            assert [x.score for x in got] == sorted((s for s, _ in paths), reverse=True)[: len(got)]
            left = [p for _, p in paths]
            for x in got:
                said = [tuple(s) for s in x.said]
                left.remove(said)
                assert x.learned == [t for role, t in said if role == "assistant"]
                assert len(re.findall(r"</turn>\n", x.text)) == len(said) and x.turns[-1].end == len(x.text) - len("</turn>\n")
                assert [x.text[t.start : t.end] for t in x.turns if t.learn] == [reply_escape(t) for role, t in said if role == "assistant"]
    assert reply_trees.conversations(reply_trees.numbered(df.limit(0), "tree", "id", "parent", "role", "text")).collect() == []


def reply_escape(t):
    return re.sub("##(?=#)", lambda m: "##\\", t.replace("\\", "\\\\").replace("</turn>", "<\\/turn>"))


def test_reply_trees_repeated_rows(spark):
    rows = [("t", 1, None, "user", "q", 0.0, None, None)] * 2 + [("t", 2, 1, "assistant", "a", 0.0, None, None)]
    nodes = reply_trees.numbered(spark.createDataFrame(rows, TREE), "tree", "id", "parent", "role", "text")
    out = reply_trees.conversations(nodes, None).select(reply_trees.parsed(F.col("text")).alias("said")).collect()
    # the row that no reply is given to is a path of its own
    assert sorted(len(x.said) for x in out) == [1, 2]


def brute_trie(conv):
    nodes = {}
    for c, turns in conv.items():
        for k in range(len(turns) + 1):
            members, ends = nodes.setdefault(tuple(turns[:k]), ([], []))
            members.append(c)
            if k == len(turns):
                ends.append(c)
    kids, sums = {}, {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        n = len(re.findall("[^\x20\x09-\x0d]+", k[-1][1] or "")) if k else 0
        sums[k] = (sum(sums[x][0] for x in below) or 1, (len(nodes[k][0]) - 1) * n + sum(sums[x][1] for x in below))
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]][0]) if k else -99, len(m), len(kids.get(k, [])), *sums[k], sha(",".join(map(str, sorted(e)))))
        for k, (m, e) in nodes.items()
    )


def trie_rows(spark, conv):
    members = spark.createDataFrame([(c,) for c in conv], "conv long")
    turns = spark.createDataFrame([(c, k, a, t, "clash") for c, ts in conv.items() for k, (a, t) in enumerate(ts)], "conv long, place long, role string, text string, key string")
    out = prefix_trie.prefix_trie(members.repartition(3), turns.repartition(5)).collect()
    return sorted(tuple(-99 if v is None else v for v in x) for x in out)


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "COMMON", 30)
    r = random.Random(8)
    turn = lambda: (r.choice(["user", "assistant", ""]), r.choice(["a b c", "", " x\ty ", "é", "a", "b c " * 3]))
    conv = {k * 3 - 50: [turn() for _ in range(r.randrange(6))] for k in range(120)}
    conv |= {1000 + k: [("user", "hot words")] * 3 for k in range(60)}  # equal ones
    conv |= {2000 + k: [("user", "hot words")] * k for k in range(40)}  # each the other's prefix
    conv |= {3000 + k: [("user", "hot words"), ("assistant", f"w{k}")] for k in range(80)}  # a star
    assert trie_rows(spark, conv) == brute_trie(conv)


def test_prefix_trie_small(spark):
    assert trie_rows(spark, {5: []}) == brute_trie({5: []}) == [(5, 0, -99, 1, 0, 1, 0, sha("5"))]
    # the place of a part between role and text matters
    conv = {1: [("ab", "c")], 2: [("a", "bc")], 3: [("a", "bc"), ("a", "bc")], 4: [("user", "long " * 20000)], 5: [("user", "long " * 20000), ("", "")]}
    assert trie_rows(spark, conv) == brute_trie(conv)
    empty = spark.createDataFrame([], "conv long, place long, role string, text string")
    assert prefix_trie.prefix_trie(empty.select("conv"), empty).collect() == []


def test_rebuilt_conversations(spark, tmp_path):
    """op13's query on a table with gaps, nulls and absent bases."""
    import zlib

    from loomframe.llm import queries

    r = random.Random(9)
    rows = [(c, r.choice([None, t]) if t == 0 else t * 5, r.choice(["user", None]), f"w{r.randrange(3)} w") for c in [0, 1, 2, 21, 39, 40, 41, 42, 43, 44, 45, 61, -3, -25] for t in range(r.randrange(1, 5))]
    df = spark.createDataFrame([*rows, (None, 1, "user", "no id")], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    own = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own.setdefault(c, []).append((role or "", text))
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    base = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    conv = {c: own.get(base(c), [])[: h(c)] + ts[h(c) :] for c, ts in own.items()}
    got = queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect()
    assert sorted(tuple(-99 if v is None else v for v in x) for x in got) == brute_trie(conv)


def test_places_of_equal_rows(spark):
    df = spark.createDataFrame([(1, 2)] * 9, "a long, b long")
    assert sorted(x.place for x in places(df, ["a"], ["b"]).collect()) == list(range(9))
