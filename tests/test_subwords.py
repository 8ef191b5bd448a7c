"""Subword tokens against the public library, and back to the text."""

import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from loomframe.functions import tokens as K
from loomframe.operators import subwords

PUBLIC = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PATH = subwords.VOCABULARY.removeprefix("file://")


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("public", pat_str=PUBLIC, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    parts = ["the", " The", "'s", "'re'd", "  ", "\n\n", "\t", "1234567", "é", "ß", "中文字", "\U0001f600", " ", "　", "\u0085", "...", "=>", "a" * 40, "\\", "</s>", " don't", "​", "é"]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(300)]
    noise = ["".join(chr(r.randrange(1, 0xD7FF)) for _ in range(40)) for _ in range(40)]
    return [None, "", " ", "   ", "x" * 30_000, "ab" * 20_000, " " * 5000, *made, *noise]


def test_encode_and_decode(spark, public):
    rows = list(enumerate(texts()))
    tokens = subwords.vocabulary(spark)
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    coded = df.select("k", subwords.encoder(tokens)(F.col("t")).alias("ids"))
    got = {x.k: x.ids for x in coded.collect()}
    assert got == {k: public.encode_ordinary(t or "") for k, t in rows}
    back = {x.k: x.decoded for x in subwords.decoded(coded, ["k"], "ids", tokens).collect()}
    assert back == {k: t or "" for k, t in rows}
    unknown = spark.createDataFrame([(1, [999_999]), (2, [13])], "k long, ids array<int>")
    assert {x.k: x.decoded for x in subwords.decoded(unknown, ["k"], "ids", tokens).collect()} == {1: None, 2: "."}


def test_merges_are_by_rank():
    r = random.Random(7)
    for _ in range(300):
        # a vocabulary of random merges over three bytes, ranks in the order of the merges
        ranks = {bytes([c]): k for k, c in enumerate(b"abc")}
        for _ in range(r.randrange(12)):
            pair = r.choice(list(ranks)) + r.choice(list(ranks))
            ranks.setdefault(pair, len(ranks))
        piece = bytes(r.choice(b"abc") for _ in range(r.choice([r.randrange(1, 25), 150])))
        parts = [bytes([b]) for b in piece]
        while True:
            known = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not known:
                break
            k = min(known)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert subwords.merged(piece, ranks) == [ranks[p] for p in parts]


def test_vocabulary_setting(spark, tmp_path):
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % (b + 7) for b in range(256)))
    spark.conf.set(subwords.SETTING, str(tmp_path / "v"))
    try:
        ids = subwords.encoder(subwords.vocabulary(spark))
        assert spark.createDataFrame([("aé",)], "t string").select(ids(F.col("t"))).first()[0] == [x + 7 for x in "aé".encode()]
    finally:
        spark.conf.unset(subwords.SETTING)


def test_empty_steps_and_tight_limits(spark):
    one = spark.createDataFrame([([[1, 2], [], [3]], [True, True, False], [5, 6, 7], [8, 9])], "s array<array<int>>, y array<boolean>, p array<int>, a array<int>")
    assert one.select(K.step_labels(F.col("s"), F.col("y"))).first()[0] == [-100, 1, 0]
    fit = one.select(K.fit_pair(F.col("p"), F.col("a"), 2, 3).alias("x")).first().x
    assert (fit.prompt, fit.answer) == ([5, 6, 7], [])


def test_what_is_held_does_not_grow_with_a_batch(monkeypatch):
    """Rows are laid out some at a time, in order; a long row alone."""
    import tracemalloc

    import pyarrow as pa

    of = lambda p: [len(p), 7]
    rows = [["a", "bb"], [], ["ccc"] * 9, ["a"], [], [], ["bb", "a", "bb"]]
    for held in (1, 3, 100):
        monkeypatch.setattr(subwords, "HELD", held)
        for skip in (0, 2):
            parts = list(subwords.laid_out(pa.array(rows, pa.list_(pa.string())).slice(skip), of))
            assert [x for p in parts for x in p.to_pylist()] == [[i for p in r for i in of(p)] for r in rows[skip:]]
        assert len(parts) == {1: 3, 3: 3, 100: 1}[held]
    monkeypatch.undo()
    big = pa.array([["word"] * 1000] * 1500, pa.list_(pa.string()))
    tracemalloc.start()
    assert sum(len(p) for p in subwords.laid_out(big, of)) == 1500
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all at once took over 80 MB in numpy alone
    assert peak < 20 << 20
