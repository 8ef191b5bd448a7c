"""Every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from loomframe.operators import hooks
from loomframe.plans.registry import oracles, queries
from loomframe.sources.config import CorpusConfig

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def bag(rows):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = bag(map(tuple, df.select(cols).collect()))
    if name not in oracles():
        assert got
        return
    want = duck.sql(oracles()[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == bag(duck.sql(f"select {quoted} from ({oracles()[name]})").fetchall())


def test_stream_equals_batch(spark, tmp_path):
    from loomframe.streaming.history import success_rate

    rows = [("a", True, True), ("a", True, False), ("b", False, False)]
    df = spark.createDataFrame(rows, "k string, executed boolean, successful boolean")
    df.write.parquet(str(tmp_path / "in"))
    stream = success_rate(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k")
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert bag(spark.table("rates").collect()) == bag(success_rate(df, "k").collect()) == [("a", 2, 0.5), ("b", 0, 0.0)]


def test_files(spark, tmp_path):
    from loomframe.sources import files

    df = spark.createDataFrame([("i\n1", "", "o"), ("é", "", "")], files.ALPACA)
    files.write_jsonl(df, str(tmp_path / "j"))
    assert bag(files.read_jsonl(spark, str(tmp_path / "j")).collect()) == bag(df.collect())
    assert files.read_history(spark, str(tmp_path / "none")).count() == 0
    files.write_blocks(df, "instruction", "instruction", str(tmp_path / "b"))
    assert files.read_blocks(spark, str(tmp_path / "b")).count() == 2
    assert files.list_files(spark, str(tmp_path / "j"), "*.json").filter("length > 0").count() >= 1


def test_parse_edges(spark):
    from pyspark.sql import functions as F

    from loomframe.functions import text as X

    d = spark.createDataFrame([("COMMAND: a\nCOMMAND: b\nCONFIDENCE: 95%",), ("",), (None,)], "t string")
    got = d.select(X.parse_output(F.col("t")).alias("p")).select("p.command", "p.confidence").collect()
    assert [tuple(r) for r in got] == [("b", 0.0), ("", 0.0), ("", 0.0)]
    ok = spark.createDataFrame([("docker-compose up",), ("docker stop $(x)",), ("docker ls & x",), ("",)], "c string").select(X.is_safe(F.col("c"), "docker")).collect()
    assert [r[0] for r in ok] == [True, False, True, False]


def test_text_edges(spark):
    from pyspark.sql import functions as F

    from loomframe.functions import text as X

    odd = "\u00a0 A\u3000\tb\u2003\n\x1cC\u2028"
    row = spark.createDataFrame([(odd,)], "t string").select(X.normalize(F.col("t")).alias("n"), X.strip(F.col("t")).alias("s"), X.words(F.col("t")).alias("w")).first()
    assert row.n == " ".join(odd.lower().split()) == "a b c" and row.s == odd.strip() and row.w == odd.split()
    numbers = ["0.9", "1_0", "1_0.5e1_0", "inf", "-Infinity", "NaN", "1.0d", "0x1p3", "95%", "", "_1", "1__0", "+.5", "5."]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "t string").select(X.to_number(F.col("t"))).collect()]
    for x, y in zip(numbers, got, strict=True):
        try:
            want = float(x)
        except ValueError:
            want = 0.0
        assert y == want or y != y and want != want, x
    nan = spark.range(1).select(X.passes(F.lit("tool x"), F.lit(float("nan")), "tool")).first()
    assert nan[0] is False
    shown = [tuple(r) for r in spark.createDataFrame([(0.125, 0.955), (0.9, 0.5)], "a double, b double").select(X.two_places(F.col("a")), X.percent(F.col("b")), X.percent(F.col("b"), 1)).collect()]
    assert shown == [("0.12", "96%", "95.5%"), ("0.90", "50%", "50.0%")]
    cut = spark.createDataFrame([("ab cd", "ab ce"), ("a", "a"), ("", "x"), ("x y", "x z")], "c string, r string").select(X.shared_prompt(F.col("c"), F.col("r")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in cut] == [("ab c", "d", "e"), ("a", "", ""), ("", "", "x"), ("x", " y", " z")]


def test_gae_on_long_groups(spark):
    """50,000 steps in one group, and a decay so strong that its powers vanish."""
    import random

    from loomframe.operators.sequences import gae

    r = random.Random(1)
    steps = [("a", t, r.random(), r.random()) for t in range(50_000)] + [("b", t, r.random(), r.random()) for t in range(300)] + [("c", 0, 1.0, 0.5)]
    df = spark.createDataFrame(steps, "g string, t int, r double, v double")
    for gamma, lam in ((0.99, 0.95), (0.5, 1e-4), (1.0, 1.0), (0.9, 0.0), (1e-90, 1e-90)):
        want, at = {}, {}
        for g, t, x, v in reversed(steps):
            ahead, value = at.get(g, (0.0, 0.0))
            want[g, t] = x + gamma * value - v + gamma * lam * ahead
            at[g] = want[g, t], v
        got = gae(df, "g", ["t"], "r", "v", gamma, lam).collect()
        assert len(got) == len(steps)
        assert all(math.isclose(x.advantage, want[x.g, x.t], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(x.returns, x.advantage + x.v) for x in got)


def test_skewed_groups(spark):
    """One group holds nearly all rows: packs, positions, ranks and quantiles are right and no span holds it whole."""
    from pyspark.sql import functions as F

    from loomframe.operators import sequences as S

    rows = [(k, "s0" if k % 50 else "s1", k % 37) for k in range(5000)]
    df = spark.createDataFrame(rows, "k long, s string, n long").repartition(7)
    at, want = {}, {}
    for k, s, n in rows:
        want[k] = at.get(s, 0)
        at[s] = want[k] + n
    got = S.running_sums(df, ["s"], "k", "n", width=64, most=1000)
    assert {r.k: r.before for r in got.collect()} == want
    assert {r.k: r.position for r in S.positions(df, "k", 64).collect()} == {k: k for k, _, _ in rows}
    ranked = S.hash_rank(df, F.md5(F.col("k").cast("string")), ["k"], digits=2).withColumn("tile", S.tile(F.col("rank"), F.col("total"), 7)).collect()
    import hashlib

    order = sorted(range(5000), key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))
    assert {r.k: r.rank for r in ranked} == {k: i for i, k in enumerate(order)}
    assert {r.k: r.tile for r in ranked} == {k: (i // 715 + 1 if i < 2 * 715 else 3 + (i - 2 * 715) // 714) for i, k in enumerate(order)}
    import numpy as np

    for values in ([x for _, _, x in rows], [1.0], [2.0] * 9, [1e9, 0.0, 3.0, 1.0], [1e300, *range(60_000)], []):
        v = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double")
        for share in (0.8, 1.0):
            cut = S.exact_quantile(v, "v", share).first()["cut"]
            assert cut is None if not values else math.isclose(cut, np.quantile(values, share), rel_tol=1e-9, abs_tol=1e-9)


def test_empty_tables(spark, tmp_path):
    from loomframe.operators.density import density_weights

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    row = queries()["agg_dataset_profile"](spark, str(tmp_path)).first()
    assert (row.n, row.n_distinct, row.avg_chars, row.repeat_rate) == (0, 0, None, None)
    e = spark.createDataFrame([], "embedding array<double>, y boolean")
    assert density_weights(e, "embedding", "y").count() == 0
    one = spark.createDataFrame([([1.0], True)] * 3, "embedding array<double>, y boolean")
    assert [r.weight for r in density_weights(one, "embedding", "y").collect()] == [1.0] * 3


def test_density_weights_tell_classes_apart(spark):
    import random

    from loomframe.operators.density import density_weights

    r = random.Random(4)
    rows = [([r.gauss(1.5 if k % 4 else -1.5, 1.0), r.gauss(0, 1)], bool(k % 4)) for k in range(400)]
    got = density_weights(spark.createDataFrame(rows, "embedding array<double>, y boolean"), "embedding", "y").collect()
    # the ratio of the classes' densities is exp(3 x) for normal ones that lie 3 apart
    assert all(0.1 <= x.weight <= 10 for x in got)
    gaps = [abs(math.log(x.weight) - math.log(min(max(math.exp(3 * x.embedding[0]), 0.1), 10.0))) for x in got]
    assert sum(gaps) / len(gaps) < 0.3


def test_exo_pair_without_smoothing(spark):
    from pyspark.sql import functions as F

    from loomframe.functions import scores as C

    d = spark.createDataFrame([(0.5, -0.2, 0.7)], "lc double, lr double, z double")
    got = d.select(C.pairwise(F.col("lc"), F.col("lr"), F.col("z"), eps=0.0)["exo_pair"]).first()[0]
    s = lambda x: 1 / (1 + math.exp(-x))
    assert abs(got - (s(0.07) * (math.log(s(0.07)) - math.log(0.999)) + s(-0.07) * (math.log(s(-0.07)) - math.log(0.001)))) < 1e-12


def test_chat_template(spark):
    from loomframe.operators.chat import render

    rows = [(1, 0, "system", "S"), (1, 1, "user", "\t hi\n"), (1, 2, "assistant", "yo"), (2, 0, "user", "a"), (2, 1, "system", "late"), (3, 0, "system", "only"), (4, 0, "user", "a"), (4, 1, "user", "b")]
    got = {r.conv_id: r for r in render(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), generation_prompt=True).collect()}
    assert got[1].rendered == "<bos><start_of_turn>user\nS\n\nhi<end_of_turn>\n<start_of_turn>model\nyo<end_of_turn>\n<start_of_turn>model\n" and got[1].alternates
    # the format asks only that users, and no others, have the even places
    assert got[2].alternates and "<start_of_turn>system\nlate" in got[2].rendered and not got[4].alternates
    assert got[3].rendered == "<bos><start_of_turn>model\n"


def test_late_rows_of_metric_windows(spark, tmp_path):
    """A stream's windows are sent once; a row later than the watermark allows changes nothing."""
    from datetime import datetime, timedelta

    from loomframe.streaming.history import metric_windows

    day = datetime(2024, 1, 1)
    batches = [[(day, "a", 1.0), (day + timedelta(hours=3), "a", 3.0)], [(day + timedelta(days=4), "a", 5.0)], [(day + timedelta(hours=5), "a", 100.0), (day + timedelta(days=8), "a", 7.0)], [(day + timedelta(days=20), "a", 9.0)]]
    schema = "ts timestamp, k string, v double"
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"made{n}"))
    (tmp_path / "in").mkdir()
    q = metric_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "k", "v").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for n in range(len(batches)):
            for f in (tmp_path / f"made{n}").glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{n}-{f.name}")
            q.processAllAvailable()
        first = {r.start.day: (r.n, r["mean"]) for r in spark.table("windows").collect()}
        assert first[1] == (2, 2.0) and first[5] == (1, 5.0)
    finally:
        q.stop()


def test_missing_history_only(spark, tmp_path):
    from loomframe.sources import files

    assert files.read_history(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "h.json").write_text('[{"nl": "a", "executed": true}, {"nl": "b"}]')
    assert files.read_history(spark, str(tmp_path / "h.json")).count() == 2
    assert "nl" in files.console_table(files.read_history(spark, str(tmp_path / "h.json")))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import loomframe
    from loomframe import cli

    assert loomframe.Translator and loomframe.History and loomframe.__version__
    monkeypatch.setattr(cli, "session", lambda: spark)
    run = lambda *a: (cli.main(["--models", str(tmp_path), *a]), capsys.readouterr().out)
    assert run("translate", "show disk usage")[0] == 1
    assert "not found" in run("model-info", "--tool", "docker")[1] and "No models" in run("cache-dir")[1]
    assert run("make-corpus", "docker") == (0, f"574 examples in {tmp_path / 'docker'}\n")
    assert run("make-corpus", "tool")[1].startswith("1500 examples")
    assert "docker system df" in run("translate", "--tool", "docker", "show", "disk", "usage")[1]
    shown = run("translate", "show", "my", "environments", "as", "json")[1]
    assert "Command: tool ls --format json" in shown and "Confidence: 100%" in shown
    assert "available" in run("model-info", "--tool", "docker")[1] and "docker (" in run("cache-dir")[1]


def test_template_sizes():
    from collections import Counter

    from loomframe.operators import generation

    assert Counter(k for k, _, _ in generation.container_rules()) == dict(run=214, build=97, ps_images=66, exec=54, compose=76, network=62, volume=37, system=27)
    assert Counter(t[0] for t in generation.tool_templates()) == {"register": 15, "ls": 16, "scan": 13, "current": 8, "cleanup": 11, "shell-hook": 7, "stats": 8}
    assert len(set(generation.container_rules())) == 633
    # the patterns with the names filled in are the rules, but those of two names
    made = {(k, i.replace("{name}", n), c.replace("{name}", n)) for k, i, c, _ in generation.container_patterns() for n in generation.NAMES}
    gone = set(generation.container_rules()) - made
    assert all(k in ("network", "run") for k, _, _ in gone) and len(gone) < 70


def test_container_corpus_size(spark):
    from loomframe.operators import generation

    shares = spark.createDataFrame(list(generation.CONTAINER_SHARES), "kind string, share double")
    assert generation.sample_pools(generation.pool(spark), shares, 600, "d4").count() == 574
    templates = spark.createDataFrame(generation.tool_templates(), "kind string, t int, pattern string, command string, base double, explanation string")
    tool = spark.createDataFrame(list(generation.TOOL_SHARES), "kind string, share double")
    assert generation.draw_templates(templates, tool, 1500).count() == 1500 and generation.draw_templates(templates, tool, 0).count() == 0


def test_streams_of_moments_and_recent_rows(spark, tmp_path):
    from loomframe.streaming.recent import keep_recent, recent_rows, running_moments

    df = spark.createDataFrame([("a", float(x), x) for x in range(9)] + [("b", 2.0, 1)], "k string, v double, t int")
    for k in range(3):
        df.filter(f"t % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_moments(read(), "k", "v").writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert bag(map(tuple, spark.table("moments").collect())) == bag(map(tuple, running_moments(df, "k", "v").collect()))
    log = str(tmp_path / "log")
    q = read().writeStream.foreachBatch(keep_recent(log, "k", ["t"], 4)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    versions = sorted(int(x.name.split("=")[1]) for x in tmp_path.glob("log/version=*"))
    assert len(versions) <= 2
    last = tmp_path / f"log/version={versions[-1]}"
    assert bag(map(tuple, spark.read.parquet(str(last)).collect())) == bag(map(tuple, recent_rows(df, "k", ["t"], 4).collect()))


def test_translator_and_history(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomframe.translate import History, Translator

    model = lambda p: F.concat(F.lit("COMMAND: tool ls "), F.regexp_extract(p, "show (\\S+)", 1), F.lit("\nCONFIDENCE: 0.9\nEXPLANATION: lists"))
    df = spark.createDataFrame([(1, "  Show   A "), (2, "show $x"), (3, None)], "i int, said string")
    got = {r.i: r for r in Translator("tool", model).translate(df, "said").collect()}
    assert got[1].command == "tool ls a" and got[1].success and got[1].preview == "Command: tool ls a\nConfidence: 90%\nExplanation: lists"
    assert not got[2].safe and got[2].preview == "No command found" and got[3].command == ""
    log = History(str(tmp_path / "history"))
    assert log.success_rate(spark) == 0.0
    log.save(spark.createDataFrame([("a", "tool a", True, True), ("b", "tool b", True, False), ("c", "tool c", False, True)], "nl string, command string, executed boolean, successful boolean"))
    assert log.success_rate(spark) == 0.5


def test_config_round_trip(tmp_path):
    path = str(tmp_path / "config.json")
    CorpusConfig(tool="x", n_examples=7).save(path)
    assert CorpusConfig.load(path) == CorpusConfig(tool="x", n_examples=7)
    (tmp_path / "config.json").write_text('{"tool": "y", "other": 1}')
    with pytest.raises(ValueError, match="other"):
        CorpusConfig.load(path)


def test_format_must_give_an_array(spark):
    df = spark.createDataFrame([(1, "a")], "i int, t string")
    with pytest.raises(ValueError, match="array"):
        hooks.formatted(df, lambda x: x.t, ["i"])


def test_stateless_stream_reads_a_folder(spark, tmp_path):
    """The table may be a folder of several files, as large ones are."""
    spark.read.parquet(f"{SF}/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = duck.sql(f"select conv_id, turn, norm, inst from ({oracles()['str_stateless']})").fetchall()
    got = queries()["str_stateless"](spark, str(tmp_path)).select("conv_id", "turn", "norm", "inst").collect()
    assert want and bag(map(tuple, got)) == bag(want)


def test_named_pools_are_spread(spark):
    """Names of one partition are crossed by many tasks, and texts told apart by many; repeated and null names count as rows."""
    from loomframe.operators import generation as G

    names = [f"n{k % 5000}" for k in range(10_000)] + [None, None]
    df = spark.createDataFrame([(n,) for n in names], "name string").coalesce(1)
    sizes = G.named_pool(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    patterns = G.container_patterns()
    named = sum(r[3] for r in patterns)
    assert sum(sizes) == len(patterns) - named + named * len(names)
    assert max(sizes) <= 1.1 * G.NAMES_A_TASK * named

    pairs = [(k, i, c) for k, i, c, has in patterns if not has]
    pairs += [(k, *(n and x.replace("{name}", n) for x in (i, c))) for k, i, c, has in patterns if has for n in names]
    want = {}
    for k, i, c in pairs:
        n, commands, instructions = want.setdefault(k, [0, set(), set()])
        want[k][0] = n + 1
        commands.add(c)
        instructions.add(i)
    got = G.pool_sizes(df)
    assert {tuple(r) for r in got.collect()} == {(k, n, len(c - {None}), len(i - {None})) for k, (n, c, i) in want.items()}


def test_gae_over_tasks_deals_rows_out_once(spark):
    """Groups that end within tasks and span them, with nulls, in small batches; a wide column is shuffled once."""
    import random

    from pyspark.sql import functions as F

    from loomframe.operators.sequences import gae

    r = random.Random(2)
    some = lambda: None if r.random() < 0.01 else r.random()
    sizes = {"a": 9000, None: 4000, "b": 300, "c": 7, "d": 5000}
    steps = [(g, t if t else None, some(), some()) for g, n in sizes.items() for t in range(n)]
    df = spark.createDataFrame(steps, "g string, t int, r double, v double").repartition(5).withColumn("wide", F.sha2(F.concat_ws("|", "g", "t"), 512))
    df = df.persist()
    settings = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
    before = {k: spark.conf.get(k) for k in settings}
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        start = written()
        df.repartitionByRange("g", "t").write.format("noop").mode("overwrite").save()
        once = written() - start
        for gamma, lam in ((0.99, 0.95), (1.0, 1.0), (0.5, 1e-4), (0.9, 0.0)):
            want, at = {}, {}
            for g, t, x, v in reversed(steps):
                ahead, value = at.get(g, (0.0, 0.0))
                want[g, t] = (0.0 if x is None or v is None else x + gamma * value - v) + gamma * lam * ahead
                at[g] = want[g, t], v or 0.0
            start = written()
            got = gae(df, "g", ["t"], "r", "v", gamma, lam).collect()
            if lam:
                assert written() - start < 1.5 * once
            assert len(got) == len(steps)
            assert all(math.isclose(x.advantage, want[x.g, x.t], rel_tol=1e-9, abs_tol=1e-9) for x in got)
            assert all(x.returns is None if x.v is None else math.isclose(x.returns, x.advantage + x.v) for x in got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        df.unpersist()


def test_recent_rows_share_states_by_bucket(spark, tmp_path):
    """The last rows of each key over two starts, of keys that share three states; nulls, NaN, both zeros and long numbers."""
    from loomframe.streaming import stateful

    keys = [None, float("nan"), 0.0, -0.0, *map(float, range(1, 30))]
    far = 1 << 60
    rows = [(keys[i % len(keys)], None if i % 7 == 0 else far + i, i) for i in range(1000)]
    schema = "k double, t long, i long"
    with stateful.state_store(spark):
        for part in (rows[::2], rows[1::2]):
            spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            out = stateful.recent_stream(stream, "k", ["t", "i"], 5, buckets=3).writeStream.format("noop").outputMode("update")
            out.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for k, t, i in rows:
        # -0.0 is 0.0, NaN is NaN
        want.setdefault("nan" if k != k else k, []).append((t is not None, t or 0, i))
    want = {(str(k), x[2]) for k, v in want.items() for x in sorted(v, reverse=True)[:5]}
    got = stateful.recent_state(spark, str(tmp_path / "checkpoint"))
    assert got.columns == ["k", "t", "i"]
    got = got.collect()
    assert {(str(r.k), r.i) for r in got} == want and len(got) == len(want)
    assert all(r.t == rows[r.i][1] for r in got)
    states = spark.read.format("statestore").option("stateVarName", "recent").load(str(tmp_path / "checkpoint"))
    assert states.select("key").distinct().count() <= 3


def test_moments_share_states_by_bucket(spark, tmp_path):
    """Moments of each key over two starts, of keys that share three states; a null key, null values and a key without any."""
    from statistics import mean, stdev

    from loomframe.streaming import stateful

    rows = [(None if i % 31 == 0 else i % 31, None if i % 31 == 5 or i % 11 == 0 else float(i * i % 97)) for i in range(1000)]
    with stateful.state_store(spark):
        for part in (rows[::2], rows[1::2]):
            spark.createDataFrame(part, "k long, v double").write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("k long, v double").parquet(str(tmp_path / "in"))
            out = stateful.moments_stream(stream, "k", "v", buckets=3).writeStream.format("noop").outputMode("update")
            out.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = {r.k: r for r in stateful.moments_state(spark, str(tmp_path / "checkpoint"), "k").collect()}
    assert set(got) == {k for k, _ in rows}
    for k, r in got.items():
        v = [x for own, x in rows if own == k and x is not None]
        assert r.n == len(v) and (r.mean is None) == (not v) and (not v or math.isclose(r.mean, mean(v)) and math.isclose(r.std, stdev(v)))
    states = spark.read.format("statestore").option("stateVarName", "moments").load(str(tmp_path / "checkpoint"))
    assert states.select("key").distinct().count() <= 3
