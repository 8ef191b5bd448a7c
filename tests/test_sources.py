"""Lines by place, the log that takes a batch once, batched maps, streams over several starts."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from loomframe.operators.columns import map_batches
from loomframe.plans.registry import oracles
from loomframe.sources import lines, log
from loomframe.streaming import stateful

SF = "/root/testdata/sf0.001"


def test_lines_by_place(spark, tmp_path):
    made = [f"{f}:{k}:" + "x" * (k % 50) for f in range(3) for k in range(700 if f != 1 else 0)]
    for f in range(3):
        (tmp_path / f"part-{f}.txt").write_text("".join(x + "\n" for x in made if x.startswith(f"{f}:")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # many blocks in a file
    try:
        got = lines.numbered_lines(spark, str(tmp_path)).collect()
        last = lines.last_lines(spark, str(tmp_path), 150).collect()
        assert lines.last_lines(spark, str(tmp_path), 5000).count() == len(made)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {x.line: x.value for x in got} == dict(enumerate(made)) and len(got) == len(made)
    assert {x.line: x.value for x in last} == {k: made[k] for k in range(len(made) - 150, len(made))}
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a").write_text("only\n")
    both = lines.zip_lines(spark, str(tmp_path / "part-0.txt"), str(tmp_path / "other")).collect()
    assert len(both) == 700 and {x.line: x.right for x in both if x.right} == {0: "only"}


def test_log_takes_a_batch_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "k long, t string, ok boolean"
    assert log.read(spark, path, schema).count() == 0
    df = spark.createDataFrame([(k, None if k == 3 else f"é\n{k}", k % 2 == 0) for k in range(20)], schema).repartition(4)
    log.append(df, path, batch="one")
    log.append(df, path, batch="one")
    log.append(df.filter("k < 2"), path, batch="two")
    rows = sorted(map(tuple, log.read(spark, path, schema).collect()))
    assert rows == sorted([tuple(x) for x in df.collect()] + [tuple(x) for x in df.filter("k < 2").collect()])
    files = {p.name for p in (tmp_path / "log").glob("part-*")}
    listed = {f for c in (tmp_path / "log" / "_commits").glob("*.json") for f in json.loads(c.read_text())}
    assert files == listed  # the repeated batch left nothing
    # a task fails: nothing of its batch is seen
    bad = df.withColumn("t", F.when(F.col("k") == 19, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        log.append(bad, path, batch="three")
    assert log.read(spark, path, schema).count() == 22
    log.append(df, path, batch="three")
    assert log.read(spark, path, schema).count() == 42


def test_log_of_a_stream(spark, tmp_path):
    spark.dataSource.register(log.EventLog)
    path, schema = f"file://{tmp_path}/log", "k long, t string"
    df = spark.createDataFrame([(k, str(k)) for k in range(9)], schema)
    for start in range(2):
        df.withColumn("k", F.col("k") + 100 * start).write.mode("append").parquet(str(tmp_path / "in"))
        w = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.format(log.NAME).option("path", path).option("query", "q")
        w.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(x.k for x in log.read(spark, path, schema).collect()) == [*range(9), *range(100, 109)]
    # the last batch is run again, as after a crash between the sink's commit and the query's
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    w = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.format(log.NAME).option("path", path).option("query", "q")
    w.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(x.k for x in log.read(spark, path, schema).collect()) == [*range(9), *range(100, 109)]


def test_batched_maps_keep_values(spark):
    rows = [(2**53 + 1, [1, None], {"a": 1}), (None, None, None), (-(2**53) - 1, [], {})]
    df = spark.createDataFrame(rows, "n long, a array<long>, m map<string,long>").coalesce(1)
    seen = lambda b: {"n": b["n"], "a": b["a"], "kind": [type(x).__name__ for x in b["a"]]}
    assert sorted(map(tuple, map_batches(df, seen, "n long, a array<long>, kind string").collect()), key=str) == sorted([(2**53 + 1, [1, None], "list"), (None, None, "NoneType"), (-(2**53) - 1, [], "list")], key=str)


def test_merged_moments():
    import statistics as s

    a, b = [1.0, 5.0, 2.5], [1e9, 3.0]
    of = lambda v: (len(v), s.fmean(v), sum((x - s.fmean(v)) ** 2 for x in v))
    n, mean, m2 = stateful.merged(of(a), of(b))
    assert (n, round(mean, 3), round(m2 / of(a + b)[2], 9)) == (5, round(s.fmean(a + b), 3), 1.0)
    assert stateful.merged((0, 0.0, 0.0), (0, 0.0, 0.0)) == (0, 0.0, 0.0)


def test_late_rows_are_dropped():
    """The stream query's rule does leave out events and windows."""
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{SF}/events.parquet'")
    kept = c.sql(f"select sum(n) from ({oracles()['str_late_windows']})").fetchall()[0][0]
    closed = c.sql("select count(*) from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 day from events)").fetchall()[0][0]
    assert 0 < kept < closed


def test_schema_discovery(spark, tmp_path):
    from loomframe.sources import schemas

    (tmp_path / "a").write_text('{"k": 1, "t": "x"}\n{"k": 2.5}\n\n{"k": \n')
    (tmp_path / "b").write_text('{"k": 12345678901, "n": {"a": [1, 2]}, "t": 5}\n[1]\n7\nnull\n{"n": {"b": true}}\n')
    found = schemas.discover(spark, str(tmp_path))
    rows = {x.line: x for x in found.rows.collect()}
    assert {k: None if x.k is None else float(x.k) for k, x in rows.items()} == {0: 1.0, 1: 2.5, 4: 12345678901.0, 8: None}
    assert (rows[4].n.a, rows[4].n.b, rows[8].n.b) == ([1, 2], None, True)
    assert {(x.file[-1], x.line, x.value) for x in found.broken.collect()} == {("a", 3, '{"k": '), ("b", 5, "[1]"), ("b", 6, "7"), ("b", 7, "null")}
    assert {x.file[-1]: (x.good, x.broken) for x in found.by_file.collect()} == {"a": (2, 1), "b": (2, 3)}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x").write_text("no\n")
    none = schemas.discover(spark, str(tmp_path / "empty"))
    assert none.schema is None and none.rows.count() == 0 and none.broken.count() == 1


def test_log_sum_exp(spark):
    import math

    from loomframe.operators import vocabulary

    logits = {"hot": [math.sin(k) * 700 for k in range(10_000)], "one": [-1e4], "pair": [1000.0, 1000.0], None: [0.0, -800.0]}
    rows = [(c, k, x) for c, xs in logits.items() for k, x in enumerate(xs)] + [("pair", 9, None)]
    df = spark.createDataFrame(rows, "c string, id long, x double").repartition(6)
    got = {x.c: x.lse for x in vocabulary.log_sum_exp(df, ["c"], F.col("x")).collect()}
    for c, xs in logits.items():
        assert math.isclose(got[c], max(xs) + math.log(math.fsum(math.exp(x - max(xs)) for x in xs)), rel_tol=1e-12)
    soft = vocabulary.log_softmax(df, ["c"], "x")
    assert all(abs(x.s - 1) < 1e-9 for x in soft.groupBy("c").agg(F.sum(F.exp("logp")).alias("s")).collect()) and soft.count() == len(rows)


def test_bigram_sums(spark):
    import math

    from loomframe.operators import vocabulary

    docs = spark.createDataFrame([([1, 2, 1, 3],), ([1, 2],), ([],), ([7],), (None,)], "s array<int>")
    model = vocabulary.bigram_model(docs, "s")
    assert {(x.context, x.id): round(math.exp(x.logp), 9) for x in model.collect()} == {(1, 2): round(2 / 3, 9), (1, 3): round(1 / 3, 9), (2, 1): 1.0}
    other = vocabulary.bigram_model(spark.createDataFrame([([1, 2, 1, 2, 1, 3],)], "s array<int>"), "s")
    assert {x.context: abs(x.jsd) < 1e-12 for x in vocabulary.divergence(model, other).collect()} == {1: True, 2: True}
    tokens = vocabulary.bigrams(spark.createDataFrame([("a", [1, 2, 9, 1, 3]), ("b", [5])], "k string, s array<int>"), ["k"], "s")
    x = vocabulary.sequence_sums(tokens, ["k"], model, model).collect()
    assert len(x) == 1 and x[0].n == 2 and math.isclose(x[0].logp, math.log(2 / 9)) and x[0].kl == 0


def test_models_of_one_count(spark):
    """Rows are counted once for all models; a subset's model is that of its rows alone."""
    from pyspark.sql import functions as F

    from loomframe.operators import vocabulary

    docs = spark.createDataFrame([("en", [1, 2, 1, 3]), ("de", [1, 2, 2]), (None, [3, 1, 2]), ("en", [5]), ("en", None)], "lang string, s array<int>")
    counts = vocabulary.bigram_counts(docs, "s", english=F.col("lang") == "en")
    read = lambda m: sorted((x.context, x.id, round(x.logp, 9)) for x in m.collect())
    assert read(vocabulary.model_of_counts(counts)) == read(vocabulary.bigram_model(docs, "s"))
    assert read(vocabulary.model_of_counts(counts, "english")) == read(vocabulary.bigram_model(docs.filter("lang = 'en'"), "s"))
    # the counts are read, the rows' tokens are not made again
    assert "Generate" not in vocabulary.model_of_counts(counts)._jdf.queryExecution().toString()
