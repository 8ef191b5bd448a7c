"""Queries that run as streams over several starts from one checkpoint, against the SQL of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.plans.registry import query
from loomframe.plans.tables import table
from loomframe.sources.shared import scratch_path
from loomframe.streaming import stateful
from loomframe.streaming.history import metric_windows

#: Starts of a stream.
RUNS = 4


def in_runs(spark: SparkSession, rows: DataFrame, run: Column, runs: int, path: str, start) -> None:
    """Rows arrive run by run in a folder, which a stream reads to its end each time and stops."""
    rows = rows.withColumn("_run", run)
    for k in range(runs):
        rows.filter(F.col("_run") == k).drop("_run").write.mode("append").parquet(f"{path}/arrived")
        stream = spark.readStream.schema(rows.drop("_run").schema).parquet(f"{path}/arrived")
        start(stream).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


# an event comes in the run of its eight days, every tenth two runs later; a run drops what belongs to
# windows that ended a day or more before the latest event of the runs before it
@query("""WITH a AS (SELECT *, least(least(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) // 8, 3) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END, 3) AS run FROM events),
r AS (SELECT run, max(ts) AS last FROM a GROUP BY run),
m AS (SELECT x.run, max(y.last) - INTERVAL 1 DAY AS mark FROM r x LEFT JOIN r y ON y.run < x.run GROUP BY x.run),
k AS (SELECT a.* FROM a JOIN m ON m.run = a.run WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)
SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM k
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(last) - INTERVAL 1 DAY FROM r) GROUP BY 1, 2""")
def str_late_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows under a watermark in append mode, over four starts; late events are dropped, open windows not sent."""
    path = scratch_path(spark, "windows")
    # event time is an instant; the table's has no zone
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    late = F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    run = F.least(F.least(F.floor(day / 8), F.lit(RUNS - 1)) + late, F.lit(RUNS - 1))

    def start(stream: DataFrame):
        return metric_windows(stream, "ts", "event_type", "value").writeStream.format("parquet").outputMode("append").option("path", f"{path}/windows")

    in_runs(spark, e, run, RUNS, path, start)
    out = spark.read.schema("start timestamp, event_type string, n long, mean double").parquet(f"{path}/windows")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean": F.round("mean", 6)})


@query("SELECT user_id, count(value) AS n, round(sum(value), 4) AS total, round(stddev_samp(value), 6) AS std FROM events GROUP BY user_id")
def str_running_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments by user in keyed state, of a query that stops midway and goes on from its checkpoint."""
    path = scratch_path(spark, "moments")
    e = table(spark, d, "events").select("user_id", "value", "event_id")
    with stateful.state_store(spark):
        in_runs(spark, e, F.pmod("event_id", F.lit(2)), 2, path, lambda s: stateful.moments_stream(s, "user_id", "value").writeStream.format("noop").outputMode("update"))
    out = stateful.moments_state(spark, f"{path}/checkpoint", "user_id")
    return out.select("user_id", "n", F.round(F.col("n") * F.col("mean"), 4).alias("total"), F.round("std", 6).alias("std"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def str_recent_rows(spark: SparkSession, d: str) -> DataFrame:
    """The last five events of each user as list state, which users of a bucket share, over two starts."""
    path = scratch_path(spark, "recent")
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    with stateful.state_store(spark):
        in_runs(spark, e, F.pmod("event_id", F.lit(2)), 2, path, lambda s: stateful.recent_stream(s, "user_id", ["ts", "event_id"], 5).writeStream.format("noop").outputMode("update"))
    return stateful.recent_state(spark, f"{path}/checkpoint").select("user_id", "event_id")
