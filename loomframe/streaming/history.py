"""Streams over the event history: success rates, metric windows, recent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def success_rate(events: DataFrame, by: str) -> DataFrame:
    """Per key the executed events and the share of them that succeeded; 0 without any."""
    executed = F.sum(F.col("executed").cast("long"))
    good = F.sum((F.col("executed") & F.col("successful")).cast("long"))
    return events.groupBy(by).agg(executed.alias("n_executed"), F.coalesce(good / F.nullif(executed, F.lit(0)), F.lit(0.0)).alias("success_rate"))


def metric_windows(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and mean of a value by key in tumbling windows; on a stream each window is sent once."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(
        F.col("w.start").alias("start"), key, "n", "mean"
    )
