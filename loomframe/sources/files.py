"""Files of the corpus: JSON lines, text blocks, history, directory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.sources.shared import exists

ALPACA = "instruction string, input string, output string"
HISTORY = "nl string, command string, executed boolean, successful boolean, timestamp timestamp"


def read_jsonl(spark: SparkSession, path: str, schema: str | None = ALPACA) -> DataFrame:
    """Rows of JSON lines; without a schema it is inferred from all of them."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON documents; broken ones are dropped and a missing path has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of text between blank lines."""
    return spark.read.option("lineSep", "\n\n").text(path).filter(F.col("value") != "")


def write_blocks(df: DataFrame, column: str, order: str, path: str, n: int = 100) -> None:
    """The first n texts by an order, with a blank line after each."""
    df.orderBy(order).limit(n).select(column).coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path`` and ``length`` of files, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A table of samples as CSV (with header) or JSON lines."""
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def console_table(df: DataFrame, rows: int = 20, width: int = 60) -> str:
    """The first rows as a text table for a terminal; longer values are cut."""
    shown = [[("" if v is None else str(v)).replace("\n", " ")[:width] for v in r] for r in df.limit(rows).collect()]
    wide = [max(len(x) for x in col) for col in zip(df.columns, *shown)]
    line = lambda values: " | ".join(v.ljust(n) for v, n in zip(values, wide)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * n for n in wide), *map(line, shown)])
