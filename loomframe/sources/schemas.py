"""JSON lines without a declared schema: what each file holds, one schema for all, broken lines kept aside.

Every line is parsed once, as a value of any shape, and stored with its place; types are merged by
Spark's own widening of such values (whole numbers to decimals and doubles, fields that some lines lack, and
what can't be widened stays a value of any shape), by file and for all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.sources.lines import numbered_lines
from loomframe.sources.shared import store


@dataclass
class Discovered:
    """``lines``: stored (file, line, value, parsed: an object or null); ``schema``: a struct's type, or none where no line is an object."""

    lines: DataFrame
    schema: str | None

    @property
    def rows(self) -> DataFrame:
        """The fields of all objects, in the merged schema; a field that a line lacks is null."""
        good = self.lines.filter("parsed is not null")
        if self.schema is None:
            return good.select("file", "line")
        return good.select("file", "line", F.try_variant_get("parsed", "$", self.schema).alias("_r")).select("file", "line", "_r.*")

    @property
    def broken(self) -> DataFrame:
        """Lines that are no JSON or no object, with their file and place; blank ones are left out."""
        return self.lines.filter("trim(value) <> '' and parsed is null").select("file", "line", "value")

    @property
    def by_file(self) -> DataFrame:
        """``file``, ``good`` and ``broken`` lines and the type of its objects."""
        bad = F.col("parsed").isNull() & (F.trim("value") != "")
        return self.lines.groupBy("file").agg(F.count("parsed").alias("good"), F.count_if(bad).alias("broken"), F.schema_of_variant_agg("parsed").alias("schema"))


def discover(spark: SparkSession, path: str | list[str]) -> Discovered:
    """Reads JSON lines of any shape once."""
    parsed = F.try_parse_json("value")
    d = numbered_lines(spark, path).withColumn("parsed", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))
    d = store(d, "parsed")
    merged = d.agg(F.schema_of_variant_agg("parsed").alias("s"), F.count("parsed").alias("n")).first()
    return Discovered(d, merged["s"].replace("OBJECT<", "STRUCT<") if merged["n"] else None)
