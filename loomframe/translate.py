"""Translation of utterances to commands as a column expression, with its history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import text as X
from loomframe.sources import files
from loomframe.streaming.history import success_rate

Model = Callable[[Column], Column]


class Translator:
    """Utterances through a model (a column of prompts to a column of tagged output), a parser and a gate."""

    def __init__(self, tool: str, model: Model, threshold: float = 0.6):
        self.tool, self.model, self.threshold = tool, model, threshold

    def translate(self, df: DataFrame, column: str) -> DataFrame:
        """df with ``command``, ``confidence``, ``explanation``, ``alternatives``, ``safe``, ``success`` and ``preview``."""
        prompt = X.inst_prompt(X.normalize(F.col(column)))
        d = df.withColumn("_p", X.parse_output(self.model(prompt)))
        d = d.select(*df.columns, "_p.*")
        c, conf = F.col("command"), F.col("confidence")
        d = d.withColumns({"safe": X.is_safe(c, self.tool), "success": X.passes(c, conf, self.tool, self.threshold)})
        return d.withColumn("preview", X.preview(c, conf, F.col("explanation"), F.col("alternatives"), F.col("success")))


class Lookup:
    """A model that answers with the example whose instruction shares most words with the utterance.

    corpus: ``instruction``, ``output`` (tagged lines, or a command alone). Stored as JSON lines in a folder.
    """

    def __init__(self, corpus: DataFrame):
        self.corpus = corpus

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lookup:
        return cls(files.read_jsonl(spark, path).select("instruction", "output"))

    def answer(self, utterance: str) -> DataFrame:
        """One row: ``utterance`` and ``answer`` in tagged lines, the shared part of the words as confidence; none without examples."""
        said = F.array_distinct(X.words(X.normalize(F.lit(utterance))))
        known = F.array_distinct(X.words(X.normalize(F.regexp_replace("instruction", "^Translate[^:]*: ", ""))))
        score = F.size(F.array_intersect(said, known)) / F.greatest(F.size(F.array_union(said, known)), F.lit(1))
        best = self.corpus.select("output", "instruction", score.alias("score")).orderBy(F.desc("score"), "instruction", "output").limit(1)
        tagged = F.concat(F.lit("COMMAND: "), "output", F.lit("\nEXPLANATION: as for: "), "instruction")
        lines = F.when(F.col("output").startswith("COMMAND:"), F.rtrim("output")).otherwise(tagged)
        return best.select(F.lit(utterance).alias("utterance"), F.concat(lines, F.lit("\nCONFIDENCE: "), X.two_places(F.col("score"))).alias("answer"))


class History:
    """Translations that were tried, appended as JSON."""

    def __init__(self, path: str):
        self.path = path

    def save(self, rows: DataFrame) -> None:
        files.append_history(rows, self.path)

    def load(self, spark) -> DataFrame:
        return files.read_history(spark, self.path)

    def success_rate(self, spark) -> float:
        """Share of the executed that succeeded; 0 without any."""
        rate = success_rate(self.load(spark).withColumn("_all", F.lit(1)), "_all").first()
        return rate["success_rate"] if rate else 0.0
