"""Conversations: pairs, rendering, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.text import strip


def chat_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``prompt``, ``completion``: user turns that an assistant's turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = turns.withColumn("_role", F.lead("role").over(w)).withColumn("completion", F.lead("text").over(w))
    return d.filter("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "completion")


def render(turns: DataFrame, generation_prompt: bool = False, bos: str = "<bos>") -> DataFrame:
    """``conv_id``, ``rendered``, ``alternates``: a conversation in the turn format.

    The text of a system turn that comes first goes before that of the first turn; the assistant's
    role is written model. ``alternates``: users, and no others, have every second turn from the first,
    as the format demands.
    """
    d = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    led = F.coalesce(F.get("t", F.lit(0))["role"] == "system", F.lit(False))
    system = F.when(led, F.concat(F.get("t", F.lit(0))["text"], F.lit("\n\n"))).otherwise("")
    rest = F.when(led, F.slice("t", F.lit(2), F.size("t"))).otherwise(F.col("t"))
    d = d.select("conv_id", system.alias("s"), rest.alias("t"))
    parts = F.transform(
        "t",
        lambda x, i: F.concat(
            F.lit("<start_of_turn>"),
            F.when(x["role"] == "assistant", "model").otherwise(x["role"]),
            F.lit("\n"),
            F.when(i == 0, F.col("s")).otherwise(""),
            strip(x["text"]),
            F.lit("<end_of_turn>\n"),
        ),
    )
    expected = F.transform("t", lambda x, i: (x["role"] == "user") == (i % 2 == 0))
    end = "<start_of_turn>model\n" if generation_prompt else ""
    return d.select("conv_id", F.concat(F.lit(bos), F.array_join(parts, ""), F.lit(end)).alias("rendered"), F.forall(expected, lambda x: x).alias("alternates"))
