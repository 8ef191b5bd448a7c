"""Places where a user's own functions of columns take part: rewards, judges, metrics, formats, rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.scores import null_skipping_sum
from loomframe.functions.text import unit_hash


def first_rule(text: Column, rules: list[tuple[str, Column]], otherwise: Column) -> Column:
    """The value of the first rule whose pattern is found in the text."""
    out = otherwise
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


def with_rewards(df: DataFrame, rewards: dict[str, Callable[[DataFrame], Column]], weights: dict[str, float] | None = None) -> DataFrame:
    """df with a column for each reward, their weighted sum ``reward`` (nulls skipped) and ``unrewarded`` (all null)."""
    df = df.withColumns({k: f(df) for k, f in rewards.items()})
    parts = [((weights or {}).get(k, 1.0), F.col(k)) for k in rewards]
    missing = F.lit(True)
    for _, c in parts:
        missing = missing & (c.isNull() | F.isnan(c.cast("double")))
    return df.withColumns({"reward": null_skipping_sum(parts), "unrewarded": missing})


def judged(df: DataFrame, first: str, second: str, judge: Callable[[Column, Column], Column]) -> DataFrame:
    """df with ``chosen`` and ``rejected``; the judge says whether the first is better, null counts as no."""
    better = F.coalesce(judge(F.col(first), F.col(second)), F.lit(False))
    return df.withColumns({"chosen": F.when(better, F.col(first)).otherwise(F.col(second)), "rejected": F.when(better, F.col(second)).otherwise(F.col(first))})


def metrics(df: DataFrame, by: list[str], compute: dict[str, Callable[[DataFrame], Column]], prefix: str = "eval_") -> DataFrame:
    """One row for each group with the user's aggregates, their names prefixed."""
    return df.groupBy(*by).agg(*[f(df).alias(prefix + k) for k, f in compute.items()])


def formatted(df: DataFrame, texts: Callable[[DataFrame], Column], keys: list[str]) -> DataFrame:
    """Rows ``keys``, ``place``, ``text`` of a format that gives an array of texts for each row."""
    found = texts(df)
    if df.select(found.alias("x")).schema["x"].dataType.typeName() != "array":
        raise ValueError("a format gives an array of texts")
    return df.select(*keys, F.posexplode(found).alias("place", "text"))


def sometimes(share: float, generated: Column, given: Column, *keys: Column) -> Column:
    """The generated value for a share of the rows, chosen by hash of the keys, else the given one."""
    return F.when(unit_hash(*keys) <= share, generated).otherwise(given)
