"""Mixing of sources to target weights by temperature (DataFrame functions only).

A source with token share p gets the weight p ** exponent, normalised. The exponent is searched in
0 to 1 by sections of its interval, each round one aggregate over the sources for many exponents
at once, until it meets a limit of repetition (no source is read more than so many times) or a
target entropy of the weights. The budget is the smallest at which every source is read whole at
least once, or a given count of tokens.

Weights are realised as block permutations: the documents of a source fall into blocks by hash,
which permutes them; a source is read whole as often as its budget holds it, and of the partial
reading the blocks are taken in order while tokens are left, within the last block document by
document. Sums run over blocks and groups of blocks, never over a whole source in one task.

Defined cases: a null text has no tokens; a null source is the source ""; a source without tokens is
read once; repeated rows count each, and many rows equal in id and text are spread over blocks like
different ones; of rows with equal keys in a block any may be read first; a null id is a value like
others; very long texts are only counted; further columns are carried as they are, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm._shared import materialize, with_copy_numbers, words

BLOCK_ROWS = 512
GROUP_BLOCKS = 1024
#: A block of so many times its rows is crowded.
CROWDED = 8


def _scan(shares: DataFrame, exponents: list[float]) -> list[dict]:
    """Entropy and greatest repetition of the weights for each exponent."""
    per = shares.select(F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"), "p", "lp")
    weight = F.exp(F.col("a") * F.col("lp"))
    gap = (F.col("a") - 1) * F.col("lp")
    out = per.groupBy("a").agg(
        F.sum(weight).alias("z"),
        F.sum(weight * F.col("a") * F.col("lp")).alias("s"),
        F.exp(F.max(gap) - F.min(gap)).alias("repetition"),
    )
    return [{"a": r["a"], "entropy": log(r["z"]) - r["s"] / r["z"], "repetition": r["repetition"]} for r in out.orderBy("a").collect()]


def find_exponent(
    sources: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None, rounds: int = 6, sections: int = 32
) -> float:
    """The smallest exponent within the limit of repetition, or that whose entropy is the target's.

    Both fall as the exponent grows. sources: ``tokens`` of each source.
    """
    total = sources.agg(F.sum("tokens").alias("t")).first()["t"]
    if not total:
        return 1.0
    shares = sources.filter("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("p")).withColumn("lp", F.log("p"))
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * k / sections for k in range(sections + 1)]
        seen = _scan(shares, grid)
        good = [x["repetition"] <= max_repetition if target_entropy is None else x["entropy"] <= target_entropy for x in seen]
        if good[0]:
            return grid[0]
        k = next((k for k, g in enumerate(good) if g), None)
        if k is None:  # even the natural shares have more entropy than the target
            return 1.0
        low, high = grid[k - 1], grid[k]
    return high


def source_plan(
    sources: DataFrame, exponent: float, budget_tokens: float | None = None
) -> DataFrame:
    """``source``, ``n_docs``, ``tokens``, ``weight``, ``epochs`` (whole readings) and ``rest`` (tokens of the partial one)."""
    totals = sources.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    share = F.col("tokens") / F.lit(float(max(totals, 1)))
    raw = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent))).otherwise(0.0)
    weighed = sources.withColumn("raw", raw)
    z = weighed.agg(F.sum("raw").alias("z"), F.max(F.when(F.col("raw") > 0, F.col("tokens") / F.col("raw"))).alias("cover")).first()
    weighed = weighed.withColumn("weight", F.col("raw") / F.lit(z["z"] or 1.0))
    # cover: the source that is read least is read exactly once
    quota = F.col("raw") * F.lit(z["cover"] or 0.0) if budget_tokens is None else F.col("weight") * F.lit(float(budget_tokens))
    quota = F.round(quota).cast("long")
    epochs = F.when(F.col("tokens") > 0, F.floor(quota / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long")
    return weighed.withColumn("quota", quota).select(
        "source", "n_docs", "tokens", "weight", epochs.alias("epochs"), F.greatest(F.col("quota") - epochs * F.col("tokens"), F.lit(0)).cast("long").alias("rest")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
    max_repetition: float | None = 2.0,
    target_entropy: float | None = None,
    budget_tokens: float | None = None,
    seed: int = 7,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A row for each reading of a document: ``row`` (carried columns), ``source``, ``n_tokens``, ``block``, ``epoch``.

    Tokens are words split at white space.
    """
    carry = docs.columns if carry is None else carry
    text = F.col(text_col).cast("string")
    d = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.size(words(text)).cast("long").alias("n_tokens"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("key"),
    )
    slim = d.select("source", "n_tokens", "key")
    if set(carry) <= {id_col, source_col}:
        d = materialize(d, "mixing")
        slim = d.select("source", "n_tokens", "key")
    sources = materialize(slim.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens")), "sources")
    plan = materialize(source_plan(sources, find_exponent(sources, max_repetition, target_entropy), budget_tokens), "plan")

    def blocked(x: DataFrame) -> DataFrame:
        return x.join(plan.select("source", "n_docs", "epochs", "rest"), "source").withColumn("block", _block(F.col("key"), F.col("n_docs"), block_rows))

    def summed(x: DataFrame) -> DataFrame:
        return materialize(blocked(x).groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "blocks")

    blocks = summed(slim)
    if not blocks.filter(F.col("n") > CROWDED * block_rows).isEmpty():
        # many equal rows: each copy gets a key, and so a block, of its own
        suspects = blocked(slim).join(blocks.filter(F.col("n") > CROWDED * block_rows).select("source", "block"), ["source", "block"], "left_semi").select("source", "key")
        d = with_copy_numbers(d, ["source", "key"], block_rows, materialize(suspects.distinct(), "suspects"))
        d = d.withColumn("key", F.when(F.col("_copy") > 0, F.xxhash64("key", "_copy")).otherwise(F.col("key"))).drop("_copy")
        slim = d.select("source", "n_tokens", "key")
        blocks = summed(slim)
    blocks = blocks.withColumn("super", F.floor(F.col("block") / GROUP_BLOCKS))
    # tokens before each block: of the groups before its group, then of the blocks before it
    supers = blocks.groupBy("source", "super").agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy("source").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("source", "super", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before_super"))
    w = Window.partitionBy("source", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(supers, ["source", "super"]).select(
        "source", "block", "tokens", (F.col("before_super") + F.coalesce(F.sum("tokens").over(w), F.lit(0))).alias("before")
    )
    w = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    out = blocked(d).join(blocks.select("source", "block", "before"), ["source", "block"])
    begun = F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    out = out.withColumn("readings", F.col("epochs") + F.when(begun < F.col("rest"), 1).otherwise(0))
    return (
        out.filter("readings > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("readings") - 1).cast("int"))))
        .select("row", "source", "n_tokens", "block", "epoch")
    )


def _block(key: Column, n_docs: Column, block_rows: int) -> Column:
    return F.pmod(key, F.ceil(n_docs / block_rows)).cast("long")
