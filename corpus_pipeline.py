"""Documents to a training mix: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows as
Parquet to the shared folder and rereads them as the next one's docs. What a stage writes besides its
rows is removed when they are written, and its input when the next stage has read it.

Defined cases, for all stages: an empty table gives an empty result; further columns are carried,
whatever their names (sharding replaces ``shard`` and ``slot``); very long texts are read whole. Rows
are judged one by one, also where ids are null or repeated. quality_rules: null and blank texts go, a
null source is one host. near_dedup: null and blank texts equal each other; of a group the smallest
id stays, of equal rows one, a row without id only if no other of its group has one. decontamination:
null and blank texts stay. mixing: null texts count no token; rows equal in id and text are read each.
sharding: equal rows share out their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import decontaminate, host_rules, mixing, near_copies, sharding, simhash
from loomframe.llm._shared import discard, materialize, read_table, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, read with the verdict on their host."""
    return host_rules.host_quality(docs, store_features=True).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more by five-word shingles)."""
    return simhash.keep_one(docs, grouping=near_copies.near_copy_groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: each at least once, small sources up to twice."""
    return mixing.mix_sources(docs).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their place in the shuffled shards; columns of these names are replaced."""
    return sharding.shard_rows(docs.drop("shard", "slot")).select("row.*", "shard", "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Near-copy groups and the alignment can't be put in SQL; a brute-force version checks run() in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark) as kept:
            before, docs = docs, kept(materialize(stage(spark, docs, sf_dir), name))
        if hasattr(before, "stored_at"):
            discard(spark, before)
    return docs
