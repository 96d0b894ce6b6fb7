"""A corpus pipeline of five operators: what one stage keeps is what the next one works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlasmill.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from atlasmill.llm.common import configure, stage, table, unstage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; null and empty texts are scored like any other."""
    configure(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 over five-word shingles, the smallest id stays; rows without words all stay."""
    configure(spark)
    return jaccard_join.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, with or without an id, go; null texts stay."""
    configure(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are not taken."""
    configure(spark)
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row of the mix; repeated rows have a place each."""
    configure(spark)
    return sharding.shard(docs, n_shards=24)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learning, similarity links and dependent rounding are not SQL; tests compare ``run`` with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        if before is not None:
            unstage(before)  # the next stage is stored
        before = docs
    return docs


QUERIES = {"pipeline": run}
