"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.llm import (co_training, conversation_repair, decontamination, jaccard_join, mixing, path_compaction, periodic_runs, quality_rules, sharding,
                            suffix_dedup, token_counts, toxicity, tree_weighting)
from atlasmill.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers  # where it is absent, only this query is
    with open(public_tokenizers.path(vocabulary), "rb") as file:
        return token_counts.token_counts(table(spark, sf_dir, "documents"), file.read(), limit=4096)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_training.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards=24)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_weighting.score(table(spark, sf_dir, "documents"), held_out_fold=0, folds=10)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), least=50)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = path_compaction.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), least=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_quality_classifier, op4_decontamination, op5_mixing, op6_sharding, op7_quality_rules, op8_ngram_jaccard, op9_lm_scoring,
                                 op10_suffix_dedup, op11_periodic_runs, op12_conversation_repair, op13_substring_dedup)}

SQL: dict[str, str] = {}
