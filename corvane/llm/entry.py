"""The queries of this subpackage with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op03_quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op04_sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op01_warc import pages_through_archive

    return pages_through_archive(table(spark, sf_dir, "pages"), min_bytes=0)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op08_decontamination import verdicts

    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op06_toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op02_quality_classifier import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op05_substring_dedup import dedup_passages

    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op07_jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after its personal data and secrets are masked."""
    from .op09_token_counts import apply_edits, build_trees, mask_edits

    trees = build_trees(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return apply_edits(trees, mask_edits).drop("text", "tree")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
