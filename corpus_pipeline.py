"""The corpus pipeline: quality rules, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, whatever their
names; only doc_id, text and n_chars are read. Defined results: null, empty and wordless texts go
in the first stage, which rejects texts of few words; rows with a null id are documents like any
other, and of rows with equal ids each is judged by its own text; of equal texts the row of the
smallest id stays (of those with one id, or none, the first); empty tables give empty results, an
empty benchmark removes nothing; very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import forget_table, table, written
from corvane.llm.op03_quality_rules import kept_rows
from corvane.llm.op05_substring_dedup import dedup_passages
from corvane.llm.op07_jaccard_join import one_of_each
from corvane.llm.op08_decontamination import clean_rows
from corvane.llm.op10_packing import pack


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return kept_rows(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document; n_chars follows the text."""
    out = dedup_passages(docs, spans=None)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("substring dedup", cut_passages),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_windows),
]

#: SQL expresses neither the repetition measures nor tiling nor token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
            if before is not None:
                forget_table(before)
            before = docs
    return docs
