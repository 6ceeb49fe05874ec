"""Incremental forms: bucket counts and enrichment over arriving library rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import not_backbone


def library_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Library files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def running_bucket_counts(rows: DataFrame, bucket: str = "aa_bucket") -> DataFrame:
    """Counts of buckets so far; state is one number a bucket. Use output mode complete or update."""
    return rows.where(not_backbone(F.col(bucket))).groupBy(bucket).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
