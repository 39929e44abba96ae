"""STR1-STR5: comments arriving over time.

Each stream operator equals its batch operator when the stream is run to the
end (``trigger(availableNow=True)``) over the same files.  ``sink`` makes the
results durable: windows in append mode leave once, when the watermark has
passed them, and each micro-batch owns a partition of the result table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COMMENT_SCHEMA
from ..sources.comments import COMMENT_PAGE_SCHEMA, comments_from_pages
from .contagion import contagion_pairs  # noqa: F401  (STR5)

ENRICHED_STREAM_SCHEMA = T.StructType(COMMENT_SCHEMA.fields + [
    T.StructField("sentiment", T.StringType()), T.StructField("emotion", T.StringType())])


def comment_page_stream(spark: SparkSession, path: str, post_id: str | None = None,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """STR1: landed API pages (JSON) as a stream of conformed comments."""
    r = spark.readStream.schema(COMMENT_PAGE_SCHEMA).option("multiLine", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return comments_from_pages(r.json(path), post_id)


def comment_row_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                       schema: T.StructType = ENRICHED_STREAM_SCHEMA,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """STR1: comment rows (canonical schema) landed as parquet / json files."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def dedupe(stream: DataFrame, delay: str) -> DataFrame:
    """STR2: drop re-delivered comments (same post and comment id) within the watermark."""
    return (stream.withWatermark("created_time", delay)
            .dropDuplicatesWithinWatermark(["post_id", "comment_id"]))


def timeline_counts(stream: DataFrame, delay: str, width: str = "1 hour") -> DataFrame:
    """STR3: comments per tumbling window per post (zero bins are filled when read)."""
    return (stream.filter(F.col("created_time").isNotNull()).withWatermark("created_time", delay)
            .groupBy("post_id", F.window("created_time", width).alias("w"))
            .agg(F.count(F.lit(1)).cast("long").alias("count"))
            .select("post_id", F.col("w.start").alias("bin_start"), "count"))


def hourly_sentiment_counts(stream: DataFrame, delay: str, width: str = "1 hour") -> DataFrame:
    """STR4: comments per window, post and sentiment."""
    return (stream.filter(F.col("created_time").isNotNull()).withWatermark("created_time", delay)
            .groupBy("post_id", F.window("created_time", width).alias("w"), "sentiment")
            .agg(F.count(F.lit(1)).cast("long").alias("count"))
            .select("post_id", F.col("w.start").alias("bin_start"), "sentiment", "count"))


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Run a streaming query over everything available, into a memory table."""
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)
