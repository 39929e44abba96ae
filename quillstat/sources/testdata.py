"""Adapter from the generated test tables to the comment schema (``comments_v``).

documents ⋈ events on ``event_id = doc_id`` gives one comment per document;
reaction counts come from all events with ``event_id % n_documents = doc_id``;
sentiment comes from ``labels``.  Every join here is keyed on ``doc_id``, so
Spark hash-partitions each input once on that key and the three joins share
one partitioning (no extra exchange between them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REACTION_COLS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def comments_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments in the canonical column set, plus model outputs ``sentiment``/``emotion``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")

    # A scalar from parquet footers; used as a literal, not a join.
    n_docs = docs.count()

    rx = (events
          .select((F.col("event_id") % F.lit(n_docs)).alias("doc_id"),
                  (F.col("event_id") % 7).alias("rtype"),
                  F.floor(F.col("value") / 25).cast("long").alias("v"))
          .groupBy("doc_id")
          .agg(*[F.sum(F.when(F.col("rtype") == i, F.col("v"))).alias(c)
                 for i, c in enumerate(REACTION_COLS)]))

    own = events.withColumnRenamed("event_id", "doc_id")
    text = F.concat(
        F.col("text"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(" why is that?")).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 11 == 0,
               F.concat(F.lit(" #topic"), (F.col("doc_id") % 5).cast("string"))).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 13 == 0, F.lit(" 😅😅 ok 🙌")).otherwise(F.lit("")),
        # no-break and ideographic spaces, and a link that ends at one
        F.when(F.col("doc_id") % 17 == 0, F.lit("\u00a0#news\u3000later www.a.example/b\u00a0after")).otherwise(F.lit("")),
    )
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    base = (docs.join(own, "doc_id", "inner")
            .join(rx, "doc_id", "left")
            .join(labels, "doc_id", "left"))
    return base.select(
        F.concat(F.lit("post_"), (F.col("doc_id") % 4).cast("string")).alias("post_id"),
        F.concat(F.lit("cmt_"), F.col("doc_id").cast("string")).alias("comment_id"),
        user.alias("user_id"),
        user.alias("user_name"),
        text.alias("comment_text"),
        F.col("ts").cast("timestamp").alias("created_time"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in REACTION_COLS],
        F.floor(F.col("value") / 100).cast("long").alias("reply_count"),
        F.lit(None).cast("string").alias("user_profile_link"),
        F.lit(None).cast("string").alias("user_gender"),
        F.lit(None).cast("boolean").alias("is_verified"),
        F.col("lang").alias("language"),
        F.lit(None).cast("string").alias("parent_comment_id"),
        F.lit(None).cast("string").alias("permalink_url"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .otherwise("neutral").alias("sentiment"),
        F.concat(F.col("event_type"), F.lit("_"), (F.col("doc_id") % 3).cast("string")).alias("emotion"),
    )
