"""Canonical comment schema and column names."""

from __future__ import annotations

from pyspark.sql import types as T

REACTION_TYPES = ["like", "love", "haha", "wow", "sad", "angry", "care"]
REACTION_COLS = [f"{t}_count" for t in REACTION_TYPES]

COMMENT_SCHEMA = T.StructType(
    [T.StructField("post_id", T.StringType()),
     T.StructField("comment_id", T.StringType()),
     T.StructField("user_id", T.StringType()),
     T.StructField("user_name", T.StringType()),
     T.StructField("comment_text", T.StringType()),
     T.StructField("created_time", T.TimestampType())]
    + [T.StructField(c, T.LongType()) for c in REACTION_COLS]
    + [T.StructField("reply_count", T.LongType()),
       T.StructField("user_profile_link", T.StringType()),
       T.StructField("user_gender", T.StringType()),
       T.StructField("is_verified", T.BooleanType()),
       T.StructField("language", T.StringType()),
       T.StructField("parent_comment_id", T.StringType()),
       T.StructField("permalink_url", T.StringType())]
)

COMMENT_COLUMNS = [f.name for f in COMMENT_SCHEMA.fields]

# Columns added by ``enrich``.
ENRICHED_EXTRA = ["cid", "total_reactions", "engagement_score", "sentiment", "emotion",
                  "emoji_count", "word_count"]

# Row payload projections (the reference's JSON row lists).
ROW_PAYLOAD_COLS = ["cid", "user_name", "comment_text", "sentiment", "emotion",
                    "total_reactions", "engagement_score", "reply_count",
                    "created_time", "language", "permalink_url"]
WINDOW_PAYLOAD_COLS = ["cid", "user_name", "comment_text", "sentiment", "emotion",
                       "total_reactions", "engagement_score", "permalink_url"]
DASHBOARD_COLS = ["user_name", "comment_text", "sentiment", "emotion",
                  "total_reactions", "engagement_score"]

KPI_SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("total_comments", T.LongType()),
    T.StructField("advocacy", T.DoubleType()),
    T.StructField("safety_score", T.DoubleType()),
    T.StructField("avg_reactions_per_comment", T.DoubleType()),
    T.StructField("positivity_ratio", T.DoubleType()),
    T.StructField("median_engagement", T.DoubleType()),
])
