"""PRJ2/PRJ5 and model columns: the enriched comment table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import REACTION_COLS


def total_reactions(cols=REACTION_COLS) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in cols])


def with_engagement(df: DataFrame) -> DataFrame:
    """PRJ2: total_reactions = sum of 7 reactions (null -> 0); engagement = total + replies."""
    for c in REACTION_COLS + ["reply_count"]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0).cast("long"))
    return df.withColumns({
        "total_reactions": total_reactions(),
        "engagement_score": total_reactions() + F.coalesce(F.col("reply_count"), F.lit(0)).cast("long"),
    })


def row_cid() -> Column:
    """PRJ5: comment id, else md5('<user>|<text>')."""
    return F.coalesce(
        F.nullif(F.col("comment_id").cast("string"), F.lit("")),
        F.md5(F.concat(F.coalesce(F.col("user_name"), F.lit("")), F.lit("|"),
                       F.coalesce(F.col("comment_text"), F.lit("")))))


def enrich(df: DataFrame, sentiment_scorer=None, emotion_scorer=None,
           language_scorer=None, token_mode: str = "compat", blank_as_null: bool = False) -> DataFrame:
    """Conformed comments -> enriched comments.

    Model columns: an existing ``sentiment`` / ``emotion`` column is kept unless
    a scorer is given (see ``functions.scorers``); when absent the default
    native scorer runs.  Sentiment is normalised once to positive / negative /
    neutral (ruling R12).
    """
    from ..functions import scorers

    df = with_engagement(df)
    if blank_as_null:
        df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("user_id", "user_name", "language")
                             if c in df.columns})
    if "comment_id" not in df.columns:
        df = df.withColumn("comment_id", F.lit(None).cast("string"))
    df = df.withColumn("cid", row_cid())
    if sentiment_scorer is not None or "sentiment" not in df.columns:
        df = (sentiment_scorer or scorers.lexicon_sentiment)(df)
    if emotion_scorer is not None or "emotion" not in df.columns:
        df = (emotion_scorer or scorers.lexicon_emotion)(df)
    if language_scorer is not None:
        df = language_scorer(df)
    return df.withColumns({
        "sentiment": X.sentiment3("sentiment"),
        "emotion": F.lower(F.col("emotion")),
        "emoji_count": X.emoji_count("comment_text"),
        "word_count": X.word_count("comment_text", token_mode),
    })
