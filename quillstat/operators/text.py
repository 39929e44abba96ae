"""Text mining: keyword counts (AGG32/33, FN1, JN2) and hashtags (AGG28).

Tokens are exploded and pre-aggregated per (post, token) before the shuffle;
the stop-word test then runs on the aggregated rows as a broadcast anti-join
against the fixed stop list (a constant, so its size is known).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from .kpis import count_if
from .rankings import top_k


def stopword_table(spark, words=L.STOPWORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def token_counts(df: DataFrame, mode: str = "compat") -> DataFrame:
    """(post_id, word, count, pos_count, neg_count) over kept tokens."""
    toks = df.select("post_id", "sentiment", F.explode(X.raw_tokens("comment_text", mode)).alias("word"))
    agg = (toks.filter(X.cheap_keep_token(F.col("word")))
           .groupBy("post_id", "word")
           .agg(F.count(F.lit(1)).cast("long").alias("count"),
                count_if(F.col("sentiment") == "positive").alias("pos_count"),
                count_if(F.col("sentiment") == "negative").alias("neg_count")))
    stops = F.broadcast(stopword_table(df.sparkSession))
    return agg.join(stops, "word", "left_anti")


def keyword_counts(df: DataFrame, k_all: int = 15, k_pos: int = 10, k_neg: int = 10,
                   mode: str = "compat") -> DataFrame:
    """AGG32: top keywords per post for all / positive / negative comments.
    Rows: post_id, scope, rank, word, count (count desc, word asc)."""
    tc = token_counts(df, mode)
    scoped = tc.select("post_id", "word", F.explode(F.array(
        F.struct(F.lit("all").alias("scope"), F.col("count").alias("n")),
        F.struct(F.lit("pos").alias("scope"), F.col("pos_count").alias("n")),
        F.struct(F.lit("neg").alias("scope"), F.col("neg_count").alias("n")))).alias("s"))
    scoped = scoped.select("post_id", "word", "s.scope", F.col("s.n").alias("count")).filter(F.col("count") > 0)
    # A literal limit (the largest k) lets Spark keep only that many rows per
    # (post, scope) on each mapper; the per-scope cap is applied afterwards.
    ranked = top_k(scoped, [F.col("count").desc(), F.col("word").asc()], max(k_all, k_pos, k_neg, 1),
                   by=["post_id", "scope"])
    cap = F.when(F.col("scope") == "all", k_all).when(F.col("scope") == "pos", k_pos).otherwise(k_neg)
    return ranked.filter(F.col("rank") <= cap).select("post_id", "scope", "rank", "word", "count")


def top_keyword(df: DataFrame, mode: str = "compat") -> DataFrame:
    """AGG33: the first keyword of each post, '' when none."""
    kw = keyword_counts(df, 1, 0, 0, mode).filter(F.col("scope") == "all")
    posts = df.select("post_id").distinct()
    return posts.join(kw.select("post_id", "word"), "post_id", "left").select(
        "post_id", F.coalesce(F.col("word"), F.lit("")).alias("top_keyword"))


def hashtag_counts(df: DataFrame, k: int = 10) -> DataFrame:
    """AGG28: whitespace words starting with '#', top k per post."""
    tags = df.select("post_id", F.explode(X.hashtags("comment_text")).alias("tag"))
    counts = tags.groupBy("post_id", "tag").agg(F.count(F.lit(1)).cast("long").alias("count"))
    return top_k(counts, [F.col("count").desc(), F.col("tag").asc()], k)


def comment_tokens(df: DataFrame, mode: str = "compat") -> DataFrame:
    """FN1 per comment: (post_id, cid, tokens)."""
    return df.select("post_id", "cid", X.tokenize("comment_text", mode).alias("tokens"))
