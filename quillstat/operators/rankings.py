"""Top-k lists (TOP1-TOP13) and card shapes (PRJ6/PRJ7).

``row_number() over (partition by post_id order by ...) <= k`` is planned with
Spark's window group limit: each mapper keeps only its k best rows per post
before the shuffle, so a hot post never ships all its rows.  Ties are broken
by ``cid`` ascending (ruling R1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .kpis import engagement_thresholds


def top_k(df: DataFrame, order: list[Column], k: int | None, by: str | list[str] = "post_id",
          rank_col: str = "rank") -> DataFrame:
    by = [by] if isinstance(by, str) else by
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w).cast("long"))
    return out.filter(F.col(rank_col) <= k) if k is not None else out


def card(df: DataFrame, with_sentiment: bool = True) -> DataFrame:
    """PRJ6/PRJ7 card row: user, text, sent, emo, react, eng, link."""
    cols = [F.col("post_id"), F.col("rank"), F.col("cid"),
            F.col("user_name").alias("user"), F.col("comment_text").alias("text")]
    if with_sentiment:
        cols.append(F.col("sentiment").alias("sent"))
    cols += [F.col("emotion").alias("emo"), F.col("total_reactions").alias("react"),
             F.col("engagement_score").alias("eng"), F.col("permalink_url").alias("link")]
    return df.select(*cols)


def _ranked(df: DataFrame, metric: str, k: int, tie: str = "cid") -> DataFrame:
    return card(top_k(df, [F.col(metric).desc(), F.col(tie).asc()], k))


def top_loved(df: DataFrame, k: int = 5, require_positive: bool = True) -> DataFrame:
    """TOP1 (+FLT9): love_count desc, only love_count > 0."""
    d = df.filter(F.col("love_count") > 0) if require_positive else df
    return _ranked(d, "love_count", k)


def top_haha(df: DataFrame, k: int = 5, require_positive: bool = True) -> DataFrame:
    """TOP2 (+FLT9)."""
    d = df.filter(F.col("haha_count") > 0) if require_positive else df
    return _ranked(d, "haha_count", k)


def top_reacted(df: DataFrame, k: int = 5) -> DataFrame:
    """TOP3."""
    return _ranked(df, "total_reactions", k)


def top_engaged(df: DataFrame, k: int = 5) -> DataFrame:
    """TOP4."""
    return _ranked(df, "engagement_score", k)


def examples(df: DataFrame, k: int = 3) -> DataFrame:
    """TOP5: best positive and negative comments by engagement, k each."""
    d = df.filter(F.col("sentiment").isin("positive", "negative"))
    r = top_k(d, [F.col("engagement_score").desc(), F.col("cid").asc()], k, by=["post_id", "sentiment"])
    return card(r).withColumnRenamed("sent", "kind")


def risks(df: DataFrame, k: int = 5, approx: bool = False) -> DataFrame:
    """TOP6/TOP7: negative comments at or above the post's p75 engagement."""
    # The threshold bounds the sort key from below, so the k best rows are taken
    # first and only they meet their post's threshold.
    best = top_k(df.filter(F.col("sentiment") == "negative"), [F.col("engagement_score").desc(), F.col("cid").asc()], k)
    d = best.join(engagement_thresholds(df, approx), "post_id").filter(F.col("engagement_score") >= F.col("high_engagement"))
    return card(d).sortWithinPartitions("post_id", "rank")  # at most k rows a post, all in one partition


def reply_queue(df: DataFrame, k: int = 10, approx: bool = False) -> DataFrame:
    """TOP7: the same rule as ``risks`` with k=10."""
    return risks(df, k, approx)


def question_bank(df: DataFrame, k: int = 10) -> DataFrame:
    """TOP8: unanswered questions by engagement."""
    d = df.filter(X.is_question("comment_text") & (F.coalesce(F.col("reply_count"), F.lit(0)) <= 0))
    return _ranked(d, "engagement_score", k)


def recent_toxic(df: DataFrame, recent: int | None = 200, k: int = 5, word_boundary: bool = False) -> DataFrame:
    """TOP9: among the newest ``recent`` comments (None: all), toxic ones by engagement."""
    if recent is not None:
        df = top_k(df, [F.col("created_time").desc_nulls_last(), F.col("cid").asc()], recent,
                   rank_col="recent_rank").drop("recent_rank")
    return _ranked(df.filter(X.toxic_hit("comment_text", word_boundary)), "engagement_score", k)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """TOP11: first rows for display (a display limit is the feature)."""
    return df.limit(n)


def posts_ordered(posts: DataFrame, newest_first: bool = True) -> DataFrame:
    """TOP12: post list ordered by time (distributed sort)."""
    ts = F.try_to_timestamp(F.col("created_time"), F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))
    return posts.orderBy(ts.desc_nulls_last() if newest_first else ts.asc_nulls_last(), F.col("id"))
