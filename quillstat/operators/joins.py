"""Relational forms of the reference's lookups (JN1, JN4, JN6, SET2, SET3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import REACTION_COLS, REACTION_TYPES
from .perpost import per_post


def reaction_backfill(comments: DataFrame, reactions: DataFrame) -> DataFrame:
    """JN1: for posts whose like_count sums to 0, take the seven counts from a
    long reaction table (comment_id, type, cnt); other posts are left alone.
    Missing counts become 0."""
    wide = (reactions.withColumn("type", F.lower("type"))
            .groupBy("comment_id").pivot("type", list(REACTION_TYPES)).agg(F.sum("cnt")))
    gate = comments.groupBy("post_id").agg(
        (F.sum(F.coalesce(F.col("like_count"), F.lit(0))) == 0).alias("_fill"))
    d = per_post(comments, gate, "inner").join(
        wide.select("comment_id", *[F.col(t).alias(f"_rx_{t}") for t in REACTION_TYPES]), "comment_id", "left")
    out = d.withColumns({
        f"{t}_count": F.when(F.col("_fill"), F.coalesce(F.col(f"_rx_{t}"), F.lit(0)).cast("long"))
        .otherwise(F.col(f"{t}_count")) for t in REACTION_TYPES})
    return out.select(*comments.columns)


def select_posts(posts: DataFrame, selection: DataFrame, min_selected: int = 2) -> DataFrame:
    """JN4: the compared posts (id, likes, comments, shares) when at least
    ``min_selected`` are picked; otherwise empty."""
    picked = posts.join(selection.select(F.col("post_id").alias("id")).distinct(), "id", "left_semi")
    enough = (selection.agg(F.count_distinct("post_id").alias("n")).where(F.col("n") >= min_selected)
              .select(F.lit(1).alias("_enough")))  # one row or none
    return (picked.select("id", "like_count", "comment_count", "share_count", F.lit(1).alias("_enough"))
            .join(enough, "_enough", "left_semi").drop("_enough"))


def mark_handled(handled: DataFrame, post_id: str, cids: DataFrame) -> DataFrame:
    """SET2: union of the post's handled ids with new ones (set semantics)."""
    new = cids.select(F.lit(post_id).alias("post_id"), F.col("cid"))
    return handled.select("post_id", "cid").unionByName(new).distinct()


def clear_handled(handled: DataFrame, post_id: str) -> DataFrame:
    """SET3: drop every handled id of one post."""
    return handled.filter(F.col("post_id") != F.lit(post_id))


def without_handled(df: DataFrame, handled: DataFrame) -> DataFrame:
    """JN6: comments not yet handled (anti-join on post_id, cid)."""
    return df.join(handled.select("post_id", "cid"), ["post_id", "cid"], "left_anti")


def only_handled(df: DataFrame, handled: DataFrame) -> DataFrame:
    return df.join(handled.select("post_id", "cid"), ["post_id", "cid"], "left_semi")


def zero_reactions(comments: DataFrame, posts: list[str]) -> DataFrame:
    """Comments as a source delivers them when reaction aliases are blocked."""
    blocked = F.col("post_id").isin(posts)
    return comments.withColumns({c: F.when(blocked, F.lit(0).cast("long")).otherwise(F.col(c))
                                 for c in REACTION_COLS})
