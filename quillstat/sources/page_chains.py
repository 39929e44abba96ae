"""SRC1 over damaged landings: quarantine of broken pages and a check of the page chains.

A landed page is one JSON text with its request ``url``, its ``data`` and
``paging.next``, the url of the page that follows.  Pages that don't parse are
quarantined with their place and a sample of their text; good pages give their
comments whatever happened to others.  Chains are checked by pointer jumping:
every page's pointer doubles its reach each round, so a chain of n pages takes
log2(n) rounds of one join; pages that still point on when everything else has
ended are on a cycle or lead into one.  The joins of pages with pages are
shuffled: both sides grow with the landing, and a broadcast would send one
through the driver in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .comments import COMMENT_PAGE_SCHEMA, comments_from_pages

_PAGE = T.StructType([T.StructField("url", T.StringType()), *COMMENT_PAGE_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """``post_id, place, value``: each file below ``path`` is one page; ``post_id=...`` folders name the post."""
    raw = spark.read.option("wholetext", True).option("basePath", path).text(path).withColumn("place", F.col("_metadata.file_path"))
    post = F.col("post_id").cast("string") if "post_id" in raw.columns else F.lit(None).cast("string")
    return raw.select(post.alias("post_id"), "place", "value")


def parsed_pages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``post_id, place, value`` -> good pages (``post_id, place, url, data, paging``), and quarantined ones.

    Quarantine: ``post_id, place, reason, sample``.  A page without a url goes by
    its place; of pages landed again (same post and url) the one with most
    comments is good, the others are quarantined as repeated."""
    p = raw.withColumn("p", F.from_json("value", _PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reason = (F.when(F.col("value").isNull() | (F.trim("value") == ""), "empty").when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), "unreadable")
              .when(F.col("p.data").isNull(), "no data"))
    p = p.select("post_id", "place", F.substring("value", 1, 200).alias("sample"), reason.alias("reason"),
                 F.coalesce("p.url", "place").alias("url"), F.col("p.data").alias("data"), F.col("p.paging").alias("paging"))
    p = cut_lineage(p)
    good = p.filter("reason is null")
    first = good.groupBy("post_id", "url").agg(F.min(F.struct((-F.size("data")).alias("n"), "place")).alias("f")).select("post_id", "url", F.col("f.place").alias("place")).hint("merge")
    key = ["post_id", "url", "place"]
    same = [good[c].eqNullSafe(first[c]) for c in key]
    again = good.join(first, same[0] & same[1] & same[2], "left_anti")
    bad = p.filter("reason is not null").select("post_id", "place", "reason", "sample").unionByName(
        again.select("post_id", "place", F.lit("repeated").alias("reason"), "sample"))
    return good.join(first, same[0] & same[1] & same[2], "left_semi").select("post_id", "place", "url", "data", "paging"), bad


def chains(pages: DataFrame) -> DataFrame:
    """Good pages -> one row per chain: ``post_id, head, pages, comments, status, missing``.

    ``head``: the url that no page of the post points to (of a cycle: its
    smallest url).  ``status``: complete, broken (``missing`` is the url that
    did not land) or cyclic.  Where several chains run into one page, each
    counts it."""
    at = pages.select(F.coalesce("post_id", F.lit("")).alias("post_id"), "url", F.nullif(F.col("paging.next"), F.lit("")).alias("next"), F.size("data").cast("long").alias("n"))
    at = cut_lineage(at)
    known = at.select("post_id", F.col("url").alias("next"), F.lit(True).alias("_known")).hint("merge")
    # ptr: the page reached so far (null: the chain has ended), last: the last page seen before that
    state = at.join(known, ["post_id", "next"], "left").select(
        "post_id", "url", F.when(F.col("_known"), F.col("next")).alias("ptr"), F.lit(1).cast("long").alias("pages"), F.col("n").alias("comments"),
        F.when(F.col("next").isNotNull() & F.col("_known").isNull(), F.col("next")).alias("missing"), F.col("url").alias("least"))
    rounds = max(1, (at.count() or 1).bit_length())
    for _ in range(rounds):
        state = cut_lineage(state)
        if state.filter("ptr is not null").isEmpty():
            break
        to = state.select("post_id", F.col("url").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("pages").alias("_pages"),
                          F.col("comments").alias("_comments"), F.col("missing").alias("_missing"), F.col("least").alias("_least")).hint("merge")
        state = state.join(to, ["post_id", "ptr"], "left").select(
            "post_id", "url", F.col("_ptr").alias("ptr"), (F.col("pages") + F.coalesce("_pages", F.lit(0))).alias("pages"),
            (F.col("comments") + F.coalesce("_comments", F.lit(0))).alias("comments"), F.coalesce("missing", "_missing").alias("missing"),
            F.least("least", "_least").alias("least"))
    state = cut_lineage(state)
    pointed = at.filter("next is not null").select("post_id", F.col("next").alias("url")).distinct().hint("merge")
    heads = state.join(pointed, ["post_id", "url"], "left_anti")
    ended = heads.filter("ptr is null").select("post_id", F.col("url").alias("head"), "pages", "comments",
                                               F.when(F.col("missing").isNull(), "complete").otherwise("broken").alias("status"), "missing")
    # a page that still points on after all rounds leads into a cycle: its counts went round, so they are taken from the pages themselves
    loops = state.filter("ptr is not null").join(at.select("post_id", "url", "n").hint("merge"), ["post_id", "url"]).groupBy("post_id", F.col("least").alias("head")).agg(
        F.count(F.lit(1)).cast("long").alias("pages"), F.sum("n").alias("comments"))
    loops = loops.select("post_id", "head", "pages", "comments", F.lit("cyclic").alias("status"), F.lit(None).cast("string").alias("missing"))
    return ended.unionByName(loops)


def ingest(raw: DataFrame, post_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Landed pages -> comments of all good pages (each once), quarantined pages, chains."""
    good, bad = parsed_pages(raw)
    comments = comments_from_pages(good, post_id)
    once = comments.groupBy("post_id", "comment_id").agg(F.min(F.struct(*comments.columns)).alias("c")).select("c.*")
    return once, bad, chains(good)
