"""Comment sources: landed API pages (JSON), CSV, Parquet; schema conform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scorers import script_language_of
from ..functions.timefn import parse_timestamp
from ..schema import COMMENT_SCHEMA, REACTION_COLS, REACTION_TYPES

_SUMMARY = T.StructType([T.StructField("summary", T.StructType(
    [T.StructField("total_count", T.LongType())]))])

# One landed page of the comments API.
COMMENT_PAGE_SCHEMA = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType(
        [T.StructField("id", T.StringType()),
         T.StructField("message", T.StringType()),
         T.StructField("from", T.StructType([T.StructField("id", T.StringType()),
                                             T.StructField("name", T.StringType())])),
         T.StructField("created_time", T.StringType()),
         T.StructField("comment_count", T.LongType()),
         T.StructField("parent", T.StructType([T.StructField("id", T.StringType())])),
         T.StructField("permalink_url", T.StringType())]
        + [T.StructField(f"rx_{t}", _SUMMARY) for t in REACTION_TYPES]))),
    T.StructField("paging", T.StructType([T.StructField("next", T.StringType())])),
])

# One landed page of the posts API.
POST_PAGE_SCHEMA = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("permalink_url", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("created_time", T.StringType()),
        T.StructField("full_picture", T.StringType()),
        T.StructField("attachments", T.StructType([T.StructField("data", T.ArrayType(T.StructType([
            T.StructField("media_type", T.StringType()),
            T.StructField("media", T.StructType([T.StructField("image", T.StructType(
                [T.StructField("src", T.StringType())]))])),
            T.StructField("url", T.StringType())])))])),
        T.StructField("reactions", _SUMMARY),
        T.StructField("comments", _SUMMARY),
        T.StructField("shares", T.StructType([T.StructField("count", T.LongType())])),
    ]))),
])


def reaction_count(obj: str, rtype: str):
    """SRC2: ``rx_<type>.summary.total_count``, 0 when absent."""
    return F.coalesce(F.col(f"{obj}.rx_{rtype}.summary.total_count").cast("long"), F.lit(0).cast("long"))


def comments_from_pages(pages: DataFrame, post_id: str | None = None, toplevel: bool = False) -> DataFrame:
    """SRC1: explode landed API pages into comment rows (reference field mapping).

    ``post_id`` comes from a ``post_id=...`` partition folder when present.
    """
    pid = _post_id(pages, post_id)
    c = pages.select(pid.alias("post_id"), F.explode("data").alias("c"))

    def s(path):
        return F.coalesce(F.col(path), F.lit(""))

    out = c.select(
        "post_id",
        s("c.id").alias("comment_id"),
        s("c.from.id").alias("user_id"),
        s("c.from.name").alias("user_name"),
        s("c.message").alias("comment_text"),
        F.col("c.created_time").alias("created_time"),
        *[reaction_count("c", t).alias(f"{t}_count") for t in REACTION_TYPES],
        F.coalesce(F.col("c.comment_count"), F.lit(0)).cast("long").alias("reply_count"),
        F.lit("").alias("user_profile_link"),
        F.lit("").alias("user_gender"),
        F.lit("").alias("is_verified"),
        script_language_of(F.col("c.message")).alias("language"),
        s("c.parent.id").alias("parent_comment_id"),
        s("c.permalink_url").alias("permalink_url"),
    )
    if toplevel:
        out = out.where("parent_comment_id = ''")
    return conform(out)


def _post_id(df: DataFrame, post_id: str | None) -> Column:
    """The rows' post; rows without one would drop out of every join, so they are an error."""
    if "post_id" not in df.columns:
        if post_id is None:
            raise ValueError("no post_id: neither a column, a landing folder post_id=... nor an argument gives it")
        return F.lit(post_id)
    missing = F.raise_error(F.lit("a row has no post_id")) if post_id is None else F.lit(post_id)
    return F.coalesce(F.col("post_id").cast("string"), missing.cast("string"))


def read_comment_pages(spark: SparkSession, path: str, multi_line: bool = True,
                       post_id: str | None = None, toplevel: bool = False) -> DataFrame:
    pages = spark.read.schema(COMMENT_PAGE_SCHEMA).option("multiLine", multi_line).json(path)
    return comments_from_pages(pages, post_id, toplevel)


def load_comments(spark: SparkSession, path: str, fmt: str = "parquet",
                  post_id: str | None = None, **opts) -> DataFrame:
    """SRC6: one entry point over landed json pages / csv / parquet, conformed."""
    if fmt == "json":
        return read_comment_pages(spark, path, post_id=post_id, **opts)
    if fmt == "csv":
        # All columns as strings; conform casts (no schema inference pass).
        # A file with line breaks inside quotes needs multi_line=True and is then read by one task.
        df = spark.read.option("header", True).option("multiLine", opts.pop("multi_line", False)).option("escape", '"').csv(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return conform(df.withColumn("post_id", _post_id(df, post_id)))


def conform(df: DataFrame, keep_extra: bool = True) -> DataFrame:
    """PRJ1: canonical columns and types; absent columns get defaults.

    Reaction / reply counts: absent or null -> 0.  Strings: absent -> null.
    ``is_verified``: '' and unparsable -> null.  ``created_time``: see
    ``parse_timestamp``.  Extra columns (e.g. ``sentiment``) are kept.
    """
    cols = set(df.columns)
    exprs = []
    for f in COMMENT_SCHEMA.fields:
        name = f.name
        if name not in cols:
            default = F.lit(0).cast("long") if name in REACTION_COLS or name == "reply_count" else F.lit(None)
            exprs.append(default.cast(f.dataType).alias(name))
            continue
        c = F.col(name)
        if name in REACTION_COLS or name == "reply_count":
            e = F.coalesce(F.expr(f"try_cast(`{name}` AS BIGINT)"), F.lit(0).cast("long"))
        elif name == "created_time":
            e = parse_timestamp(df, name)
        elif name == "is_verified":
            e = F.expr("try_cast(nullif(trim(cast(`is_verified` AS STRING)), '') AS BOOLEAN)")
        else:
            e = c.cast(f.dataType)
        exprs.append(e.alias(name))
    extra = [F.col(c) for c in df.columns if c not in {f.name for f in COMMENT_SCHEMA.fields}] if keep_extra else []
    return df.select(*exprs, *extra)


def posts_from_pages(pages: DataFrame) -> DataFrame:
    """SRC3/SRC4: post rows with media pick and 0-defaulted totals."""
    p = pages.select(F.explode("data").alias("p"))
    atts = F.coalesce(F.col("p.attachments.data"), F.array().cast(
        POST_PAGE_SCHEMA["data"].dataType.elementType["attachments"].dataType["data"].dataType))
    videos = F.filter(atts, lambda a: a["media_type"] == "video")
    pics = F.filter(atts, lambda a: a["media_type"].isin("video", "photo")
                    & (F.coalesce(F.length(a["media"]["image"]["src"]), F.lit(0)) > 0))
    return p.select(
        F.col("p.id").alias("id"),
        F.col("p.permalink_url").alias("permalink_url"),
        F.col("p.message").alias("message"),
        F.col("p.created_time").alias("created_time"),
        F.coalesce(F.try_element_at(pics, F.lit(-1))["media"]["image"]["src"],
                   F.col("p.full_picture")).alias("picture_url"),
        F.try_element_at(videos, F.lit(-1))["url"].alias("video_url"),
        F.coalesce(F.col("p.reactions.summary.total_count"), F.lit(0)).cast("long").alias("like_count"),
        F.coalesce(F.col("p.comments.summary.total_count"), F.lit(0)).cast("long").alias("comment_count"),
        F.coalesce(F.col("p.shares.count"), F.lit(0)).cast("long").alias("share_count"),
    )


def read_posts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return posts_from_pages(spark.read.schema(POST_PAGE_SCHEMA).option("multiLine", multi_line).json(path))
