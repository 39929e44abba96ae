"""Mergeable partial aggregates: many windows from one pass over the comments.

Range presets end at a post's newest comment, so they are nested.  A comment
falls into the class of the shortest preset that holds it; one pass counts
``(post, class, measure, key)`` cells, and a preset is the sum of its classes.
What is not a sum is kept as counts that are: value counts for medians, hour and
emotion counts for modes, and for distinct counts the first class of each key.

``distinct_cells`` keeps distinct users and languages per fixed time bucket,
either as HLL sketches of fixed size or as exact keys; both merge over any run
of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage
from .filters import parse_range
from .kpis import finished_kpis
from .perpost import per_post
from .quantiles import quantiles_of_cells

#: The ranges offered, shortest first, and the name of the unbounded one.
PRESETS = ("3h", "6h", "12h", "24h", "3d", "7d", "30d")
ALL = "all"

_DISTINCT = ("user_id", "user_name", "language")
_MEDIANS = {"median_reactions": "total_reactions", "median_engagement": "engagement_score"}


def with_preset_class(df: DataFrame, presets=PRESETS) -> DataFrame:
    """Comments with a time and ``cls``, the number of the shortest preset that holds them (``len(presets)``: none)."""
    seconds = [parse_range(p) for p in presets]
    if seconds != sorted(set(seconds)):
        raise ValueError("presets must be ranges that grow")
    newest = df.groupBy("post_id").agg(F.max("created_time").alias("_newest"))
    d = per_post(df.filter(F.col("created_time").isNotNull()), newest, "inner")
    age = F.unix_micros("_newest") - F.unix_micros("created_time")
    cls = F.lit(len(presets))
    for i in reversed(range(len(presets))):
        cls = F.when(age <= seconds[i] * 1_000_000, F.lit(i)).otherwise(cls)
    return d.withColumn("cls", cls).drop("_newest")


def kpi_cells(df: DataFrame, presets=PRESETS) -> DataFrame:
    """``post_id, cls, measure, key, n, first``: the cells that all presets' KPIs are sums of (one pass, one shuffle)."""
    d = with_preset_class(df, presets)

    def cell(measure: str, key: Column | None, n: Column) -> Column:
        return F.struct(F.lit(measure).alias("measure"), (F.lit(None) if key is None else key).cast("string").alias("key"), n.cast("long").alias("n"))

    one = F.lit(1)
    rows = [cell("rows", None, one), cell("reactions", None, F.coalesce("total_reactions", F.lit(0))), cell("reacted", None, F.col("total_reactions").isNotNull().cast("int")),
            *[cell(s, None, F.coalesce((F.col("sentiment") == s).cast("int"), F.lit(0))) for s in ("positive", "negative")],
            cell("emoji", None, F.coalesce((F.col("emoji_count") > 0).cast("int"), F.lit(0))),
            cell("user_id", F.col("user_id"), one), cell("user_name", F.col("user_name"), one), cell("language", X.normalize_language("language"), one),
            cell("hour", F.hour("created_time"), one), cell("emotion", F.col("emotion"), one), *[cell(c, F.col(c), one) for c in _MEDIANS.values()]]
    return (d.select("post_id", "cls", "created_time", F.explode(F.array(*rows)).alias("c")).select("post_id", "cls", "created_time", "c.*")
            .groupBy("post_id", "cls", "measure", "key").agg(F.sum("n").alias("n"), F.min("created_time").alias("first"), F.max("created_time").alias("last")))


def preset_kpis(df: DataFrame, presets=PRESETS, cells: DataFrame | None = None) -> DataFrame:
    """``post_id, range`` and the columns of ``insights_kpis`` for every preset and for all comments with a time."""
    cells = cut_lineage(cells if cells is not None else kpi_cells(df, presets))
    by = ["post_id", "_to"]
    widened = F.explode(F.sequence(F.col("cls"), F.lit(len(presets)))).alias("_to")  # a class is part of its preset and all longer ones

    def total(measure: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0)).cast("long")

    wide = cells.select("*", widened)
    sums = wide.filter("key is null").groupBy(*by).agg(
        *[total(m).alias(m) for m in ("rows", "reactions", "reacted", "positive", "negative", "emoji")],
        ((F.unix_micros(F.max("last")) - F.unix_micros(F.min("first"))) / F.lit(3.6e9)).alias("span_h"))
    met = (cells.filter(F.col("measure").isin(*_DISTINCT) & F.col("key").isNotNull()).groupBy("post_id", "measure", "key").agg(F.min("cls").alias("cls"))
           .groupBy("post_id", "measure", "cls").agg(F.count(F.lit(1)).alias("n")).select("*", widened)
           .groupBy(*by).agg(*[total(m).alias(f"_{m}") for m in _DISTINCT]))
    counts = wide.filter(F.col("measure").isin("hour", "emotion") & F.col("key").isNotNull()).groupBy(*by, "measure", "key").agg(F.sum("n").alias("n"))
    modes = counts.groupBy(*by).agg(
        F.min(F.when(F.col("measure") == "hour", F.struct(-F.col("n"), F.col("key").cast("long").alias("k")))).alias("_hour"),
        F.min(F.when(F.col("measure") == "emotion", F.struct(-F.col("n"), F.col("key").alias("k")))).alias("_emotion"))
    values = wide.filter(F.col("measure").isin(*_MEDIANS.values()) & F.col("key").isNotNull()).groupBy(
        *by, F.col("measure").alias("which"), F.col("key").cast("long").alias("value")).agg(F.sum("n").alias("n"))
    medians = quantiles_of_cells(values, by, {name: (c, 0.5) for name, c in _MEDIANS.items()})
    n = F.col("rows")
    agg = sums.join(met, by, "left").join(modes, by, "left").join(medians, by, "left").select(
        *by, n.alias("total_comments"),
        F.when(F.coalesce("_user_id", F.lit(0)) == 0, F.coalesce("_user_name", F.lit(0))).otherwise(F.col("_user_id")).cast("long").alias("unique_users"),
        F.when(F.col("reacted") > 0, F.col("reactions")).alias("total_reactions"),
        F.when(F.col("reacted") > 0, F.col("reactions") / F.col("reacted")).cast("double").alias("avg_reactions_per_comment"),
        *_MEDIANS, (F.col("emoji") / n * 100).alias("emoji_pct"), F.coalesce("_language", F.lit(0)).cast("long").alias("language_diversity"), "positive", "negative",
        (n / F.greatest(F.lit(1.0), F.col("span_h"))).alias("velocity_cph"), F.col("_hour.k").alias("best_hour"), F.coalesce("_emotion.k", F.lit("neutral")).alias("top_emotion"))
    names = F.element_at(F.array(*[F.lit(p) for p in (*presets, ALL)]), F.col("_to") + 1)
    kpis = finished_kpis(agg, extra=["_to"])
    return kpis.withColumn("range", names).select("post_id", "range", *[c for c in kpis.columns if c not in ("post_id", "_to")])


# ---- distinct counts over runs of buckets (AGG2, AGG7) ----

#: Sketches have 2^LG_K registers; the standard error of an estimate is at most ``sketch_error()``.
LG_K = 12


def sketch_error(lg_k: int = LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)


def distinct_cells(df: DataFrame, bucket_seconds: int = 3600, exact: bool = False, lg_k: int = LG_K) -> DataFrame:
    """Distinct users, names and languages of each (post, bucket), in a form that merges over buckets.

    Sketches: ``post_id, bucket, user_id, user_name, language`` (binary).
    ``exact``: ``post_id, bucket, measure, key`` rows.  ``bucket`` is a start time."""
    us = F.lit(bucket_seconds * 1_000_000)
    bucket = F.timestamp_micros(F.floor(F.unix_micros("created_time") / us).cast("long") * us)
    d = df.filter(F.col("created_time").isNotNull()).select("post_id", bucket.alias("bucket"), "user_id", "user_name", X.normalize_language("language").alias("language"))
    if exact:
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("key")) for m in _DISTINCT])
        return d.select("post_id", "bucket", F.explode(pairs).alias("p")).select("post_id", "bucket", "p.*").filter("key is not null").distinct()
    return d.groupBy("post_id", "bucket").agg(*[F.hll_sketch_agg(m, lg_k).alias(m) for m in _DISTINCT])


def distinct_over(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """``post_id, window, unique_users, language_diversity`` over ``windows`` (``post_id, window, start, end``; ``end`` excluded).

    Users are counted by id, by name where a window has no ids."""
    joined = per_bucket(cells, windows)
    if "measure" in cells.columns:
        first = joined.groupBy("post_id", "window", "measure", "key").agg(F.lit(1).alias("_"))
        count = {m: F.count_if(F.col("measure") == m) for m in _DISTINCT}
        out = first.groupBy("post_id", "window").agg(*[c.alias(m) for m, c in count.items()])
    else:
        out = joined.groupBy("post_id", "window").agg(*[F.hll_sketch_estimate(F.hll_union_agg(m)).alias(m) for m in _DISTINCT])
    return out.select("post_id", "window", F.when(F.col("user_id") > 0, F.col("user_id")).otherwise(F.col("user_name")).cast("long").alias("unique_users"),
                      F.col("language").cast("long").alias("language_diversity"))


def per_bucket(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Cells beside each window of their post that holds their bucket; a post's cells are dealt to several tasks."""
    spread = windows.groupBy("post_id").agg(F.collect_list(F.struct("window", "start", "end")).alias("_w"))  # the windows asked for
    salted = cells.withColumn("cid", F.col("bucket").cast("string"))
    return (per_post(salted, spread, "inner").drop("cid").withColumn("_w", F.explode("_w"))
            .filter((F.col("bucket") >= F.col("_w.start")) & (F.col("bucket") < F.col("_w.end"))).withColumn("window", F.col("_w.window")).drop("_w"))


def last_days(cells: DataFrame, days: tuple[int, ...] = (1, 3, 7, 30)) -> DataFrame:
    """Windows of whole days up to a post's newest bucket: ``post_id, window, start, end``."""
    newest = cells.groupBy("post_id").agg(F.max("bucket").alias("_b"))
    end = F.date_trunc("day", F.col("_b")) + F.expr("interval 1 day")
    each = F.explode(F.array(*[F.lit(d) for d in days])).alias("_d")
    t = newest.select("post_id", end.alias("end"), each)
    return t.select("post_id", F.concat(F.col("_d").cast("string"), F.lit("d")).alias("window"), (F.col("end") - F.make_dt_interval(F.col("_d"))).alias("start"), "end")
