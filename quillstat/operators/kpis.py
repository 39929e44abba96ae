"""Per-post aggregates (AGG1-AGG31).

One ``groupBy('post_id').agg(...)`` computes the fused KPI row; Catalyst plans
a partial (map-side) + final hash aggregate, so a hot post is pre-aggregated
on every mapper before the shuffle.  Thresholds that need a per-post value
first (p75) are aggregated, then joined back on ``post_id``; the joined side
is one row per post and AQE turns it into a broadcast when it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import REACTION_COLS
from ..session import cut_lineage
from .perpost import per_post
from .quantiles import exact_quantiles, quantiles_of_cells


def _with_quantiles(df: DataFrame, agg: DataFrame | None, quantiles: dict[str, tuple[str, float]], approx: bool) -> DataFrame:
    """Per-post quantiles of comment columns, beside the per-post rows ``agg``: exact by selection, or estimates."""
    if approx:
        q = df.groupBy("post_id").agg(*[F.percentile_approx(F.col(c).cast("double"), p, 10000).cast("double").alias(n) for n, (c, p) in quantiles.items()])
    else:
        q = exact_quantiles(df, ["post_id"], quantiles)
    return q if agg is None else agg.join(q, "post_id", "left")


def _distinct(c: Column, approx: bool) -> Column:
    return (F.approx_count_distinct(c) if approx else F.count_distinct(c)).cast("long")


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def insights_kpis(df: DataFrame, approx: bool = False) -> DataFrame:
    """AGG1-AGG13, AGG20-AGG21 as one row per post (unrounded, ruling R3).

    Columns: total_comments, unique_users, total_reactions,
    avg_reactions_per_comment, median_reactions, median_engagement, emoji_pct,
    language_diversity, positive, negative, neutral, positivity_ratio,
    safety_score, advocacy, best_hour, velocity_cph, top_emotion.
    """
    n = F.count(F.lit(1)).cast("long")
    pos = count_if(F.col("sentiment") == "positive")
    neg = count_if(F.col("sentiment") == "negative")
    span_h = (F.unix_micros(F.max("created_time")) - F.unix_micros(F.min("created_time"))) / F.lit(3.6e9)
    hours = F.coalesce(F.greatest(F.lit(1.0), span_h), F.lit(1.0))
    agg = df.groupBy("post_id").agg(
        n.alias("total_comments"),
        # AGG2: user ids; a post whose source has no user ids falls back to names
        F.when(F.count("user_id") == 0, _distinct(F.col("user_name"), approx))
        .otherwise(_distinct(F.col("user_id"), approx)).alias("unique_users"),
        F.sum("total_reactions").cast("long").alias("total_reactions"),
        F.avg("total_reactions").cast("double").alias("avg_reactions_per_comment"),
        (F.avg((F.col("emoji_count") > 0).cast("double")) * 100).alias("emoji_pct"),
        _distinct(X.normalize_language("language"), approx).alias("language_diversity"),
        pos.alias("positive"),
        neg.alias("negative"),
        (n / hours).alias("velocity_cph"),
        F.mode(F.hour("created_time"), True).cast("long").alias("best_hour"),
        F.coalesce(F.mode("emotion", True), F.lit("neutral")).alias("top_emotion"),
    )
    agg = _with_quantiles(df, agg, {"median_reactions": ("total_reactions", 0.5), "median_engagement": ("engagement_score", 0.5)}, approx)
    return finished_kpis(agg)


def finished_kpis(agg: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The KPI row from its aggregates: shares and ratios (AGG8-AGG13)."""
    tot = F.col("total_comments")
    return agg.select(
        "post_id", *(extra or []), "total_comments", "unique_users", "total_reactions",
        "avg_reactions_per_comment", "median_reactions", "median_engagement", "emoji_pct",
        "language_diversity", "positive", "negative",
        F.greatest(tot - F.col("positive") - F.col("negative"), F.lit(0)).cast("long").alias("neutral"),
        (F.col("positive") * 100.0 / F.greatest(F.lit(1), F.col("positive") + F.col("negative")))
        .alias("positivity_ratio"),
        F.greatest(F.lit(0.0), 100.0 - F.col("negative") * 100.0 / F.greatest(F.lit(1), tot))
        .alias("safety_score"),
        (F.col("positive") * 100.0 / F.greatest(F.lit(1), tot)).alias("advocacy"),
        "best_hour", "velocity_cph", "top_emotion",
    )


THRESHOLDS = {"high_engagement": ("engagement_score", 0.75), "median_engagement": ("engagement_score", 0.5)}


def engagement_thresholds(df: DataFrame, approx: bool = False) -> DataFrame:
    """AGG4/AGG5: per-post p75 and median of engagement."""
    return _with_quantiles(df, None, THRESHOLDS, approx)


def with_thresholds(df: DataFrame, approx: bool = False) -> DataFrame:
    """Attach per-post thresholds to every comment (join on post_id, no window)."""
    return per_post(df, engagement_thresholds(df, approx))


def top_comments_kpis(df: DataFrame, approx: bool = False) -> DataFrame:
    """Top-comments KPI set: total, avg reactions, positivity (polar), negatives,
    questions (AGG26), high_eng (>= p75, FLT8), unanswered (FLT10), reply
    coverage of questions (AGG27), p75 and median thresholds."""
    # One row per post and engagement value: thresholds and every count come from that
    # histogram, so no comment is joined.
    q = X.is_question("comment_text")
    hist = df.groupBy("post_id", "engagement_score").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum("total_reactions").alias("reacts"), F.count("total_reactions").alias("reacted"),
        count_if(F.col("sentiment") == "positive").alias("pos"), count_if(F.col("sentiment") == "negative").alias("neg"),
        count_if(q).alias("q"), count_if(q & (F.col("reply_count") > 0)).alias("answered"),
        count_if(F.coalesce(F.col("reply_count"), F.lit(0)) <= 0).alias("open"))

    if not approx:
        hist = cut_lineage(hist)
    thr = (engagement_thresholds(df, True) if approx else quantiles_of_cells(
        hist.select("post_id", F.lit("engagement_score").alias("which"), F.col("engagement_score").alias("value"), "n").filter("value is not null"),
        ["post_id"], THRESHOLDS))
    total = lambda c: F.sum(c).cast("long")
    return per_post(hist, thr, salt_by="engagement_score").groupBy("post_id").agg(
        total("n").alias("total"),
        (F.sum("reacts") / F.sum("reacted")).cast("double").alias("avg_reacts"),
        (total("pos") * 100.0 / F.greatest(F.lit(1), total("pos") + total("neg"))).alias("positivity"),
        total("neg").alias("negatives"),
        total("q").alias("questions"),
        F.coalesce(total(F.when(F.col("engagement_score") >= F.col("high_engagement"), F.col("n"))), F.lit(0)).alias("high_eng"),
        total("open").alias("unanswered"),
        F.when(total("q") > 0, total("answered") * 100.0 / total("q")).alias("reply_coverage_questions_pct"),
        F.first("high_engagement").alias("high_engagement"),
        F.first("median_engagement").alias("median_engagement"),
    )


def sentiment_counts(df: DataFrame) -> DataFrame:
    """AGG8 as tidy rows: (post_id, label, value) for Positive/Negative/Neutral."""
    k = insights_kpis(df)
    return k.select("post_id", F.explode(F.array(
        F.struct(F.lit("Positive").alias("label"), F.col("positive").alias("value")),
        F.struct(F.lit("Negative").alias("label"), F.col("negative").alias("value")),
        F.struct(F.lit("Neutral").alias("label"), F.col("neutral").alias("value")))).alias("s")
    ).select("post_id", "s.label", "s.value")


def label_counts(df: DataFrame, col: Column | str, k: int | None, name: str = "label") -> DataFrame:
    """AGG15/AGG16: counts per label, ranked (count desc, label asc), top k."""
    from .rankings import top_k
    c = F.col(col) if isinstance(col, str) else col
    counts = df.groupBy("post_id", c.alias(name)).agg(F.count(F.lit(1)).cast("long").alias("value"))
    return top_k(counts, [F.col("value").desc(), F.col(name).asc_nulls_last()], k)


def emotion_counts(df: DataFrame, k: int = 7) -> DataFrame:
    return label_counts(df.filter(F.col("emotion").isNotNull()), "emotion", k)


def language_counts(df: DataFrame, k: int = 6) -> DataFrame:
    return label_counts(df, X.normalize_language("language"), k)


def reaction_mix(df: DataFrame) -> DataFrame:
    """AGG17: total of each reaction type per post, label upper-cased."""
    sums = df.groupBy("post_id").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
                                       for c in REACTION_COLS])
    return sums.select("post_id", F.explode(F.array(*[
        F.struct(F.lit(c.replace("_count", "").upper()).alias("label"), F.col(c).alias("value"))
        for c in REACTION_COLS])).alias("r")).select("post_id", "r.label", "r.value")


def hourly_sentiment(df: DataFrame) -> DataFrame:
    """AGG18/AGG19 + JN7: 24 rows per post (hours 0..23, zero-filled) with
    pos / neg / neu and total (rows with a timestamp)."""
    h = df.filter(F.col("created_time").isNotNull()).groupBy(
        "post_id", F.hour("created_time").cast("long").alias("hour")).agg(
        count_if(F.col("sentiment") == "positive").alias("pos"),
        count_if(F.col("sentiment") == "negative").alias("neg"),
        F.count(F.lit(1)).cast("long").alias("total"))
    spine = df.select("post_id").distinct().select(
        "post_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    out = spine.join(h, ["post_id", "hour"], "left").fillna(0, ["pos", "neg", "total"])
    return out.select("post_id", "hour", "pos", "neg",
                      (F.col("total") - F.col("pos") - F.col("neg")).alias("neu"), "total")


def engagement_by(df: DataFrame, col: str) -> DataFrame:
    """AGG22/AGG23: total engagement per sentiment / emotion (rank = desc)."""
    from .rankings import top_k
    s = df.groupBy("post_id", col).agg(F.sum("engagement_score").cast("long").alias("engagement"))
    return top_k(s, [F.col("engagement").desc(), F.col(col).asc_nulls_last()], None)


def influencers(df: DataFrame, k: int = 8) -> DataFrame:
    """AGG24/TOP10: per user name: comments (non-null text), mean reactions,
    total engagement; ranked by (total engagement, comments) desc; null names dropped."""
    from .rankings import top_k
    g = df.filter(F.col("user_name").isNotNull()).groupBy("post_id", "user_name").agg(
        F.count("comment_text").cast("long").alias("comments"),
        F.avg("total_reactions").cast("double").alias("avg_reacts"),
        F.sum("engagement_score").cast("long").alias("eng"))
    return top_k(g, [F.col("eng").desc(), F.col("comments").desc(), F.col("user_name").asc()], k)


def pareto_share(df: DataFrame, k: int = 10) -> DataFrame:
    """AGG25: share of engagement held by the top-k comments, in percent."""
    from .rankings import top_k
    top = top_k(df.select("post_id", "cid", "engagement_score"),
                [F.col("engagement_score").desc(), F.col("cid").asc()], k)
    t = top.groupBy("post_id").agg(F.sum("engagement_score").cast("double").alias("top"))
    a = df.groupBy("post_id").agg(F.sum("engagement_score").cast("double").alias("tot"))
    return a.join(t, "post_id", "left").select(
        "post_id", (100.0 * F.coalesce(F.col("top"), F.lit(0.0)) / F.greatest(F.lit(1.0), F.col("tot")))
        .alias("pareto_top10_pct"))


def content_intel(df: DataFrame, word_boundary: bool = False) -> DataFrame:
    """AGG29-AGG31: CTA hits, readability, toxic rate per post."""
    return df.groupBy("post_id").agg(
        count_if(X.cta_hit("comment_text", word_boundary)).alias("cta_hits"),
        F.avg(X.mean_word_length("comment_text")).cast("double").alias("readability"),
        (100.0 * F.avg(X.toxic_hit("comment_text", word_boundary).cast("double"))).alias("tox_rate"),
    )


def data_quality(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """AGG38 (re-aimed): measured null rates, newest comment and its age, coverage."""
    as_of = as_of if as_of is not None else F.current_timestamp()
    n = F.count(F.lit(1))
    return df.groupBy("post_id").agg(
        n.cast("long").alias("rows"),
        (100.0 * F.count("comment_text") / n).alias("text_coverage_pct"),
        (100.0 * F.count("created_time") / n).alias("ts_coverage_pct"),
        (100.0 * F.count("user_id") / n).alias("user_coverage_pct"),
        F.max("created_time").alias("newest_comment"),
        ((F.unix_micros(as_of) - F.unix_micros(F.max("created_time"))) / F.lit(3.6e9)).alias("age_hours"),
    )
