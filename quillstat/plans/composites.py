"""The reference's entry points as bundles of DataFrames (section 2.13).

Each function returns a dict of lazy DataFrames keyed by the reference's field
names; nothing is collected.  Persist the enriched input once
(``enriched.persist()`` or a written table) when several bundles read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.report import highlights
from ..operators import filters as FL
from ..operators import history as H
from ..operators import kpis as K
from ..operators import rankings as R
from ..operators import similarity as SIM
from ..operators import text as TX
from ..operators import timeseries as TS


def compute_insights(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    kpis = K.insights_kpis(df, approx).join(TX.top_keyword(df), "post_id", "left")
    kw = TX.keyword_counts(df)
    return {
        "kpis": kpis,
        "sentiment": K.sentiment_counts(df),
        "emotions": K.emotion_counts(df),
        "languages": K.language_counts(df),
        "reactions": K.reaction_mix(df),
        "timeline": TS.daily_timeline(df),
        "hourly": K.hourly_sentiment(df),
        "keywords_all": kw.filter(F.col("scope") == "all"),
        "keywords_pos": kw.filter(F.col("scope") == "pos"),
        "keywords_neg": kw.filter(F.col("scope") == "neg"),
        "examples": R.examples(df),
        "top_loved": R.top_loved(df),
        "top_haha": R.top_haha(df),
        "top_reacted": R.top_reacted(df),
        "top_engaged": R.top_engaged(df),
        "risks": R.risks(df, approx=approx),
    }


def story_highlights(kpis: DataFrame) -> DataFrame:
    """Story view: highlight lines per post (FN13), one row per line."""
    return kpis.select("post_id", F.posexplode(highlights()).alias("line_no", "text"))


def top_comments_extras(df: DataFrame, snapshots: DataFrame | None = None,
                        approx: bool = False) -> dict[str, DataFrame]:
    groups, members = SIM.similar_groups(df)
    out = {
        "kpis": K.top_comments_kpis(df, approx),
        "top_reacted": R.top_reacted(df), "top_engaged": R.top_engaged(df),
        "top_loved": R.top_loved(df), "top_haha": R.top_haha(df),
        "reply_queue": R.reply_queue(df, approx=approx),
        "question_bank": R.question_bank(df),
        "influencers": K.influencers(df),
        "pareto": K.pareto_share(df),
        "similar_groups": groups, "similar_members": members,
    }
    if snapshots is not None:
        out["deltas"] = H.kpi_deltas(snapshots)
    return out


def time_analytics(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "timeline": TS.timeline(df), "decay": TS.decay_fit(df),
        "emotion_stack": TS.emotion_stack(df), "spikes": TS.spikes(df),
        "half_life": TS.half_life(df), "contagion": TS.contagion(df),
        "reaction_curve": TS.reaction_curve(df),
    }


def analyze_window(df: DataFrame, start=None, end=None, rng=None) -> dict[str, DataFrame]:
    """The window API: insights and time analytics recomputed inside the window."""
    w = FL.time_window(df, start, end, rng)
    out = compute_insights(w)
    out.update({f"ts_{k}": v for k, v in time_analytics(w).items()})
    return out


def content_intel(df: DataFrame) -> dict[str, DataFrame]:
    return {"top_tags": TX.hashtag_counts(df), "intel": K.content_intel(df)}


def safety_panel(df: DataFrame) -> dict[str, DataFrame]:
    return {"tox": K.content_intel(df).select("post_id", "tox_rate"),
            "tox_examples": R.recent_toxic(df), "risks": R.risks(df)}


def benchmarks(snapshots: DataFrame) -> dict[str, DataFrame]:
    return {"percentiles": H.benchmark_percentiles(snapshots)}


def dashboard_rows(df: DataFrame) -> DataFrame:
    """PRJ8: the dashboard's column subset (only the columns that exist)."""
    from ..schema import DASHBOARD_COLS
    return df.select("post_id", *[c for c in DASHBOARD_COLS if c in df.columns])


def dashboard(df: DataFrame) -> dict[str, DataFrame]:
    """Second front end: KPIs, modal sentiment / emotion (AGG14), engagement by
    sentiment and emotion (AGG22/23), top lists without the > 0 guard."""
    modal = df.groupBy("post_id").agg(F.mode("sentiment", True).alias("modal_sentiment"),
                                      F.mode("emotion", True).alias("modal_emotion"))
    return {
        "kpis": K.insights_kpis(df).join(modal, "post_id", "left"),
        "by_sentiment": K.engagement_by(df, "sentiment"),
        "by_emotion": K.engagement_by(df, "emotion"),
        "top_engaged": R.top_engaged(df),
        "top_loved": R.top_loved(df, require_positive=False),
        "top_haha": R.top_haha(df, require_positive=False),
        "rows": dashboard_rows(df),
        "preview": R.preview(dashboard_rows(df)),
    }
