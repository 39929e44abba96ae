"""Registered queries over the test tables: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query reads the whole generated tables through the ``comments_v`` adapter
and runs one operator (or one composite) of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import enrich as E
from ..operators import kpis as K
from ..operators import rankings as R
from ..sources.testdata import comments_v

Query = Callable[[SparkSession, str], DataFrame]


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.enrich(comments_v(spark, sf_dir))


def _on_enriched(fn, **kw) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(enriched(spark, sf_dir), **kw)
    q.__name__ = getattr(fn, "__name__", "query")
    return q


def queries() -> dict[str, Query]:
    from . import more_queries
    qs: dict[str, Query] = {
        # fused KPIs and counts
        "kpis": _on_enriched(K.insights_kpis),
        "top_comments_kpis": _on_enriched(K.top_comments_kpis),
        "sentiment_counts": _on_enriched(K.sentiment_counts),
        "emotion_counts": _on_enriched(K.emotion_counts),
        "language_counts": _on_enriched(K.language_counts),
        "reaction_mix": _on_enriched(K.reaction_mix),
        "hourly_sentiment": _on_enriched(K.hourly_sentiment),
        "engagement_by_sentiment": _on_enriched(K.engagement_by, col="sentiment"),
        "engagement_by_emotion": _on_enriched(K.engagement_by, col="emotion"),
        "influencers": _on_enriched(K.influencers),
        "pareto_share": _on_enriched(K.pareto_share),
        "content_intel": _on_enriched(K.content_intel),
        # ranked lists
        "top_loved": _on_enriched(R.top_loved),
        "top_haha": _on_enriched(R.top_haha),
        "top_reacted": _on_enriched(R.top_reacted),
        "top_engaged": _on_enriched(R.top_engaged),
        "examples": _on_enriched(R.examples),
        "risks": _on_enriched(R.risks),
        "reply_queue": _on_enriched(R.reply_queue),
        "question_bank": _on_enriched(R.question_bank),
        "recent_toxic": _on_enriched(R.recent_toxic),
    }
    qs.update(more_queries.queries(enriched))
    return qs
