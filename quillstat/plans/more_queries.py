"""Further registered queries (text, time, similarity, history, joins)."""

from __future__ import annotations

from ..operators import text as TX
from ..operators import timeseries as TS


def _on(enriched, fn, **kw):
    def q(spark, sf_dir):
        return fn(enriched(spark, sf_dir), **kw)
    q.__name__ = getattr(fn, "__name__", "query")
    return q


def queries(enriched):
    qs = {
        "keyword_counts": _on(enriched, TX.keyword_counts),
        "top_keyword": _on(enriched, TX.top_keyword),
        "hashtag_counts": _on(enriched, TX.hashtag_counts),
        "timeline": _on(enriched, TS.timeline),
        "daily_timeline": _on(enriched, TS.daily_timeline),
        "forecast_next_day": _on(enriched, TS.forecast_next_day),
        "emotion_stack": _on(enriched, TS.emotion_stack),
        "spikes_literal": _on(enriched, TS.spikes, mode="literal"),
        "spikes_trailing": _on(enriched, TS.spikes, mode="trailing"),
        "decay_fit": _on(enriched, TS.decay_fit),
        "decay_curve": _on(enriched, TS.decay_curve),
        "half_life": _on(enriched, TS.half_life),
        "reaction_curve": _on(enriched, TS.reaction_curve),
        "contagion": _on(enriched, TS.contagion),
    }
    from . import more_queries2
    qs.update(more_queries2.queries(enriched))
    return qs
