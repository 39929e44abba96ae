from quillstat.operators import history as H
from quillstat.plans import composites as C


def test_every_bundle_runs(spark, sf001):
    from quillstat.plans.registry import enriched
    df = enriched(spark, sf001).cache()
    snaps = H.kpi_snapshots(df)
    bundles = {
        "insights": C.compute_insights(df),
        "extras": C.top_comments_extras(df, snaps),
        "time": C.time_analytics(df),
        "window": C.analyze_window(df, rng="7d"),
        "intel": C.content_intel(df),
        "safety": C.safety_panel(df),
        "bench": C.benchmarks(snaps),
        "dash": C.dashboard(df),
    }
    for name, bundle in bundles.items():
        for key, frame in bundle.items():
            assert frame.count() >= 0, (name, key)
    ins = bundles["insights"]
    assert ins["kpis"].count() == 4 and "top_keyword" in ins["kpis"].columns
    assert C.story_highlights(ins["kpis"]).count() >= 4 * 5
