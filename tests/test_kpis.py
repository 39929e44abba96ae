from conftest import make_comments
from pyspark.sql import functions as F

from quillstat.operators import kpis as K
from quillstat.operators import rankings as R


def test_demo_csv_kpis(spark):
    from quillstat.operators.enrich import enrich
    from quillstat.sources.comments import load_comments
    df = enrich(load_comments(spark, "tests/fixtures/demo_comments.csv", "csv", post_id="demo"))
    k = K.insights_kpis(df).first()
    assert k["total_comments"] == 3 and k["unique_users"] == 3
    assert k["total_reactions"] == 5 + 2 + 3
    assert k["best_hour"] == 10
    langs = {r["label"]: r["value"] for r in K.language_counts(df).collect()}
    assert langs == {"bangla": 2, "english": 1}


def test_ties_are_broken_by_cid(spark):
    rows = [{"post_id": "p", "comment_id": f"c{i}", "user_name": "u", "comment_text": "x",
             "like_count": 5, "love_count": 1} for i in (3, 1, 2, 6, 5, 4)]
    df = make_comments(spark, rows)
    top = [r["cid"] for r in R.top_engaged(df, 3).orderBy("rank").collect()]
    assert top == ["c1", "c2", "c3"]


def test_nulls(spark):
    rows = [{"post_id": "p", "comment_id": "a", "user_id": None, "user_name": "", "comment_text": None,
             "created_time": None, "like_count": None, "reply_count": None, "language": ""},
            {"post_id": "p", "comment_id": "b", "user_id": "u", "user_name": None, "comment_text": "Hello there",
             "created_time": "2024-01-01T00:00:00+0000", "like_count": 2, "reply_count": 1, "language": None}]
    df = make_comments(spark, rows)
    k = K.insights_kpis(df).first()
    assert k["total_comments"] == 2 and k["unique_users"] == 1 and k["total_reactions"] == 2
    assert k["language_diversity"] == 2  # '' and 'unknown'
    inf = K.influencers(df).collect()
    assert [r["user_name"] for r in inf] == [""]  # null name dropped, '' kept


def test_sentiment_counts_sum_to_total(spark, sf001):
    from quillstat.plans.registry import enriched
    df = enriched(spark, sf001)
    s = K.sentiment_counts(df).groupBy("post_id").agg(F.sum("value").alias("s"))
    t = K.insights_kpis(df).select("post_id", "total_comments")
    assert s.join(t, "post_id").filter(F.col("s") != F.col("total_comments")).count() == 0


def test_unique_users_falls_back_to_names(spark):
    rows = [{"post_id": "p", "comment_id": str(i), "user_name": n, "comment_text": "x"} for i, n in
            enumerate(["ann", "bob", "ann"])]
    assert K.insights_kpis(make_comments(spark, rows)).first()["unique_users"] == 2


def test_blank_as_null_option(spark):
    from quillstat.operators.enrich import enrich
    from quillstat.sources.comments import conform
    rows = [("p", "a", "", "", "x", ""), ("p", "b", "u", "U", "y", "en")]
    df = conform(spark.createDataFrame(rows, "post_id string, comment_id string, user_id string, "
                                             "user_name string, comment_text string, language string"))
    keep = K.insights_kpis(enrich(df)).first()
    drop = K.insights_kpis(enrich(df, blank_as_null=True)).first()
    assert (keep["unique_users"], keep["language_diversity"]) == (2, 2)
    assert (drop["unique_users"], drop["language_diversity"]) == (1, 2)  # '' language -> 'unknown'


def test_reply_coverage_null_without_questions_and_pareto(spark):
    rows = [{"post_id": "p", "comment_id": f"c{i:02d}", "comment_text": "fine", "like_count": v}
            for i, v in enumerate([50, 30] + [1] * 10)]
    df = make_comments(spark, rows)
    k = K.top_comments_kpis(df).first()
    assert k["questions"] == 0 and k["reply_coverage_questions_pct"] is None
    p = K.pareto_share(df).first()["pareto_top10_pct"]
    assert abs(p - 100.0 * (50 + 30 + 8) / 90) < 1e-9


def test_emotion_stack_labels_short_for_15_minute_bins(spark):
    from datetime import datetime, timedelta
    from quillstat.operators import timeseries as TS
    t0 = datetime(2024, 1, 1, 9, 0)
    rows = [{"post_id": "p", "comment_id": f"c{i}", "comment_text": "x", "emotion": "joy",
             "created_time": (t0 + timedelta(minutes=20 * i)).strftime("%Y-%m-%dT%H:%M:%S+0000")} for i in range(3)]
    labels = sorted(r["t"] for r in TS.emotion_stack(make_comments(spark, rows)).collect())
    assert labels == ["09:00", "09:15", "09:30"]
