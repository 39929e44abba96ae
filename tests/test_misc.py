import json
import os

from conftest import make_comments
from pyspark.sql import functions as F

from quillstat.functions import report as RP
from quillstat.functions import scorers as SC
from quillstat.functions.timefn import parse_timestamp
from quillstat.operators import filters as FL
from quillstat.operators import joins as J
from quillstat.operators import rankings as R
from quillstat.sources import sinks


def test_abbr(spark):
    df = spark.createDataFrame([(5,), (1000,), (1250,), (1_200_000,), (3_000_000_000,), (None,)], "n long")
    assert [r["a"] for r in df.select(RP.abbr("n").alias("a")).collect()] == ["5", "1K", "1.2K", "1.2M", "3B", "0"]


def test_parse_timestamp(spark):
    df = spark.createDataFrame([("2024-08-20T10:05:00+0000",), ("garbage",), ("",), (None,)], "t string")
    got = [r["ts"] for r in df.select(parse_timestamp(df, "t").alias("ts")).collect()]
    assert got[0] is not None and got[1:] == [None, None, None]
    n = spark.createDataFrame([(1724148300,)], "t long")
    assert n.select(F.date_format(parse_timestamp(n, "t"), "yyyy-MM-dd HH:mm").alias("x")).first()["x"] \
        == "2024-08-20 10:05"


def test_lexicon_scorers_and_top_label(spark):
    df = spark.createDataFrame([("great post, thanks",), ("this is a scam",), ("hm",)], "comment_text string")
    out = SC.lexicon_emotion(SC.lexicon_sentiment(df)).collect()
    assert [r["sentiment"] for r in out] == ["positive", "negative", "neutral"]
    assert out[0]["emotion"] in ("gratitude", "admiration") and out[2]["emotion"] == "neutral"


def test_model_scorer_plugin(spark):
    def load():
        def model(texts):
            return [[{"label": "LOW", "score": 0.2}, {"label": "HIGH", "score": 0.8}] if "!" in t
                    else [{"label": "LOW", "score": 0.9}] for t in texts]
        return model
    df = spark.createDataFrame([("wow!",), ("ok",)], "comment_text string")
    first = SC.model_scorer(load, "sentiment")(df).collect()
    assert [r["sentiment"] for r in first] == ["low", "low"]  # first label, lower-cased
    best = SC.model_scorer(load, "emotion", all_labels=True)(df).collect()
    assert [r["emotion"] for r in best] == ["high", "low"]  # arg-max over all labels


def test_script_language(spark):
    df = spark.createDataFrame([("খুব সুন্দর",), ("this is the best",), ("",)], "comment_text string")
    assert [r["language"] for r in SC.script_language(df).collect()] == ["bn", "en", ""]


def test_csv_and_report_sinks(spark, tmp_path):
    df = make_comments(spark, [{"post_id": "p", "comment_id": "a", "comment_text": "hi, \"you\"", "like_count": 1}])
    sinks.write_comments_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.first()["comment_text"] == 'hi, "you"' and "cid" in back.columns
    rep = sinks.report_rows(df.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")), top=R.top_engaged(df))
    doc = json.loads(rep.first()["report"])
    assert doc["kpis"]["n"] == 1 and doc["top"][0]["cid"] == "a"
    sinks.write_json(rep, str(tmp_path / "json"))
    assert any(f.endswith(".json") for f in os.listdir(tmp_path / "json"))


def test_posts_selection_search_order(spark):
    posts = spark.createDataFrame([("1", "Hello World", "2024-01-02T00:00:00+0000", 5, 2, 1),
                                   ("2", "other", "2024-01-03T00:00:00+0000", 1, 1, 0),
                                   ("3", None, "2024-01-01T00:00:00+0000", 0, 0, 0)],
                                  "id string, message string, created_time string, like_count long, "
                                  "comment_count long, share_count long")
    assert J.select_posts(posts, spark.createDataFrame([("1",)], "post_id string")).count() == 0
    assert J.select_posts(posts, spark.createDataFrame([("1",), ("3",)], "post_id string")).count() == 2
    assert [r["id"] for r in FL.caption_search(posts, "world").collect()] == ["1"]
    assert [r["id"] for r in R.posts_ordered(posts).collect()] == ["2", "1", "3"]


def test_handled_sets(spark):
    h = spark.createDataFrame([("p", "a")], "post_id string, cid string")
    h2 = J.mark_handled(h, "p", spark.createDataFrame([("a",), ("b",)], "cid string"))
    assert h2.count() == 2 and J.clear_handled(h2, "p").count() == 0


def test_time_window_range_anchor(spark):
    rows = [{"post_id": "p", "comment_id": f"c{i}", "comment_text": "x",
             "created_time": f"2024-01-0{d}T00:00:00+0000"} for i, d in enumerate((1, 5, 7, 8))]
    df = make_comments(spark, rows)
    assert FL.parse_range("7d") == 7 * 86400 and FL.parse_range("24h") == 86400
    assert FL.time_window(df, rng="3d").count() == 3  # anchored at the newest comment
    assert FL.time_window(df, start="2024-01-05", rng="1h").count() == 3  # range ignored with a start


def test_snippets_and_dashboard(spark):
    from quillstat.plans.composites import dashboard
    df = make_comments(spark, [{"post_id": "p", "comment_id": "a", "comment_text": "x" * 300,
                                "created_time": "2024-08-20T10:05:00+0000", "like_count": 2}])
    r = df.select(RP.snippet("comment_text").alias("s"),
                  RP.date_prefix(F.lit("2024-08-20T10:05:00+0000")).alias("d")).first()
    assert len(r["s"]) == 120 and r["d"] == "2024-08-20"
    d = dashboard(df)
    assert d["rows"].columns == ["post_id", "user_name", "comment_text", "sentiment", "emotion",
                                 "total_reactions", "engagement_score"]
    assert d["preview"].count() == 1 and d["kpis"].first()["modal_sentiment"] == "neutral"


def test_time_window_drops_rows_without_time(spark):
    rows = [{"post_id": "p", "comment_id": "a", "comment_text": "x", "created_time": "2024-01-01T00:00:00+0000"},
            {"post_id": "p", "comment_id": "b", "comment_text": "y", "created_time": None}]
    assert FL.time_window(make_comments(spark, rows)).count() == 1  # R16: even for the whole range
