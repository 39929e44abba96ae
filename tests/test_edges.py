"""Golden values for edges: white space, ties, unusable bounds, rows without a post, plans of per-post joins."""

import json
import re

import pytest
from conftest import make_comments
from pyspark.sql import functions as F

from quillstat.functions import report, scorers
from quillstat.functions import text as X
from quillstat.functions.links import object_id
from quillstat.operators import filters as FL
from quillstat.operators import kpis as K
from quillstat.operators import rankings as R
from quillstat.sources import comments as C


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


def test_unicode_white_space(spark):
    t = "so #news　now"
    assert one(spark, t, X.hashtags) == ["#news"]
    assert one(spark, t, X.mean_word_length) == pytest.approx(10 / 3)
    assert one(spark, "a 　 b", X.normalized_for_shingles) == "a b"
    assert one(spark, "see www.a.example/b after", X.word_count) == 2
    assert one(spark, " 123_45 ", object_id) == "123_45"
    assert one(spark, "\x1cab\x1f", X.whitespace_words) == ["ab"]


@pytest.mark.parametrize("n,text", [(999, "999"), (1000, "1K"), (1050, "1.1K"), (1150, "1.1K"), (1250, "1.2K"), (1350, "1.4K"), (999_950, "1000K"),
                                    (1_050_000, "1.1M"), (2_500_000_000, "2.5B"), (0, "0"), (-5, "-5")])
def test_abbreviations_round_the_double(spark, n, text):
    if n >= 1000:  # the definition: one decimal of the binary quotient
        div, suffix = next((d, s) for d, s in ((1e9, "B"), (1e6, "M"), (1e3, "K")) if n >= d)
        assert f"{n / div:.1f}".removesuffix(".0") + suffix == text
    assert one(spark, n, report.abbr, "long") == text


@pytest.fixture
def rows(spark):
    return make_comments(spark, [{"post_id": "p", "comment_id": f"c{i}", "comment_text": "text of it", "like_count": i % 5, "sentiment": "negative",
                                  "created_time": f"2024-01-0{1 + i}T00:00:00+0000"} for i in range(6)])


def test_unusable_bounds_count_as_absent(rows):
    def days(**kw):
        return sorted(r["cid"] for r in FL.time_window(rows, **kw).collect())
    assert days(start="garbage") == days(start="") == days() == [f"c{i}" for i in range(6)]
    assert days(start="garbage", rng="1d") == ["c4", "c5"]
    assert days(start="2024-01-03", end="nothing", rng="1d") == ["c2", "c3", "c4", "c5"]


def test_rows_without_a_post_are_an_error(spark, tmp_path):
    page = {"data": [{"id": "1", "message": "this is the one", "created_time": "2024-01-01T00:00:00+0000"},
                     {"id": "2", "message": "reply", "parent": {"id": "1"}, "created_time": "2024-01-01T00:00:01+0000"},
                     {"id": "3", "message": "সুন্দর", "created_time": "2024-01-01T00:00:02+0000"}]}
    (tmp_path / "a.json").write_text(json.dumps(page))
    with pytest.raises(ValueError):
        C.read_comment_pages(spark, str(tmp_path))
    got = C.read_comment_pages(spark, str(tmp_path), post_id="p").orderBy("comment_id").collect()
    assert [r["language"] for r in got] == ["en", "", "bn"]
    assert [r["comment_id"] for r in C.read_comment_pages(spark, str(tmp_path), post_id="p", toplevel=True).orderBy("comment_id").collect()] == ["1", "3"]
    spark.createDataFrame([("1", "p"), ("2", None)], "comment_id string, post_id string").write.parquet(f"{tmp_path}/t")
    with pytest.raises(Exception, match="no post_id"):
        C.load_comments(spark, f"{tmp_path}/t").collect()
    assert {r["post_id"] for r in C.load_comments(spark, f"{tmp_path}/t", post_id="q").collect()} == {"p", "q"}


def test_csv_is_split_unless_told(spark, tmp_path):
    (tmp_path / "c.csv").write_text('post_id,comment_id,comment_text\np,1,"two\nlines"\n')
    assert C.load_comments(spark, str(tmp_path / "c.csv"), "csv", multi_line=True).first()["comment_text"] == "two\nlines"


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path)

    def load():
        import uuid
        open(f"{log}/{uuid.uuid4().hex}", "w").close()
        return lambda texts: [{"label": "POS", "score": 1.0} for _ in texts]
    scorers._MODELS.clear()
    calls = [scorers._loaded("k", load) for _ in range(3)]
    assert len(list(tmp_path.iterdir())) == 1 and calls[0] is calls[2]


@pytest.mark.parametrize("query", [lambda d: FL.time_window(d, rng="1d"), FL.high_engagement, R.risks, K.top_comments_kpis])
def test_no_post_is_gathered_whole(spark, rows, query):
    """With broadcasts off, comment rows never go to one task per post."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = query(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(post_id#\d+, \d+\)", line):
            below = next(x for x in lines[i + 1:] if x.strip(" :+-*()0123456789"))
            assert re.search(r"Aggregate|WindowGroupLimit|Filter \(rank|Project|Sort|Window", below), below
            assert "comment_text" not in line


def test_risks_with_thresholds(rows):
    got = [(r["cid"], r["rank"]) for r in R.risks(rows).collect()]
    eng = sorted([0, 1, 2, 3, 4, 0])
    p75 = eng[3] + 0.75 * (eng[4] - eng[3])
    assert got == [("c4", 1), ("c3", 2)] and 3 >= p75 > 2
