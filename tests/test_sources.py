from pyspark.sql import functions as F

from quillstat.functions.links import object_id
from quillstat.operators.joins import reaction_backfill
from quillstat.sources.comments import load_comments, read_posts


def test_ingest_json_page(spark):
    df = load_comments(spark, "tests/fixtures/page_1.json", "json", post_id="p1").orderBy("comment_id").collect()
    assert [r["comment_id"] for r in df] == ["c1", "c2", "c3"]
    assert df[0]["like_count"] == 3 and df[0]["love_count"] == 1 and df[0]["reply_count"] == 2
    assert df[1]["user_id"] == "" and df[1]["love_count"] == 0  # missing 'from' and rx_love
    assert df[2]["parent_comment_id"] == "c1" and df[2]["like_count"] == 0
    assert df[0]["created_time"] is not None and df[0]["is_verified"] is None


def test_backfill_only_zero_like_posts(spark):
    rows = [("p1", "a", 0, 0), ("p1", "b", 0, 0), ("p2", "c", 4, 1)]
    c = spark.createDataFrame(rows, "post_id string, comment_id string, like_count long, love_count long")
    for t in ("haha", "wow", "sad", "angry", "care"):
        c = c.withColumn(f"{t}_count", F.lit(0).cast("long"))
    rx = spark.createDataFrame([("a", "LIKE", 5), ("a", "LOVE", 2), ("b", "care", 1), ("c", "LIKE", 99)],
                               "comment_id string, type string, cnt long")
    out = {r["comment_id"]: r for r in reaction_backfill(c, rx).collect()}
    assert out["a"]["like_count"] == 5 and out["a"]["love_count"] == 2 and out["b"]["care_count"] == 1
    assert out["c"]["like_count"] == 4  # post with likes is left alone


def test_url_shapes(spark):
    cases = [
        ("https://www.facebook.com/reel/123", "123"),
        ("https://facebook.com/page/videos/456/", "456"),
        ("https://www.facebook.com/watch/?v=789", "789"),
        ("https://x.com/?a=1&v=42", "42"),
        ("https://facebook.com/photo.php?fbid=11&set=a", "11"),
        ("https://facebook.com/permalink.php?story_fbid=22&id=3", "22"),
        ("https://facebook.com/story.php?x=1&story_fbid=23", "23"),
        ("https://facebook.com/name/posts/33", "33"),
        ("https://facebook.com/groups/44/permalink/55", "44_55"),
        ("https://facebook.com/groups/66/posts/77", "77"),  # the generic posts shape comes first
        ("  12345_678 ", "12345_678"),
        ("https://example.com/nothing", None),
    ]
    df = spark.createDataFrame([(u,) for u, _ in cases], "url string")
    got = [r["id"] for r in df.select(object_id("url").alias("id")).collect()]
    assert got == [w for _, w in cases]


def test_posts_media_pick(spark, tmp_path):
    p = tmp_path / "posts.json"
    p.write_text('{"data": [{"id": "1", "full_picture": "f.jpg", "attachments": {"data": ['
                 '{"media_type": "video", "url": "v1", "media": {"image": {"src": "i1.jpg"}}},'
                 '{"media_type": "photo", "media": {"image": {"src": "i2.jpg"}}}]},'
                 '"reactions": {"summary": {"total_count": 5}}, "shares": {"count": 2}},'
                 '{"id": "2", "full_picture": "g.jpg"}]}')
    rows = {r["id"]: r for r in read_posts(spark, str(p)).collect()}
    assert rows["1"]["picture_url"] == "i2.jpg" and rows["1"]["video_url"] == "v1"
    assert rows["1"]["like_count"] == 5 and rows["1"]["comment_count"] == 0 and rows["1"]["share_count"] == 2
    assert rows["2"]["picture_url"] == "g.jpg" and rows["2"]["video_url"] is None


def test_post_id_from_landing_folder(spark, tmp_path):
    import shutil
    for pid in ("p7", "p9"):
        d = tmp_path / "landed" / f"post_id={pid}"
        d.mkdir(parents=True)
        shutil.copy("tests/fixtures/page_1.json", d / "page_0001.json")
    df = load_comments(spark, str(tmp_path / "landed"), "json")
    got = {(r["post_id"], r["comment_id"]) for r in df.select("post_id", "comment_id").collect()}
    assert got == {(p, c) for p in ("p7", "p9") for c in ("c1", "c2", "c3")}
