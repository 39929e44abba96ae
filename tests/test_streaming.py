import tempfile

from pyspark.sql import functions as F

from quillstat.operators import timeseries as TS
from quillstat.operators.enrich import enrich
from quillstat.sources.testdata import comments_v
from quillstat.streaming import stream as S


def _land(spark, sf001):
    d = tempfile.mkdtemp(prefix="quillstat-stream-")
    src = comments_v(spark, sf001)
    # land the comments as four files in time order, so the stream has several inputs
    src.repartitionByRange(4, "created_time").write.mode("overwrite").parquet(d + "/in")
    return d, enrich(src)


def test_stream_equals_batch(spark, sf001):
    d, batch = _land(spark, sf001)
    st = enrich(S.comment_row_stream(spark, d + "/in", max_files_per_trigger=1))
    tl = S.run_to_end(S.timeline_counts(st, delay="1 day"), "tl_stream", d + "/ck1", mode="complete")
    want = batch.groupBy("post_id", F.date_trunc("hour", "created_time").alias("bin_start")).agg(
        F.count(F.lit(1)).alias("count"))
    assert {tuple(r) for r in tl.collect()} == {tuple(r) for r in want.collect()}
    hs = S.run_to_end(S.hourly_sentiment_counts(st, delay="1 day"), "hs_stream", d + "/ck2", mode="complete")
    assert hs.agg(F.sum("count")).first()[0] == batch.count()
    # part files are read in modification-time order, so allow a month of lateness here
    dd = S.run_to_end(S.dedupe(st, delay="60 days"), "dd_stream", d + "/ck3")
    assert dd.count() == batch.count()


def test_stream_contagion_equals_batch(spark, sf001):
    d, batch = _land(spark, sf001)
    # files in time order, one trigger for all: state carries across posts' rows
    st = enrich(S.comment_row_stream(spark, d + "/in"))
    pairs = S.run_to_end(S.contagion_pairs(st), "ct_stream", d + "/ck4")
    got = {(r["post_id"], r["prev"], r["next"]): r["s"] for r in
           pairs.groupBy("post_id", "prev", "next").agg(F.sum("pairs").alias("s")).collect()}
    want = {(r["post_id"], r["prev"], r["next"]): r["pairs"] for r in TS.contagion(batch).collect() if r["pairs"]}
    assert got == want


def test_page_stream_equals_batch(spark):
    from quillstat.sources.comments import load_comments
    d = tempfile.mkdtemp(prefix="quillstat-pages-")
    st = S.comment_page_stream(spark, "tests/fixtures/*.json", post_id="p1")
    got = S.run_to_end(st, "pages_stream", d + "/ck").drop("created_time")
    want = load_comments(spark, "tests/fixtures/page_1.json", "json", post_id="p1").drop("created_time")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dedupe_drops_redelivered_comments(spark, sf001):
    d = tempfile.mkdtemp(prefix="quillstat-dup-")
    src = comments_v(spark, sf001)
    src.write.mode("overwrite").parquet(d + "/in/a")
    src.limit(50).write.mode("overwrite").parquet(d + "/in/b")  # the same 50 comments delivered again
    st = enrich(S.comment_row_stream(spark, d + "/in/*"))
    out = S.run_to_end(S.dedupe(st, delay="60 days"), "dup_stream", d + "/ck")
    assert out.count() == src.count()
    assert out.groupBy("post_id", "comment_id").count().filter("count > 1").count() == 0
