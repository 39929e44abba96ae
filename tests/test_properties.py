from pyspark.sql import functions as F

from quillstat.operators import kpis as K
from quillstat.operators import rankings as R
from quillstat.operators import similarity as SIM
from quillstat.operators import text as TX
from quillstat.operators import timeseries as TS


def _df(spark, sf001):
    from quillstat.plans.registry import enriched
    return enriched(spark, sf001)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_timeline_sums_to_timed_rows(spark, sf001):
    df = _df(spark, sf001)
    s = TS.timeline(df).groupBy("post_id").agg(F.sum("count").alias("s"))
    t = df.filter(F.col("created_time").isNotNull()).groupBy("post_id").agg(F.count(F.lit(1)).alias("t"))
    assert s.join(t, "post_id").filter(F.col("s") != F.col("t")).count() == 0


def test_jaccard_bounds(spark, sf001):
    p = SIM.similar_pairs(_df(spark, sf001))
    bad = p.filter((F.col("jaccard") < 0.55) | (F.col("jaccard") > 1) | (F.col("cid_a") == F.col("cid_b")))
    assert bad.count() == 0


def test_row_order_invariance(spark, sf001):
    df = _df(spark, sf001)
    shuffled = df.orderBy(F.rand(7)).repartition(5)
    for op in (K.insights_kpis, R.top_engaged, TX.keyword_counts, TS.contagion, K.influencers):
        assert _rows(op(df)) == _rows(op(shuffled)), op.__name__


def test_approx_mode_close(spark, sf001):
    df = _df(spark, sf001)
    a = {r["post_id"]: r for r in K.insights_kpis(df).collect()}
    b = {r["post_id"]: r for r in K.insights_kpis(df, approx=True).collect()}
    for p in a:
        assert abs(a[p]["unique_users"] - b[p]["unique_users"]) <= 0.1 * a[p]["unique_users"] + 1


def test_approx_thresholds_run(spark, sf001):
    from quillstat.operators import rankings as RR
    df = _df(spark, sf001)
    exact = {r["post_id"]: r for r in K.top_comments_kpis(df).collect()}
    approx = {r["post_id"]: r for r in K.top_comments_kpis(df, approx=True).collect()}
    assert set(exact) == set(approx)
    for p in exact:
        assert exact[p]["total"] == approx[p]["total"] and exact[p]["questions"] == approx[p]["questions"]
    assert RR.risks(df, approx=True).count() >= 0
