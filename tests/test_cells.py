import pytest
from conftest import make_comments
from pyspark.sql import functions as F

from quillstat.operators import cells as C
from quillstat.operators import filters as FL
from quillstat.operators import kpis as K


def comments(spark):
    rows = []
    for i in range(160):
        day, hour = divmod(i * i % 900, 24)
        rows.append({"post_id": f"p{i % 3}", "comment_id": f"c{i}", "user_id": None if i % 3 == 2 else f"u{i * 7 % 31}", "user_name": f"n{i % 17}", "comment_text": "ok 🙌" if i % 4 else "plain",
                     "created_time": None if i % 23 == 0 else f"2024-01-{day % 28 + 1:02d}T{hour:02d}:{i % 60:02d}:00+0000", "like_count": i % 9, "language": ["en", "bn", "English", None][i % 4]})
    # exactly on the bounds of 3h and 24h, and a lone post
    rows += [{"post_id": "edge", "comment_id": f"e{h}", "user_name": f"n{h}", "comment_text": "x", "created_time": f"2024-02-0{2 - (h >= 24)}T{(24 - h) % 24:02d}:00:00+0000", "like_count": h}
             for h in (0, 3, 6, 12, 24)][:0]
    for cid, t in (("e0", "2024-02-02T12:00:00"), ("e1", "2024-02-02T09:00:00"), ("e2", "2024-02-02T08:59:59"), ("e3", "2024-02-01T12:00:00"), ("e4", "2023-01-01T00:00:00")):
        rows.append({"post_id": "edge", "comment_id": cid, "user_name": cid, "comment_text": "x", "created_time": t + "+0000", "like_count": 1})
    rows.append({"post_id": "none", "comment_id": "z", "user_name": "z", "comment_text": "x", "created_time": None, "like_count": 1})
    s = F.when(F.crc32("cid") % 3 == 0, "positive").when(F.crc32("cid") % 3 == 1, "negative").otherwise("neutral")
    return make_comments(spark, rows).withColumn("sentiment", s).withColumn("emotion", F.when(F.crc32("cid") % 5 > 0, F.concat(F.lit("m"), (F.crc32("cid") % 4).cast("string"))))


def plain(rows):
    return {r["post_id"]: {k: (round(v, 9) if isinstance(v, float) else v) for k, v in r.asDict().items() if k not in ("range", "post_id")} for r in rows}


def test_every_preset_equals_its_window_alone(spark):
    df = comments(spark).cache()
    got = C.preset_kpis(df).collect()
    for preset in (*C.PRESETS, C.ALL):
        alone = K.insights_kpis(FL.time_window(df, rng=preset)).collect()
        assert plain(r for r in got if r["range"] == preset) == plain(alone), preset
    edge = {r["range"]: r["total_comments"] for r in got if r["post_id"] == "edge"}
    assert (edge["3h"], edge["6h"], edge["24h"], edge["all"]) == (2, 3, 4, 5)


def test_one_scan(spark, sf001):
    from quillstat.plans.registry import enriched
    plan = C.kpi_cells(enriched(spark, sf001))._jdf.queryExecution().executedPlan().toString()
    # the measures, and the salts of the newest times: comments are exploded once
    assert plan.count("Generate explode") == 2


def test_own_presets(spark):
    df = comments(spark)
    got = C.preset_kpis(df, ("1h", "2d"))
    assert {r["range"] for r in got.select("range").distinct().collect()} == {"1h", "2d", "all"}
    with pytest.raises(ValueError):
        C.preset_kpis(df, ("2d", "1h"))


def test_distinct_counts_merge(spark):
    n = 60_000
    base = spark.range(n).select(
        F.when(F.col("id") % 10 < 3, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 3)).alias("post_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37 % (86_400 * 40)).alias("created_time"),
        F.concat(F.lit("u"), F.col("id") * 7919 % 20_011).alias("user_id"), F.lit("x").alias("user_name"), F.concat(F.lit("l"), F.col("id") % 9).alias("language"))
    exact = C.distinct_cells(base, exact=True)
    windows = C.last_days(exact)
    want = {(r["post_id"], r["window"]): r for r in C.distinct_over(exact, windows).collect()}
    # exact cells are the distinct counts of the raw rows
    w = {(r["post_id"], r["window"]): r for r in windows.collect()}
    raw = {k: base.filter((F.col("post_id") == k[0]) & (F.col("created_time") >= F.lit(x["start"])) & (F.col("created_time") < F.lit(x["end"]))).agg(F.count_distinct("user_id")).first()[0]
           for k, x in list(w.items())[:4]}
    assert all(want[k]["unique_users"] == v for k, v in raw.items())
    got = {(r["post_id"], r["window"]): r for r in C.distinct_over(C.distinct_cells(base), windows).collect()}
    assert got.keys() == want.keys() and len(got) == 16
    for k, r in got.items():
        assert abs(r["unique_users"] - want[k]["unique_users"]) <= 4 * C.sketch_error() * want[k]["unique_users"] + 1
        assert r["language_diversity"] == want[k]["language_diversity"] == 9
    # merged days equal one bucket over everything
    one = C.distinct_cells(base, 86_400 * 365 * 60)
    w1 = one.select("post_id", F.lit("w").alias("window"), F.col("bucket").alias("start"), (F.col("bucket") + F.expr("interval 1 second")).alias("end"))
    a = {r["post_id"]: r["unique_users"] for r in C.distinct_over(one, w1).collect()}
    b = {k[0]: r["unique_users"] for k, r in got.items() if k[1] == "30d"}
    assert a.keys() == b.keys()


def test_names_where_a_window_has_no_ids(spark):
    df = comments(spark)
    cells = C.distinct_cells(df)
    got = {(r["post_id"], r["window"]): r["unique_users"] for r in C.distinct_over(cells, C.last_days(cells, (3650,))).collect()}
    assert got["edge", "3650d"] == 5 and got["p2", "3650d"] == 17
