"""One post holding every comment: the layouts built for hot keys must give the
same answers as brute force."""

from pyspark.sql import functions as F

from quillstat.operators import similarity as SIM
from quillstat.operators import timeseries as TS
from similar_texts import leaders_of, shingles


def _hot(spark, sf001):
    from quillstat.plans.registry import enriched
    return enriched(spark, sf001).withColumn("post_id", F.lit("hot")).cache()


def test_hot_post_contagion_buckets(spark, sf001):
    df = _hot(spark, sf001)
    rows = (df.filter(F.col("created_time").isNotNull())
            .select(F.unix_micros("created_time").alias("us"), "cid", "sentiment").collect())
    rows.sort(key=lambda r: (r["us"], r["cid"]))
    want = {}
    for a, b in zip(rows, rows[1:]):
        if b["us"] - a["us"] <= 1800 * 1_000_000:
            want[(a["sentiment"], b["sentiment"])] = want.get((a["sentiment"], b["sentiment"]), 0) + 1
    got = {(r["prev"], r["next"]): r["pairs"] for r in TS.contagion(df, bucket_seconds=900).collect() if r["pairs"]}
    assert got == want


def test_hot_post_similarity_blocks(spark, sf001, monkeypatch):
    df = _hot(spark, sf001)
    items = [(r["cid"], r["comment_text"]) for r in
             SIM.similarity_items(df).orderBy("ord", "cid").select("cid", "comment_text").collect()]
    sh = [shingles(t) for _, t in items]
    want = {(items[i][0], items[j][0]) for i in range(len(items)) for j in range(i + 1, len(items))
            if len(sh[i] & sh[j]) / max(1, len(sh[i] | sh[j])) >= 0.55}
    monkeypatch.setattr(SIM, "ITEMS_PER_BLOCK", 4)  # many blocks for the single post
    got = {(r["cid_a"], r["cid_b"]) for r in SIM.similar_pairs(df).collect()}
    assert got == want
    lead = leaders_of(items)
    sizes = {}
    for l in lead.values():
        sizes[l] = sizes.get(l, 0) + 1
    groups, members = SIM.similar_groups(df, top_groups=None)
    assert {r["cid"]: r["leader"] for r in members.collect()} == {c: l for c, l in lead.items() if sizes[l] >= 2}
