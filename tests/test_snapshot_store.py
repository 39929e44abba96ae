from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstat.operators.snapshot_store import SnapshotStore
from quillstat.schema import KPI_SNAPSHOT_SCHEMA

T0 = datetime(2024, 1, 1)


def snaps(spark, posts, hours, value=1):
    rows = [(f"p{p}", T0 + timedelta(hours=h), value, float(p), float(h), 1.0, 2.0, 3.0) for p in posts for h in hours]
    return spark.createDataFrame(rows, KPI_SNAPSHOT_SCHEMA)


def content(df):
    return sorted((r["post_id"], r["ts"], r["total_comments"]) for r in df.collect())


def test_upsert_replaces_keys_and_keeps_the_rest(spark, tmp_path):
    s = SnapshotStore(spark, f"{tmp_path}/h", buckets=8)
    assert s.read().count() == 0 and s.latest().count() == 0
    s.upsert(snaps(spark, range(20), range(3)))
    s.upsert(snaps(spark, [3, 40], [2, 5], value=9))
    want = {(f"p{p}", T0 + timedelta(hours=h)): 1 for p in range(20) for h in range(3)}
    want |= {(f"p{p}", T0 + timedelta(hours=h)): 9 for p in (3, 40) for h in (2, 5)}
    assert content(SnapshotStore(spark, f"{tmp_path}/h").read()) == sorted((*k, v) for k, v in want.items())
    s.upsert(snaps(spark, [3, 40], [2, 5], value=9))  # the same again
    assert content(s.read()) == sorted((*k, v) for k, v in want.items())
    assert {r["post_id"]: r["ts"] for r in s.latest(["p3", "p4"]).collect()} == {"p3": T0 + timedelta(hours=5), "p4": T0 + timedelta(hours=2)}


def test_only_touched_buckets_are_written_and_read(spark, tmp_path):
    s = SnapshotStore(spark, f"{tmp_path}/h", buckets=8)
    s.upsert(snaps(spark, range(40), range(2)))
    before = {r["bucket"]: r["generation"] for r in s._published()}
    touched = s.upsert(snaps(spark, [1], [7]))
    after = {r["bucket"]: r["generation"] for r in s._published()}
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == touched
    one = s.read(["p1"])
    assert one.count() == 3 and len({f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    assert len(s.unused()) == 1 and f"bucket={touched.pop()}" in s.unused()[0]


def test_a_write_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    s = SnapshotStore(spark, f"{tmp_path}/h", buckets=4)
    s.upsert(snaps(spark, range(9), range(2)))
    before = content(s.read())
    real = type(spark).createDataFrame

    def dies(self, rows, *a, **k):
        if a and "generation" in str(a[0]):
            raise RuntimeError("killed before the state was published")
        return real(self, rows, *a, **k)

    new = snaps(spark, range(9), [5], value=7)
    monkeypatch.setattr(type(spark), "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        s.upsert(new)
    assert content(s.read()) == before
    monkeypatch.undo()
    s.upsert(new)
    assert len(content(s.read())) == len(before) + 9


def test_one_hot_post_and_repeated_keys(spark, tmp_path):
    s = SnapshotStore(spark, f"{tmp_path}/h", buckets=4)
    hot = snaps(spark, [0], range(500)).unionByName(snaps(spark, [0], range(500), value=2))
    s.upsert(hot)
    assert content(s.read()) == sorted(("p0", T0 + timedelta(hours=h), 2) for h in range(500))


def test_more_columns(spark, tmp_path):
    """Sketches of distinct users beside the KPIs, merged over stored snapshots."""
    from pyspark.sql import types as T
    schema = T.StructType([*KPI_SNAPSHOT_SCHEMA.fields, T.StructField("users", T.BinaryType())])
    base = spark.range(4000).select((F.col("id") % 2).alias("p"), (F.col("id") % 10).alias("h"), F.concat(F.lit("u"), F.col("id") % 700).alias("u"))
    rows = base.groupBy("p", "h").agg(F.hll_sketch_agg("u", 12).alias("users")).select(
        F.concat(F.lit("p"), "p").alias("post_id"), F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit(1).alias("total_comments"),
        *[F.lit(0.0).alias(c) for c in ("advocacy", "safety_score", "avg_reactions_per_comment", "positivity_ratio", "median_engagement")], "users")
    s = SnapshotStore(spark, f"{tmp_path}/h", schema, buckets=4)
    s.upsert(rows)
    got = {r["post_id"]: r["n"] for r in s.read().groupBy("post_id").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("n")).collect()}
    assert all(abs(n - 350) < 25 for n in got.values()) and len(got) == 2
