import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillstat.operators import timeseries as TS
from quillstat.streaming import sink
from quillstat.streaming import stream as S

SCHEMA = "post_id string, cid string, created_time timestamp, sentiment string"
START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def comments(n, seed, hot=0.6):
    r = random.Random(seed)
    out = []
    for i in range(n):
        post = "hot" if r.random() < hot else f"p{r.randrange(3)}"
        at = START + timedelta(seconds=r.choice([r.randrange(86_400), r.randrange(48) * 1800, 3600 * r.randrange(24) + 3599]))
        out.append((post, f"c{i}", at, r.choice(["positive", "negative", "neutral"])))
    return out


def land(spark, folder, files):
    """One file a trigger, in the order given."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/f{i:03d}")


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def batch_pairs(spark, rows):
    t = spark.createDataFrame(rows, SCHEMA)
    return {(r["post_id"], r["prev"], r["next"]): r["pairs"] for r in TS.contagion(t).collect() if r["pairs"]}


def as_dict(df):
    return {(r["post_id"], r["prev"], r["next"]): r["pairs"] for r in df.collect()}


def out_of_order(rows, parts, seed):
    """Shuffled files; some rows are delivered twice, in the same file and in a later one."""
    r = random.Random(seed)
    rows = rows[:]
    r.shuffle(rows)
    files = [rows[i::parts] for i in range(parts)]
    for i in range(1, parts):
        files[i] = files[i] + r.sample(files[i - 1], 20) + r.sample(files[i], 5)
    return files


@pytest.mark.parametrize("delay", [None, "2 days"])
def test_contagion_in_any_order(spark, tmp_path, delay):
    rows = comments(600, 1)
    land(spark, tmp_path / "in", out_of_order(rows, 5, 2))
    pairs = S.contagion_pairs(stream_of(spark, tmp_path / "in"), delay=delay)
    sink.write_stream(pairs, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    table = sink.read_table(spark, f"{tmp_path}/out")
    assert table.filter("pairs < 0").count() > 0  # later files split earlier pairs
    assert as_dict(sink.totals(table, ["post_id", "prev", "next"], "pairs")) == batch_pairs(spark, rows)


def test_contagion_is_right_after_every_trigger(spark, tmp_path):
    rows = comments(200, 4)
    files = out_of_order(rows, 4, 5)
    seen = []
    for i in range(len(files)):
        land(spark, tmp_path / f"in{i}", [])
        spark.createDataFrame(files[i], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f{i:03d}")
        seen += files[i]
        # a new process each time: state comes from the checkpoint
        pairs = S.contagion_pairs(stream_of(spark, tmp_path / "in"))
        sink.write_stream(pairs, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        got = as_dict(sink.totals(sink.read_table(spark, f"{tmp_path}/out"), ["post_id", "prev", "next"], "pairs"))
        assert got == batch_pairs(spark, list(set(seen)))


def test_contagion_state_goes_with_the_watermark(spark, tmp_path):
    rows = comments(100, 6)
    later = [("tick", "t1", START + timedelta(days=30), "neutral")]
    late = [("hot", "late", START + timedelta(hours=1), "positive"), ("tick", "t2", START + timedelta(days=30, seconds=5), "neutral")]
    far = [("hot", "far", datetime(9999, 1, 1, tzinfo=timezone.utc), "positive")]
    land(spark, tmp_path / "in", [rows + far, later, later, late])
    pairs = S.contagion_pairs(stream_of(spark, tmp_path / "in"), delay="1 day", not_after="2100-01-01")
    q = sink.write_stream(pairs, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8  # the ticks' buckets and their timers
    want = batch_pairs(spark, rows + later + late[1:])
    assert as_dict(sink.totals(sink.read_table(spark, f"{tmp_path}/out"), ["post_id", "prev", "next"], "pairs")) == want


def test_bucket_narrower_than_the_gap(spark, tmp_path):
    land(spark, tmp_path / "in", [comments(5, 1)])
    with pytest.raises(ValueError):
        S.contagion_pairs(stream_of(spark, tmp_path / "in"), max_gap_seconds=1800, bucket_seconds=900)


def windows(spark, rows):
    t = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in t.groupBy("post_id", F.date_trunc("hour", "created_time").alias("bin_start")).agg(F.count(F.lit(1))).collect()}


@pytest.mark.parametrize("fail_at", [0, 1, 2])
def test_killed_and_resumed(spark, tmp_path, fail_at):
    rows = comments(300, 7)
    r = random.Random(8)
    r.shuffle(rows)
    tick = [("tick", "t", START + timedelta(days=9), "neutral")]
    land(spark, tmp_path / "in", [rows[:100], rows[100:200], rows[200:], tick])
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    plain, ran = sink.batch_writer(out), []

    def dies_after_writing(df, batch_id):
        plain(df, batch_id)
        ran.append(batch_id)
        if batch_id == fail_at:
            raise RuntimeError("killed")

    def counts():
        return S.timeline_counts(stream_of(spark, tmp_path / "in"), delay="2 days")

    with pytest.raises(StreamingQueryException):
        sink.write_stream(counts(), out, ck, write=dies_after_writing).awaitTermination()

    def again(df, batch_id):
        ran.append(batch_id)
        plain(df, batch_id)
        plain(df, batch_id)  # and a batch that is written twice changes nothing

    sink.write_stream(counts(), out, ck, write=again).awaitTermination()
    assert ran.count(fail_at) == 2
    assert [tuple(r) for r in sorted(sink.read_table(spark, out).collect())] == sorted(windows(spark, rows))


def test_hourly_sentiment_leaves_once(spark, tmp_path):
    rows = comments(200, 9)
    tick = [("tick", "t", START + timedelta(days=9), "neutral")]
    land(spark, tmp_path / "in", [rows[:90], rows[90:], tick])
    counts = S.hourly_sentiment_counts(stream_of(spark, tmp_path / "in"), delay="2 days")
    sink.write_stream(counts, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = sink.read_table(spark, f"{tmp_path}/out")
    t = spark.createDataFrame(rows, SCHEMA)
    want = t.groupBy("post_id", F.date_trunc("hour", "created_time"), "sentiment").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
