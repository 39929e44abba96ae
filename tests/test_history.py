from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillstat.operators import history as H
from quillstat.schema import KPI_SNAPSHOT_SCHEMA


def _snaps(spark, n=22):
    t0 = datetime(2024, 1, 1)
    rows = [(f"p{i % 3}", t0 + timedelta(hours=i), i + 1, float(i % 5), 100.0 - i, float(i) / 2, 50.0, float(i))
            for i in range(n)]
    return spark.createDataFrame(rows, KPI_SNAPSHOT_SCHEMA)


def test_global_row_number_dense(spark):
    df = _snaps(spark, 50)
    r = H.global_row_number(df, ["ts", "post_id"], partitions=4).orderBy("rn").collect()
    assert [x["rn"] for x in r] == list(range(1, 51))
    assert [x["ts"] for x in r] == sorted(x["ts"] for x in r)


def test_percentiles_last_20_self_counted(spark):
    s = _snaps(spark).orderBy("ts").collect()
    out = {r["rn"]: r for r in H.benchmark_percentiles(_snaps(spark)).collect()}
    for rn in (1, 5, 21, 22):
        win = s[max(0, rn - 20):rn]
        me = s[rn - 1]
        assert out[rn]["count_history"] == len(win)
        want = 100.0 * sum(1 for x in win if x["advocacy"] <= me["advocacy"]) / len(win)
        assert abs(out[rn]["pct_advocacy"] - want) < 1e-9


def test_deltas_previous_other_post(spark):
    rows = [("a", datetime(2024, 1, 1, h), v, 0.0, 0.0, 0.0, 0.0, 0.0) for h, v in ((0, 5), (1, 7))]
    rows += [("b", datetime(2024, 1, 1, 2), 10, 0.0, 0.0, 0.0, 0.0, 0.0),
             ("b", datetime(2024, 1, 1, 3), 11, 0.0, 0.0, 0.0, 0.0, 0.0)]
    d = {r["rn"]: r for r in H.kpi_deltas(spark.createDataFrame(rows, KPI_SNAPSHOT_SCHEMA)).collect()}
    assert d[1]["delta_total_comments"] == 5 and d[1]["prev_post_id"] is None  # first delta = value
    assert d[2]["delta_total_comments"] == 7  # only 'a' before it
    assert d[3]["delta_total_comments"] == 3 and d[3]["prev_post_id"] == "a"
    assert d[4]["delta_total_comments"] == 4 and d[4]["prev_post_id"] == "a"


def test_snapshot_roundtrip(spark, tmp_path):
    p = str(tmp_path / "hist")
    assert H.read_snapshots(spark, p).count() == 0
    H.append_snapshots(_snaps(spark, 5), p)
    H.append_snapshots(_snaps(spark, 3), p)
    assert H.read_snapshots(spark, p).count() == 8
    assert H.latest_per_post(H.read_snapshots(spark, p)).count() == 3
