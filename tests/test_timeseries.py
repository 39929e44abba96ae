from datetime import datetime, timedelta

from conftest import make_comments

from quillstat.operators import timeseries as TS

T0 = datetime(2024, 1, 1, 0, 0, 0)


def _rows(times, sents=None, emos=None):
    out = []
    for i, t in enumerate(times):
        out.append({"post_id": "p", "comment_id": f"c{i:03d}", "comment_text": "x",
                    "created_time": t.strftime("%Y-%m-%dT%H:%M:%S+0000"),
                    "sentiment": (sents or ["neutral"] * len(times))[i],
                    "emotion": (emos or ["joy"] * len(times))[i], "like_count": i})
    return out


def test_gaps_zero_filled_and_stack_only_observed(spark):
    df = make_comments(spark, _rows([T0, T0 + timedelta(hours=1, minutes=20), T0 + timedelta(hours=3, minutes=10)]))
    tl = TS.timeline(df).orderBy("idx").collect()
    assert len(tl) == 13 and tl[0]["width_s"] == 900  # 00:00 .. 03:00 by 15 min
    assert sum(r["count"] for r in tl) == 3
    assert TS.emotion_stack(df).count() == 3


def test_long_span_hourly(spark):
    df = make_comments(spark, _rows([T0, T0 + timedelta(hours=3), T0 + timedelta(hours=7)]))
    tl = TS.timeline(df).collect()
    assert {r["width_s"] for r in tl} == {3600} and len(tl) == 8


def _spike_df(spark, counts):
    times = []
    for b, n in enumerate(counts):
        times += [T0 + timedelta(hours=b, minutes=j % 60) for j in range(n)]
    times.append(T0 + timedelta(hours=7))  # span > 6 h -> hourly bins
    return make_comments(spark, _rows(times))


def test_spikes_literal_never_trailing_sometimes(spark):
    a = _spike_df(spark, [1, 2, 3, 40])
    b = _spike_df(spark, [2, 2, 2, 40])
    assert TS.spikes(a, "literal").count() == 0 and TS.spikes(b, "literal").count() == 0
    assert TS.spikes(a, "trailing").count() == 1
    assert TS.spikes(b, "trailing").count() == 0  # sd = 0 never fires


def test_peak_last_gives_null_tau(spark):
    times = [T0 + timedelta(hours=h) for h in (0, 1, 2)] + [T0 + timedelta(hours=7)] * 5
    d = TS.decay_fit(make_comments(spark, _rows(times))).first()
    assert d["slope"] is None and d["tau_bins"] is None


def test_contagion_gap_boundary(spark):
    secs = [0, 1800, 3601, 5401, 7202]  # gaps 1800 (counted), 1801, 1800, 1801
    sents = ["positive", "negative", "positive", "positive", "neutral"]
    df = make_comments(spark, _rows([T0 + timedelta(seconds=s) for s in secs], sents))
    rows = {(r["prev"], r["next"]): r["pairs"] for r in TS.contagion(df).collect()}
    assert rows[("positive", "negative")] == 1 and rows[("positive", "positive")] == 1
    assert sum(rows.values()) == 2 and len(rows) == 9


def test_contagion_bucket_split_equals_single_bucket(spark, sf001):
    from quillstat.plans.registry import enriched
    df = enriched(spark, sf001)
    a = {tuple(r) for r in TS.contagion(df, bucket_seconds=600).select("post_id", "prev", "next", "pairs").collect()}
    b = {tuple(r) for r in TS.contagion(df, bucket_seconds=10 ** 9).select("post_id", "prev", "next", "pairs").collect()}
    assert a == b


def test_half_life_and_first10(spark):
    times = ([T0] * 4 + [T0 + timedelta(hours=1)] * 3 + [T0 + timedelta(hours=2)] * 2
             + [T0 + timedelta(hours=7)])  # hourly bins 4,3,2,0,0,0,0,1
    r = TS.half_life(make_comments(spark, _rows(times))).first()
    assert r["half_life_hours"] == 1.0 and r["t_first10_hours"] == 7.0


def test_forecast_next_day(spark):
    times = [T0 + timedelta(minutes=i) for i in range(20)] + \
            [T0 + timedelta(days=1, minutes=i) for i in range(15)]
    assert TS.forecast_next_day(make_comments(spark, _rows(times))).first()["forecast"] == 10
    few = [T0, T0 + timedelta(days=1)]
    assert TS.forecast_next_day(make_comments(spark, _rows(few))).first()["forecast"] is None
