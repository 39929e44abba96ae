"""Bins that hold no comments cost nothing, and every result equals the zero-filled series."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import make_comments

from quillstat.operators import timeseries as TS

T0 = datetime(2024, 1, 1)


def rows_of(posts):
    out = []
    for p, times in posts.items():
        out += [{"post_id": p, "comment_id": f"{p}-{i}", "comment_text": "x", "emotion": "joy", "created_time": t.strftime("%Y-%m-%dT%H:%M:%S+0000")} for i, t in enumerate(times)]
    return out


def dense(times):
    """Zero-filled counts, their width, by definition."""
    span = (max(times) - min(times)).total_seconds() / 3600
    width = 900 if span <= 6 else 3600
    b = [int((t - datetime(1970, 1, 1)).total_seconds() // width) for t in times]
    return np.bincount(np.array(b) - min(b)), width


def fitted(counts):
    peak = int(np.argmax(counts))
    y = np.log(np.maximum(counts[peak:].astype(float), 1e-6))
    if len(counts) < 4 or len(y) < 2:
        return peak, None, None
    slope, intercept = np.polyfit(np.arange(len(y)), y, 1)
    return peak, slope, intercept


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_the_zero_filled_series(spark, monkeypatch, block):
    monkeypatch.setattr(TS, "BLOCK_BINS", block)
    r = random.Random(1)
    posts = {f"p{k}": [T0 + timedelta(seconds=int(r.expovariate(1) * 20_000 * (k + 1))) for _ in range(r.choice([1, 2, 9, 40, 120]))] for k in range(8)}
    posts["short"] = [T0 + timedelta(minutes=m) for m in (0, 1, 2, 100, 350)]
    posts["gap"] = [T0, T0 + timedelta(days=200)] + [T0 + timedelta(days=100)] * 4
    posts["last"] = [T0, T0 + timedelta(hours=9), T0 + timedelta(hours=9)]
    df = make_comments(spark, rows_of(posts)).cache()
    lines = {}
    for x in TS.timeline(df).collect():
        lines.setdefault(x["post_id"], {})[x["idx"]] = x["count"]
    fits = {x["post_id"]: x for x in TS.decay_fit(df).collect()}
    half = {x["post_id"]: x for x in TS.half_life(df).collect()}
    for p, times in posts.items():
        counts, width = dense(times)
        assert [lines[p][i] for i in range(len(counts))] == counts.tolist() and len(lines[p]) == len(counts)
        peak, slope, intercept = fitted(counts)
        assert fits[p]["n_bins"] == len(counts) and fits[p]["peak_index"] == peak
        assert (fits[p]["slope"] is None) == (slope is None)
        if slope is not None:
            assert fits[p]["slope"] == pytest.approx(slope, rel=1e-8, abs=1e-12) and fits[p]["intercept"] == pytest.approx(intercept, rel=1e-8)
        cum, hours = np.cumsum(counts), width / 3600
        assert half[p]["half_life_hours"] == np.flatnonzero(cum >= cum[-1] / 2)[0] * hours
        assert half[p]["t_first10_hours"] == (np.flatnonzero(cum >= 10)[0] * hours if cum[-1] >= 10 else None)


def test_a_stray_time_of_year_9999_costs_nothing(spark):
    posts = {"p": [T0 + timedelta(minutes=7 * i) for i in range(200)] + [datetime(9999, 12, 31)]}
    df = make_comments(spark, rows_of(posts)).cache()
    df.count()
    at = time.perf_counter()
    assert TS.bin_counts(df).count() == 25
    assert TS.half_life(df).first()["half_life_hours"] == 11.0
    f = TS.decay_fit(df).first()
    assert f["n_bins"] > 60_000_000 and f["slope"] < 0 and f["tau_bins"] > 0
    assert time.perf_counter() - at < 60
