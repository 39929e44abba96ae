import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.operators import quantiles as Q


def check(spark, rows, kind, ps=(0.0, 0.1, 0.5, 0.75, 1.0)):
    df = spark.createDataFrame(rows, f"g string, h int, a {kind}, b {kind}")
    want = {}
    for g, h, a, b in rows:
        for c, v in (("a", a), ("b", b)):
            if v is not None:
                want.setdefault((g, h), {}).setdefault(c, []).append(float(v))
    names = {f"{c}{i}": (c, p) for c in "ab" for i, p in enumerate(ps)}
    got = {(r["g"], r["h"]): r for r in Q.exact_quantiles(df, ["g", "h"], names).collect()}
    assert got.keys() == want.keys()
    for key, cols in want.items():
        for name, (c, p) in names.items():
            if c not in cols:
                assert got[key][name] is None
            else:
                assert got[key][name] == pytest.approx(np.quantile(cols[c], p), rel=1e-12, abs=1e-12), (key, name)


def rows_of(n, value, seed):
    r = random.Random(seed)
    return [(r.choice("xyz"), r.randrange(3), value(r), None if i % 5 == 0 else value(r)) for i in range(n)]


def test_small_counts(spark):
    check(spark, rows_of(500, lambda r: r.randrange(40), 1), "long")


def test_several_passes(spark):
    check(spark, rows_of(400, lambda r: r.randrange(1 << 40) - (1 << 39), 2), "long")


def test_the_whole_range_of_longs(spark):
    big = [-(1 << 63), (1 << 63) - 1, 0, -1, 1]
    rows = rows_of(300, lambda r: r.choice(big), 3)
    df = spark.createDataFrame(rows, "g string, h int, a long, b long")
    got = Q.exact_quantiles(df, ["g", "h"], {"lo": ("a", 0.0), "hi": ("a", 1.0)}).collect()
    for x in got:
        own = [r[2] for r in rows if (r[0], r[1]) == (x["g"], x["h"])]
        assert (x["lo"], x["hi"]) == (float(min(own)), float(max(own)))


def test_doubles(spark):
    check(spark, rows_of(400, lambda r: r.choice([r.gauss(0, 1), -0.0, 0.0, 1e300 * r.random(), -1e-300, r.random() * 1e9]), 4), "double")


def test_one_value_and_nothing(spark):
    check(spark, [("x", 1, 7, None), ("y", 1, None, None), ("z", 2, 3, 3)], "long")
    assert Q.exact_quantiles(spark.createDataFrame([], "g string, h int, a long, b long"), ["g"], {"m": ("a", 0.5)}).count() == 0


def test_narrow_digits_take_many_passes(spark, monkeypatch):
    monkeypatch.setattr(Q, "DIGIT_BITS", 3)
    check(spark, rows_of(200, lambda r: r.randrange(5000), 5), "long")


def test_a_hot_group_has_no_buffer(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") % 1009).alias("a"))
    q = Q.exact_quantiles(df, ["g"], {"m": ("a", 0.5)})
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan
    assert q.first()["m"] == float(np.quantile(np.arange(200_000) % 1009, 0.5))


def test_no_percentile_on_comments():
    import pathlib
    for f in pathlib.Path(Q.__file__).parent.glob("*.py"):
        assert "F.percentile(" not in f.read_text(), f
