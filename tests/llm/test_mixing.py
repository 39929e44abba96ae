import random
import re

import pytest
from helpers_llm import awkward, docs_of
from pyspark.sql import functions as F

from quillstat.llm import mixing as M


def shared(sizes, weights, total):
    """Water level by repeated resharing, as the contract words it."""
    cap = {s: 2.0 * n for s, n in sizes.items()}
    out, left, open_ = dict.fromkeys(sizes, 0.0), total, set(sizes)
    while left > 1e-9 and open_:
        w = sum(weights[s] for s in open_)
        for s in open_:
            out[s] += left * weights[s] / w
        left = sum(max(0.0, out[s] - cap[s]) for s in open_)
        full = {s for s in open_ if out[s] >= cap[s]}
        for s in full:
            out[s] = cap[s]
        open_ -= full
    return out


def run(spark, rows, extra=False):
    d = docs_of(spark, rows, extra).select("doc_id", F.col("source").alias("_source"), M.word_count(F.col("text")).alias("_size"))
    return M.mixed(d).select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "_times").collect()


@pytest.fixture(scope="module")
def mixed_rows(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.choice([1, 2, 3, 5, 8, 40, 200, 900])), r.choice(["a"] * 5 + ["b", "c", "B", "é", "𝄞", None])) for i in range(900)]
    return rows, run(spark, rows)


def test_targets_and_totals(mixed_rows):
    rows, got = mixed_rows
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = shared(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert len(got) == len(rows)
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert mine[0]["target"] == pytest.approx(target[s])
        assert sum(r["_times"] * r["size"] for r in mine) == pytest.approx(target[s], abs=3)
    assert all(0 <= r["_times"] <= 2 for r in got)


def test_rates_tilt_one_way(mixed_rows):
    """Within a source that is thinned, the share taken falls with the size (entropy balancing tilts by size)."""
    _, got = mixed_rows
    thin = [r for r in got if 0 < r["target"] < 0.9 * r["source_size"]]
    assert thin
    for s in {r["source"] for r in thin}:
        rate = {}
        for r in thin:
            if r["source"] == s and r["size"]:
                rate.setdefault(r["size"], []).append(r["_times"])
        small, large = (sum(rate[k]) / len(rate[k]) for k in (min(rate), max(rate)))
        assert small >= large


def test_reruns_agree(spark, mixed_rows):
    rows, got = mixed_rows
    again = run(spark, rows[::-1])
    assert sorted((r["doc_id"], r["_times"]) for r in again) == sorted((r["doc_id"], r["_times"]) for r in got)


def test_one_cell_larger_than_is_ranked_together(spark):
    n = 4 * M.RANKED_TOGETHER + 7
    got = run(spark, [(i, "a b c", "s") for i in range(n)] + [(n + i, "a b c d e f", "t") for i in range(n)])
    for s in ("s", "t"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["_times"] * r["size"] for r in mine) - mine[0]["target"]) <= 6


def test_awkward_rows(spark):
    rows = awkward()
    got = run(spark, rows, extra=True)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert run(spark, []) == []
    assert [r["target"] for r in run(spark, [(1, "", "a"), (2, None, None)])] == [0.0, 0.0]


def test_mix_keeps_columns_and_repeats_rows(spark):
    docs = docs_of(spark, [(i, "a b c", "xyz"[i % 3]) for i in range(60)], extra=True)
    got = M.mix(docs)
    assert got.columns == docs.columns and got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert abs(got.count() * 3 - 1.5 * 180) <= 9


def test_no_python_on_the_main_path(spark):
    d = docs_of(spark, [(1, "a b", "s")]).select("doc_id", F.col("source").alias("_source"), M.word_count(F.col("text")).alias("_size"))
    plan = M.mixed(d)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
