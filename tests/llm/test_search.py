import math
import random
import time

import numpy as np
import pytest

from quillstat.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, row long, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def vectors(n, dim=12, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    return [(int(i), [float(c) for c in v]) for i, v in zip(r.permutation(n), x)]


def awkward(n=120):
    nan, inf = float("nan"), float("inf")
    rows = vectors(n)
    return rows + [rows[0], rows[0], (20, None), (40, [nan] * 12), (60, [inf] + [0.0] * 11), (80, [None] + [0.0] * 11), (100, [0.0] * 12), (None, [1.0] * 12),
                   (1000, [1.0] * 12), (1001, [1.0] * 12)]


def usable(rows, zero=True):
    ok = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    return ok if zero else [(i, v) for i, v in ok if any(v)]


def brute(rows, k, transform):
    x = np.array([[transform(c) for c in v] for _, v in rows])
    out = []
    for j, (i, _) in enumerate(rows):
        if i is not None and i % 20 == 0:
            s = x @ x[j]
            order = sorted((t for t in range(len(rows)) if t != j), key=lambda t: (-s[t], rows[t][0] is None, rows[t][0] or 0))[:k]
            out += [(i, n + 1, rows[t][0], s[t]) for n, t in enumerate(order)]
    return out


def key(x):
    return tuple((v is None, v or 0) for v in x)


def got(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=key)


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)  # small blocks: several pivots, annuli and parts
    rows = awkward()
    want = sorted(brute(usable(rows), 20, lambda c: int(np.floor(64 * c))), key=key)
    assert got(topk.top_k(table(spark, rows))) == [(a, b, c, int(d)) for a, b, c, d in want]


def test_top_k_of_one_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rows = [(i, [0.5, 0.25]) for i in range(150)] + [(200 + i, [float(i), -1.0]) for i in range(50)]
    want = sorted(brute(usable(rows), 20, lambda c: int(np.floor(64 * c))), key=key)
    assert got(topk.top_k(table(spark, rows))) == [(a, b, c, int(d)) for a, b, c, d in want]


def test_top_k_large_integers(spark):
    rows = [(i, [float(3e6 + i), float(-2e6 + 7 * i)]) for i in range(45)]
    want = sorted(brute(usable(rows), 20, lambda c: int(np.floor(64 * c))), key=key)
    assert got(topk.top_k(table(spark, rows))) == [(a, b, c, int(d)) for a, b, c, d in want]


def test_few_and_no_rows(spark):
    for search in (topk.top_k, ann.nearest):
        assert search(table(spark, [])).count() == 0
        assert search(table(spark, [(0, [1.0, 2.0])])).count() == 0
        assert [r["vec_id"] for r in search(table(spark, [(0, [1.0, 2.0]), (5, [1.0, 1.0])])).collect()] == [5]


def test_unequal_lengths_count_as_filled_up(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0]), (2, [0.0, 5.0])]
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(table(spark, rows), scale=1).orderBy("rank").collect()] == [(2, 10), (1, 1)]
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(table(spark, rows)).orderBy("rank").collect()] == [(2, 10.0), (1, 1.0)]


def test_ann_on_awkward_rows(spark):
    rows = awkward()
    ok = usable(rows, zero=False)
    want = brute(ok, 20, float)
    by = {}
    for q, _, v, _ in want:
        by.setdefault(q, []).append(v)
    seen = {}
    for q, rank, v, s in got(ann.nearest(table(spark, rows))):
        seen.setdefault(q, []).append((rank, v, s))
    assert seen.keys() == by.keys()
    for q, found in seen.items():
        assert [r for r, _, _ in found][:20] == list(range(1, 21)) or len(found) > 20  # repeated query rows share an id
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True) or len(found) > 20
    hits = sum(len(set(by[q]) & {v for _, v, _ in f}) for q, f in seen.items())
    assert hits >= 0.9 * sum(len(set(v)) for v in by.values())


def test_ann_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 1500)
    r = random.Random(2)
    x = np.random.default_rng(4).standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)]
    r.shuffle(rows)
    want = brute(usable(rows), 20, float)
    by = {(q, v): s for q, _, v, s in want}
    found = got(ann.nearest(table(spark, rows)))
    hit = [(q, v, s) for q, _, v, s in found if (q, v) in by]
    assert len(found) == len(want) and len(hit) >= 0.95 * len(want)
    assert all(abs(by[q, v] - s) < 1e-12 for q, v, s in hit)


def test_ann_counts_collisions_cheaply():
    """A query's search costs a few passes over the block's vectors, not dozens, and finds the nearest."""
    x = np.random.default_rng(5).standard_normal((16_384, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, q = ann.Index(x, 1.0), x[:60]

    def seconds(f, times=3):
        spent = []
        for _ in range(times):
            start = time.process_time()
            out = f()
            spent.append(time.process_time() - start)
        return min(spent), out
    plain, scores = seconds(lambda: [x.copy() @ v for v in q])
    took, found = seconds(lambda: list(index.search(q, np.arange(60), 20)))
    assert took < 3 * plain
    hits = 0
    for i, (at, score) in enumerate(found):
        assert i not in at and len(set(at.tolist())) == len(at) and np.allclose(score, x[at] @ q[i], rtol=0, atol=1e-12)
        scores[i][i] = -math.inf
        hits += len(set(np.argsort(-scores[i])[:20].tolist()) & set(at.tolist()))
    assert hits >= 0.95 * 60 * 20


def test_ann_queries_at_the_mean_and_copies():
    """Blocks whose queries lie at the mean, or that hold one vector only, end and find all."""
    r = np.random.default_rng(6)
    x = np.concatenate([np.ones((300, 8)), r.standard_normal((300, 8)) * 1e-3 + 1, np.ones((1, 8)) * 50])
    for block in (x, x[:300], x[-1:]):
        index = ann.Index(block, float(np.sqrt((block ** 2).sum(axis=1).max())))
        for i, (at, score) in enumerate(index.search(block[:40], np.arange(len(block[:40])), 20)):
            want = np.sort(np.delete(block @ block[i], i))[::-1][:20]
            assert i not in at and np.allclose(np.sort(score)[::-1][:20], want, rtol=1e-3)
            assert len(at) >= min(20, len(block) - 1)


def test_ann_searches_small_blocks_whole(spark):
    """500 rows without structure: the nearest are barely nearer than the rest, and all of them are found."""
    rows = vectors(500, dim=64, seed=7)
    want = brute(usable(rows), 20, float)
    assert {(q, r, v) for q, r, v, _ in got(ann.nearest(table(spark, rows)))} == {(q, r, v) for q, r, v, _ in want}
