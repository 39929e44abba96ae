import math
import random
import zlib

import numpy as np
from helpers_llm import awkward, docs_of

from quillstat.llm import toxicity as T


def made(n, seed=1, bad=("grumph", "snarkle", "vexlo")):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulrstn") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(text) // 30)):
                text[r.randrange(len(text))] = r.choice(bad)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores))
    pos = np.array(labels) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_learns_and_shares_ngrams():
    rows = made(500)
    model = T.train([t for _, t, _ in rows], [y for *_, y in rows])
    s = T.Scorer(*model)
    new = made(200, seed=7)
    assert auc([s.score(t) for _, t, _ in new], [y for *_, y in new]) > 0.98
    mis = made(200, seed=8, bad=("grumphh", "snarkl3", "vvexlo"))  # spellings that training never saw
    assert auc([s.score(t) for _, t, _ in mis], [y for *_, y in mis]) > 0.9
    again = T.train([t for _, t, _ in rows], [y for *_, y in rows])
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]


def test_gradients_match_differences():
    """Analytic gradients of a batch against central differences of its loss."""
    r = np.random.default_rng(3)
    grams, dim, n = 7, 4, 5
    emb, soft, bias = r.normal(size=(grams, dim)), r.normal(size=(dim, 2)), r.normal(size=2)
    doc, gram, share = np.array([0, 0, 1, 2, 2, 2, 4]), np.array([0, 3, 3, 1, 2, 6, 0]), r.random(7)  # text 3 has no n-gram
    y, weight = np.array([1, 0, 1, 0, 0]), np.array([2.0, .7, 2.0, .7, .7])
    loss = lambda *m: T.gradients(*m, doc, gram, share, y, weight)[0]
    got = T.gradients(emb, soft, bias, doc, gram, share, y, weight)[1:]
    for k, grad in enumerate(got):
        for at in np.ndindex(grad.shape):
            up, down = ([m.copy() for m in (emb, soft, bias)] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert math.isclose((loss(*up) - loss(*down)) / 2e-5, grad[at], rel_tol=1e-5, abs_tol=1e-9)


def plain_score(text, table, bias):
    """The definition, spelled out: mean over words (and the neutral ones) of the mean over n-grams."""
    total, n = 0.0, 0
    for token in text.lower().split():
        while token and token[0] in T._ENDS:
            token = token[1:]
        while token and token[-1] in T._ENDS:
            token = token[:-1]
        if not token:
            continue
        n += 1
        marked = "<" + token + ">"
        grams = [marked]
        for size in T.GRAMS:
            for at in range(len(marked)):
                if at + size <= len(marked):
                    grams.append(marked[at:at + size])
        total += sum(float(table[zlib.crc32(g.encode()) % len(table)]) for g in grams) / len(grams)
    return 1 / (1 + math.exp(-(bias + total / (n + T.NEUTRAL_WORDS))))


def test_scores_match_the_plain_definition():
    table = np.random.default_rng(5).normal(0, 40, T.BUCKETS).astype(np.float32)
    s = T.Scorer(table, -0.3)
    texts = [t for _, t, _ in awkward() if t is not None] + ["1d10t a55hole, (que&&&) ... \u00abx\u00bb", "don't well-known", "...", "a" * 5000]
    for t in texts:
        assert math.isclose(s.score(t), plain_score(t, table, -0.3), rel_tol=1e-9)
    # training sees the same shares: a text's n-grams and the scorer's sum agree
    for t in texts:
        at, share = T.shares(t, {})
        z = -0.3 + float((table[at].astype(float) * share).sum())
        assert math.isclose(s.score(t), 1 / (1 + math.exp(-z)), rel_tol=1e-3, abs_tol=1e-6)


def test_words_keep_digits_and_symbols():
    assert T.words_of('Such an 1D10T, "a55hole"! st_upid (x) ... &&&') == ["such", "an", "1d10t", "a55hole", "st_upid", "x", "&&&"]
    texts, labels = ["calm 1d10t words"] * 6 + ["calm plain words"] * 6, [1] * 6 + [0] * 6
    s = T.Scorer(*T.train(texts, labels))
    assert s.score(texts[0]) > 0.9 > 0.1 > s.score(texts[-1])
    assert s.score("some 1d10ts") > 0.5  # a spelling that training never saw


def test_sample_is_bounded_by_characters(spark):
    rows = [(i, "x" * (10 * (i + 1)), "s") for i in range(40)] + [(50, None, "s")]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in (*range(40), 50)], "doc_id long, toxic int, quality int")
    whole = T.training_sample(docs_of(spark, rows), labels).collect()
    got = T.training_sample(docs_of(spark, rows), labels, chars=600).collect()
    assert 0 < len(got) < len(whole) and all((r["doc_id"], r["text"], "s") in rows for r in got)
    for y in (0, 1):
        assert sum(len(r["text"] or "") for r in got if r["_y"] == y) <= 600


def test_held_out_rows_do_not_train(spark):
    rows = made(800)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    docs = docs_of(spark, [(i, t, "s") for i, t, _ in rows], extra=True)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in T.score_documents(docs, labels).collect()}
    assert {i for i, r in got.items() if r["held_out"]} == held
    flipped = spark.createDataFrame([(i, 1 - y if i in held else y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    again = {r["doc_id"]: r["score"] for r in T.score_documents(docs, flipped).collect()}
    assert all(abs(got[i]["score"] - again[i]) < 1e-12 for i in got)
    test = [(got[i]["score"], y) for i, _, y in rows if i in held]
    assert auc(*zip(*test)) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_sample_has_one_row_per_id(spark):
    rows = [(100, f"copy {i % 40}", "s") for i in range(200)] + [(100, None, "s")] + [(i, f"text {i}", "s") for i in range(3, 60)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in (*range(3, 60), 100)] * 2, "doc_id long, toxic int, quality int")
    for most in (3, 100):
        got = T.training_sample(docs, labels, most).collect()
        again = T.training_sample(docs_of(spark, rows[::-1]), labels, most).collect()
        assert len(got) == len({r["doc_id"] for r in got}) <= 2 * most and sorted(got) == sorted(again)
        assert all((r["doc_id"], r["text"], "s") in rows and r["_y"] == r["doc_id"] % 2 for r in got)
    assert 100 in {r["doc_id"] for r in got}


def test_awkward_rows(spark):
    rows = awkward()
    docs = docs_of(spark, rows, extra=True)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, 0), (7, 0, 0), (7, 0, 0), (999, 1, 0)], "doc_id long, toxic int, quality int")
    got = T.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    none = T.score_documents(docs, labels.limit(0)).collect()
    assert {round(r["score"], 12) for r in none} == {0.5}
    assert T.score_documents(docs.limit(0), labels).count() == 0
    assert math.isclose(T.Scorer(np.zeros(8, np.float32), 0.0).score(None), 0.5)
