import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstat.functions import bayes as B


def texts(n, seed):
    r = random.Random(seed)
    words = {"a": ["sun", "sea", "sand", "both", "Warm"], "b": ["ice", "snow", "cold", "both", "ünder"], "c": ["rock", "hill"]}
    return [(i, " ".join(r.choice(words[k]) for _ in range(r.randrange(1, 8))), k) for i, k in ((i, r.choice("aab" if i % 4 else "c")) for i in range(n))]


def brute(train, text):
    """Class log probabilities by the textbook."""
    docs, counts = Counter(k for _, _, k in train), {}
    for _, t, k in train:
        counts.setdefault(k, Counter()).update(t.lower().split())
    vocabulary = set().union(*counts.values())
    logs = {k: math.log(docs[k] / len(train)) + sum(math.log((counts[k][w] + 0.5) / (sum(counts[k].values()) + 0.5 * len(vocabulary))) for w in text.lower().split() if w in vocabulary)
            for k in sorted(docs)}
    top = max(logs.values())
    total = sum(math.exp(v - top) for v in logs.values())
    return {k: math.exp(v - top) / total for k, v in logs.items()}


def test_scores_equal_the_textbook(spark):
    train = texts(80, 1)
    new = [(1000, "sun ice rock", "x"), (1001, "Warm warm ünder nothing", "x"), (1002, "", "x"), (1003, None, "x"), (1004, "both", "x")]
    m = B.fit(spark.createDataFrame(train, "id long, t string, k string"), "t", "k", B.words)
    df = spark.createDataFrame(new, "id long, t string, k string")
    got = {r["id"]: r["p"] for r in m.scores(df, "t", ["id"]).collect()}
    assert len(got) == 5
    for i, t, _ in new:
        assert got[i] == pytest.approx(brute(train, t or ""), abs=1e-12)
    best = {r["id"]: r["label"] for r in m.predict(df, "t", ["id"]).collect()}
    assert best == {i: max(sorted(got[i]), key=got[i].get) for i in got}


def test_vocabulary_is_bounded(spark):
    m = B.fit(spark.createDataFrame(texts(80, 2), "id long, t string, k string"), "t", "k", B.words, vocabulary=4)
    assert m.weights.count() == 4


def test_labels_are_needed(spark):
    with pytest.raises(ValueError):
        B.fit(spark.createDataFrame([], "id long, t string, k string"), "t", "k", B.words)


def test_character_grams(spark):
    g = spark.createDataFrame([("Ab, 1 c",), (None,)], "t string").select(B.character_grams(F.col("t")).alias("g")).collect()
    assert g[0]["g"] == [" ab", "ab ", "b c", " c "] and g[1]["g"] == []


def test_languages_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.col("doc_id") % 5 == 0
    found = B.language_model(d.filter(~held), "text", "lang").predict(d.filter(held), "text", ["doc_id", "lang"])
    assert found.agg(F.avg((F.col("label") == F.col("lang")).cast("double"))).first()[0] > 0.9
