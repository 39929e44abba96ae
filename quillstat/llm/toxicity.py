"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (and of itself), a
text the mean of its words, and a linear softmax over the text's vector gives
the two classes; vectors and softmax are learned together.  A misspelling that
training never saw shares n-grams, and so vectors, with what it saw.  Words are
what stands between white space, without punctuation at their ends, so digits
and symbols stay in them.

An n-gram's vector counts by the square of its inverse document frequency, and
every update leaves out half of each text's n-grams at random: otherwise the
vectors learn which texts they have seen instead of what marks a class.  Classes
have equal weight in training, and the score is the probability under equal
classes.

Training takes a sample of labelled rows whose bounds are ``TRAIN_DOCS`` ids per
class (smallest hash of the id first), one row each, and ``TRAIN_CHARS``
characters per class.  It runs in one task and returns one number per n-gram
bucket: the softmax is linear, so a bucket's vector enters a score only through
its product with the class weights.  Every text is then scored whole, in one
pass without a shuffle.

Defined results: a null text, or one without words, has the score of the bias;
ids without a label are scored like any other; a null id counts as held
out from training, not as ``held_out``; without labelled rows of both classes
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, written

#: Bounds of the training sample, per class.
TRAIN_DOCS, TRAIN_CHARS = 4000, 20_000_000
BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5)
UPDATES, BATCH, RATE, DROPPED = 700, 64, 2.0, 0.5
#: Texts that must hold an n-gram before it is learned: one text's own n-grams could only name the text.
LEAST_TEXTS = 5
THRESHOLD = 0.7
#: Words with a vector of zero that every text's mean counts beside its own, as in any smoothed share.
NEUTRAL_WORDS = 32

_ENDS = ".,;:!?\"'()[]{}<>\u00ab\u00bb\u2018\u2019\u201c\u201d\u2026"


def words_of(text: str) -> list[str]:
    """What stands between white space, lower-cased, without punctuation at the ends."""
    return [w for w in (x.strip(_ENDS) for x in text.lower().split()) if w]


def parts_of(word: str) -> list[str]:
    """The word itself and its character n-grams, ends marked."""
    s = f"<{word}>"
    return [s] + [s[i:i + n] for n in GRAMS for i in range(len(s) - n + 1)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def shares(text: str, buckets: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of a text and their shares of its mean; ``buckets`` keeps those of words already met."""
    words = Counter(words_of(text))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    for w in words:
        if w not in buckets:
            buckets[w] = np.array([zlib.crc32(p.encode()) % BUCKETS for p in parts_of(w)], np.int32)
    n = words.total() + NEUTRAL_WORDS
    size = np.array([len(buckets[w]) for w in words])
    per = np.repeat(np.fromiter(words.values(), np.float64, len(words)) / (n * size), size)
    at, place = np.unique(np.concatenate([buckets[w] for w in words]), return_inverse=True)
    return at, np.bincount(place, per).astype(np.float32)


def gradients(emb, soft, bias, doc, gram, share, y, weight):
    """Mean weighted loss of a batch and its gradients by n-gram vectors, softmax and bias.

    Entry ``i`` says that n-gram ``gram[i]`` has ``share[i]`` of text ``doc[i]``.
    """
    vec = np.stack([np.bincount(doc, emb[gram, d] * share, len(y)) for d in range(emb.shape[1])], axis=1).astype(emb.dtype)
    p = _softmax(vec @ soft + bias)
    own = np.arange(len(y)), y
    loss = float((-np.log(np.maximum(p[own], 1e-30)) * weight).mean())
    err = p.copy()
    err[own] -= 1
    err *= (weight / len(y))[:, None]
    to_doc = err @ soft.T
    d_emb = np.stack([np.bincount(gram, to_doc[doc, d] * share, len(emb)) for d in range(emb.shape[1])], axis=1).astype(emb.dtype)
    return loss, d_emb, vec.T @ err, err.sum(axis=0)


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Log-odds of label 1 per bucket, and the bias."""
    y = np.array(labels, dtype=np.int64)
    n, n1 = len(y), int(y.sum())
    table = np.zeros(BUCKETS, np.float32)
    if not 0 < n1 < n:
        return table, 0.0
    buckets: dict[str, np.ndarray] = {}
    docs = []
    for t in texts:
        if len(buckets) > 200_000:
            buckets.clear()
        docs.append(shares(t, buckets))
    del buckets
    found = sum((np.bincount(at, minlength=BUCKETS) for at, _ in docs), np.zeros(BUCKETS, np.int64))
    used = np.flatnonzero(found >= LEAST_TEXTS)
    idf = np.log((n + 1) / (found[used] + 1)).astype(np.float32) ** 2
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    for i, (at, share) in enumerate(docs):
        k = place[at]
        docs[i] = k[k >= 0], share[k >= 0] * idf[k[k >= 0]]
    rng = np.random.default_rng(seed)
    emb = np.zeros((len(used), DIM), np.float32)  # an n-gram that training never meets adds nothing
    soft = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_e, seen_s, seen_b = np.zeros(len(used), np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    floor = None
    balance = np.array([n / (2 * (n - n1)), n / (2 * n1)], np.float32)
    done = 0
    while done < UPDATES:  # as many updates for any sample size
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            done += 1
            part = order[i:i + BATCH]
            doc = np.repeat(np.arange(len(part)), [len(docs[k][0]) for k in part])
            gram, share = (np.concatenate([docs[k][j] for k in part]) for j in (0, 1))
            stay = rng.random(len(gram), np.float32) >= DROPPED
            doc, gram, share = doc[stay], gram[stay], share[stay] / (1 - DROPPED)
            _, d_emb, d_soft, d_bias = gradients(emb, soft, bias, doc, gram, share, y[part], balance[y[part]])
            sq = (d_emb ** 2).mean(axis=1)
            seen_e += sq
            if floor is None:  # rare n-grams move in proportion to their gradients, not by full steps
                floor = float(np.quantile(sq[sq > 0], 0.999)) if (sq > 0).any() else 1.0
            emb -= RATE * d_emb / np.sqrt(seen_e + floor)[:, None]
            seen_s += d_soft ** 2
            seen_b += d_bias ** 2
            soft -= 0.1 * RATE * d_soft / np.sqrt(seen_s)
            bias -= 0.1 * RATE * d_bias / np.sqrt(seen_b)
    table[used] = idf * (emb @ (soft[:, 1] - soft[:, 0]))
    return table, float(bias[1] - bias[0])


class _Grams(dict):
    """Log-odds of n-grams, looked up by bucket on first use."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table.tolist()

    def __missing__(self, gram: str) -> float:
        v = self[gram] = self.table[zlib.crc32(gram.encode()) % len(self.table)]
        return v


class Scorer(dict):
    """Probability of label 1 of whole texts; keeps the log-odds of words and n-grams it has met."""

    limit = 150_000

    def __init__(self, table: np.ndarray, bias: float):
        super().__init__()
        self.grams, self.bias = _Grams(table), bias

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        if len(self.grams) >= self.limit:
            self.grams.clear()
        parts = parts_of(word)
        v = self[word] = sum(map(self.grams.__getitem__, parts)) / len(parts)
        return v

    def score(self, text: str | None) -> float:
        words = words_of(text) if text else []
        z = self.bias + sum(map(self.__getitem__, words)) / (NEUTRAL_WORDS + len(words))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """``doc_id, text, _y`` of at most ``most`` ids and ``chars`` characters per class with one row each.

    Of several rows of one id the text of the smallest hash is taken; texts stay whole.
    """
    marks = (labels.where("doc_id is not null and toxic in (0, 1)").where(remainder(F.col("doc_id")) != 1)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y")))
    picked = None
    for y in (0, 1):
        some = marks.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    # the lengths come before the texts, so the window sorts at most 2 * most short rows
    least = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_y")
             .agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), "text")).alias("least")))
    rows = written(least.select("doc_id", "_y", "least.n", "least.text"), "toxicity-sample")
    so_far = F.sum("n").over(W.partitionBy("_y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = rows.select("doc_id", "_y", "n").withColumn("so_far", so_far).where(F.col("so_far") <= chars).select("doc_id")
    return rows.join(F.broadcast(within), "doc_id").select("doc_id", "text", "_y")


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """The model, from labelled rows whose remainder is not 1."""
    sample = training_sample(docs, labels, most)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["doc_id", "text"], kind="stable")
        table, bias = train(rows["text"].fillna("").tolist(), rows["_y"].tolist())
        yield pd.DataFrame({"table": [table.tobytes()], "bias": [bias]})

    if sample.isEmpty():
        return np.zeros(BUCKETS, np.float32), 0.0
    got = sample.coalesce(1).mapInPandas(fit, "table binary, bias double").first()
    return np.frombuffer(got["table"], np.float32), got["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score of ``text``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket
    src = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*held.value)
        for b in batches:
            score = pa.array([s.score(t.as_py()) for t in b.column("__text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), score], names=[*keep, name])

    return src.mapInArrow(run, docs.select(*keep).withColumn(name, F.lit(0.0)).schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    return scored(docs, fitted(docs, labels), ["doc_id"]).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    return scored(docs, fitted(docs, labels), docs.columns, "__score").where(F.col("__score") < threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
