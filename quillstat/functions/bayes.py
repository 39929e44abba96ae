"""UDF1, UDF2, UDF5: classifiers fitted on labelled rows and scored with built-in expressions.

Multinomial naive Bayes over the features of a text (character 3-grams for
languages, words for sentiment).  Fitting is one aggregate over (feature,
class); the model keeps ``vocabulary`` features, those that tell the classes
apart best, so its size is bounded and it can be broadcast.  Scoring explodes a
text's features, looks them up and sums one log probability a class: no Python,
and every feature of the whole text counts.

A text without known features (null and empty ones among them) gets the class
shares of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features kept in a model, and the count added to each.
VOCABULARY, SMOOTHING = 20_000, 0.5


def character_grams(text: Column, n: int = 3) -> Column:
    """All runs of ``n`` characters of the lower-cased text, white space as one blank."""
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}\p{Nd}\p{P}]+", " ")), F.lit(" "))
    return F.regexp_extract_all(flat, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and marks."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))


@dataclass
class NaiveBayes:
    """``weights``: ``feature`` and one log probability column ``c0, c1, ...`` a class, in order of ``classes``; ``priors``: their log shares."""

    weights: DataFrame
    classes: list[str]
    priors: list[float]
    features: Callable[[Column], Column]

    def scores(self, df: DataFrame, text: str, key: list[str]) -> DataFrame:
        """``key...`` and ``p``: probability by class (a map), one row per distinct ``key``."""
        rows = df.select(*key, F.explode_outer(self.features(F.col(text))).alias("feature"))
        # at most VOCABULARY rows, so the broadcast is bounded
        found = rows.join(F.broadcast(self.weights), "feature", "left").groupBy(*key).agg(
            *[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(len(self.classes))])
        logs = [F.col(f"c{i}") + F.lit(p) for i, p in enumerate(self.priors)]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        parts = [F.exp(x - top) for x in logs]
        total = sum(parts[1:], parts[0])
        entries = [x for c, p in zip(self.classes, parts) for x in (F.lit(c), p / total)]
        return found.select(*key, F.create_map(*entries).alias("p"))

    def predict(self, df: DataFrame, text: str, key: list[str], name: str = "label") -> DataFrame:
        """``key...`` and the likeliest class; ties go to the first in order."""
        s = self.scores(df, text, key)
        best = F.greatest(*[F.struct(F.col("p")[c].alias("p"), F.lit(-i).alias("i")) for i, c in enumerate(self.classes)]) if len(self.classes) > 1 else F.struct(F.lit(0).alias("i"))
        return s.select(*key, F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.lit(1) - best["i"]).alias(name))


def fit(df: DataFrame, text: str, label: str, features: Callable[[Column], Column], vocabulary: int = VOCABULARY, most_classes: int = 64) -> NaiveBayes:
    """Fit on the rows of ``df`` that have a label."""
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), features(F.col(text)).alias("f"))
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(most_classes + 1).collect()}
    if not 0 < len(shares) <= most_classes:
        raise ValueError(f"labels of 1 to {most_classes} classes are needed, not {len(shares)}")
    from math import log
    classes = sorted(shares)
    rows_in = sum(shares.values())
    counts = rows.select("label", F.explode("f").alias("feature")).groupBy("feature").agg(
        *[F.count_if(F.col("label") == c).alias(f"n{i}") for i, c in enumerate(classes)])
    totals = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(classes))], F.count(F.lit(1)).alias("v")).first()
    probs = [F.log((F.col(f"n{i}") + SMOOTHING) / F.lit(totals[f"n{i}"] + SMOOTHING * max(1, totals["v"]))) for i in range(len(classes))]
    spread = (F.greatest(*probs) - F.least(*probs)) if len(classes) > 1 else F.lit(1.0)
    n = sum((F.col(f"n{i}") for i in range(1, len(classes))), F.col("n0"))
    # what a feature adds to the distance of the classes over the labelled rows
    kept = counts.select("feature", *[p.alias(f"c{i}") for i, p in enumerate(probs)], (spread * n).alias("_gain")).orderBy(F.desc("_gain"), "feature").limit(vocabulary)
    from ..session import cut_lineage
    return NaiveBayes(cut_lineage(kept.drop("_gain")), classes, [log(shares[c] / rows_in) for c in classes], features)


def language_model(df: DataFrame, text: str = "comment_text", label: str = "language", vocabulary: int = VOCABULARY) -> NaiveBayes:
    """UDF5: languages by character 3-grams."""
    return fit(df, text, label, character_grams, vocabulary)


def sentiment_model(df: DataFrame, text: str = "comment_text", label: str = "sentiment", vocabulary: int = VOCABULARY) -> NaiveBayes:
    """UDF1: sentiment classes by words."""
    return fit(df, text, label, words, vocabulary)
