"""URL filter: rules first, then host word segmentation with naive Bayes.

``judge_urls`` gives every page a verdict.  Rules decide where one fits.  The
rest is scored: a unigram Viterbi splits the concatenated names of hosts and
paths into words, and a multinomial naive Bayes, fitted on the pages that a
rule has decided, scores the words.  The splitter knows every word of the page
texts: the pieces of the distinct names meet the words' counts in a join, so
no task and not the driver holds the vocabulary.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by the class prior alone; with no page
decided by a rule, or on a tie, the verdict is ``allow``.  Repeated rows each
get their row.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, pages, partitions, written

#: (verdict, host, path).  Fixed values of the contract.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Size bound of ``dictionary`` (most frequent words first); ``judge_urls`` has no such bound.
DICTIONARY_WORDS = 50_000
SHORTEST_WORD, LONGEST_WORD = 2, 24
#: Rows of pieces that leave a Python worker at a time, and parts that the rows of one piece are dealt to.
PIECES, SALT = 50_000, 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    kind = "struct<rule:string,verdict:string>"
    best = F.lit(None).cast(kind)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")).cast(kind)).otherwise(best)
    return best


def word_counts(pages_df: DataFrame) -> DataFrame:
    """Counts of the words of all page texts (tags left out): ``word, n``."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"<[^>]*>", " "))
    return (pages_df.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
            .where(F.length("word").between(SHORTEST_WORD, LONGEST_WORD))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def dictionary(pages_df: DataFrame, words: int = DICTIONARY_WORDS) -> dict[str, float]:
    """Log probabilities of the most frequent words, at most ``words`` of them, for tables whose words are few.

    Words of one count are taken together or not at all, so the cut needs only
    the number of words per count.
    """
    counts = written(word_counts(pages_df), "word-counts")
    upto = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, W.currentRow)
    level = (counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(upto))
             .where(F.col("upto") <= words).agg(F.min("n").alias("n")).first()["n"])
    top = counts.where(F.col("n") >= level).collect() if level is not None else []
    total = sum(r["n"] for r in top)
    return {r["word"]: math.log(r["n"] / total) for r in top}


def segment(name: str, logp: dict[str, float]) -> list[str]:
    """Most probable split of ``name`` into words (unigram Viterbi).

    An unknown piece of length n costs ``-(2 + n) * ln 10`` beyond a word seen
    once in a million, so it is taken only where no words fit.
    """
    n = len(name)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - LONGEST_WORD), j):
            lp = logp.get(name[i:j])
            score = best[i] + (lp if lp is not None else -math.log(1e6) - (2 + j - i) * math.log(10))
            if score > best[j]:
                best[j], back[j] = score, i
    out, j = [], n
    while j:
        out.append(name[back[j]:j])
        j = back[j]
    return out[::-1]


def _names(urls: DataFrame) -> DataFrame:
    """host, path -> one row per raw name: ``host, path, part, name``; digits become ``0``."""
    def pieces(c: Column, part: str) -> Column:
        names = F.split(F.regexp_replace(F.lower(c), r"\p{Nd}+", "0"), r"[^\p{L}0]+")
        return F.transform(F.filter(names, lambda x: x != ""), lambda x: F.struct(F.lit(part).alias("part"), x.alias("name")))
    return urls.select("host", "path", F.explode(F.concat(pieces(F.col("host"), "h"), pieces(F.col("path"), "p"))).alias("x")) \
        .select("host", "path", "x.part", "x.name")


def _pieces(names: DataFrame) -> DataFrame:
    """``k, name`` -> ``k, word``: each stretch of letters in a name that is long enough for a word, once per name."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(ks: list[int], words: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(words, pa.string())], names=["k", "word"])

        ks, words = [], []
        for b in batches:
            for k, name in zip(b.column("k").to_pylist(), b.column("name").to_pylist()):
                seen = set()
                for i in range(len(name)):
                    for j in range(i + SHORTEST_WORD, min(len(name), i + LONGEST_WORD) + 1):
                        if name[j - 1] == "0" or name[i] == "0":
                            break  # digits are in no word
                        if (word := name[i:j]) not in seen:
                            seen.add(word)
                            ks.append(k)
                            words.append(word)
                    if len(ks) >= PIECES:
                        yield batch(ks, words)
                        ks, words = [], []
        if ks:
            yield batch(ks, words)

    return names.mapInArrow(cut, "k long, word string")


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct ``name`` -> ``name, words``; ``counts`` (``word, n``) is the whole vocabulary.

    A name meets only the words that it contains: at most 23 that begin at a
    letter.  The vocabulary is first reduced to the words that some name
    contains; the rows of a piece that many names share are dealt by a salt.
    """
    total = counts.agg(F.sum("n").alias("n")).first()["n"]
    distinct = written(names.select("name").distinct().withColumn("k", F.monotonically_increasing_id()), "names")
    pieces = _pieces(distinct.repartition(partitions(names.sparkSession), "k"))
    known = written(counts.join(pieces.select("word").distinct(), "word"), "known-words")
    salted = known.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    held = (pieces.withColumn("salt", F.pmod(F.col("k"), F.lit(SALT)).cast("int")).join(salted, ["word", "salt"])
            .groupBy("k").agg(F.collect_list(F.struct("word", "n")).alias("held")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("name").to_pylist()
            words = [segment(name, {x["word"]: math.log(x["n"] / total) for x in held or ()})
                     for name, held in zip(names, b.column("held").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return distinct.join(held, "k", "left").select("name", "held").mapInArrow(split, "name string, words array<string>")


def judge_urls(pages_df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, alpha: float = 1.0) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every page.

    ``score`` is the naive Bayes log-odds of ``block`` in units of 1e-9 (null
    where a rule decides).  A word that no decided page has counts for nothing.
    """
    src = pages_df.select("page_id", "url", "html")
    urls = src.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")) \
        .withColumn("r", matching_rule(F.col("host"), F.col("path"), rules)) \
        .select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    places = written(urls.groupBy("host", "path", "ruled").agg(F.count(F.lit(1)).alias("n")), "places")
    names = _names(places)
    words = written(segmented(names, written(word_counts(src), "word-counts")), "segments")
    tokens = (names.join(words, "name")
              .select("host", "path", F.explode("words").alias("w"), "part")
              .select("host", "path", F.concat_ws(":", "part", "w").alias("token"))
              .groupBy("host", "path", "token").agg(F.count(F.lit(1)).alias("tf")))
    seen = (places.where("ruled is not null").join(tokens, ["host", "path"])
            .groupBy("token").agg(F.sum(F.when(F.col("ruled") == "block", F.col("n") * F.col("tf")).otherwise(0)).alias("b"),
                                  F.sum(F.when(F.col("ruled") == "allow", F.col("n") * F.col("tf")).otherwise(0)).alias("a")))
    seen = written(seen, "token-counts")
    total = seen.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("tb"), F.coalesce(F.sum("a"), F.lit(0)).alias("ta"), F.count(F.lit(1)).alias("v")).first()
    prior = places.agg(F.coalesce(F.sum(F.when(F.col("ruled") == "block", F.col("n"))), F.lit(0)).alias("b"),
                       F.coalesce(F.sum(F.when(F.col("ruled") == "allow", F.col("n"))), F.lit(0)).alias("a")).first()
    base = math.log((prior["b"] + 1) / (prior["a"] + 1))
    den = math.log((total["ta"] + alpha * (total["v"] + 1)) / (total["tb"] + alpha * (total["v"] + 1)))
    odds = seen.select("token", F.round((F.log((F.col("b") + alpha) / (F.col("a") + alpha)) + den) * 1e9).cast("long").alias("lo"))
    open_ = places.where("ruled is null").select("host", "path")
    scores = (open_.join(tokens, ["host", "path"]).join(odds, "token")
              .groupBy("host", "path").agg(F.sum(F.col("lo") * F.col("tf")).alias("s")))
    prior_units = round(base * 1e9)
    return (urls.join(scores, ["host", "path"], "left")
            .withColumn("score", F.when(F.col("ruled").isNull(), F.coalesce("s", F.lit(0)) + F.lit(prior_units)))
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")
