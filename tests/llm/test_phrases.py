import collections
import random
import re

import pytest

from quillstat.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, w1 string, f string, n int, part int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


def brute(rows, least=10, held=50, listed=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        longer = collections.Counter()
        for p, c in count.items():
            if len(p) == 3 and c >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], c)
        found = []
        for p, a in count.items():
            if len(p) > 1 and a >= least and 100 * longer[p] < held * a:
                s, _, left, right = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:listed]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def random_docs(n, seed, vocabulary=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Ünï", "The", "𝄞", "a\x1cb", "x\x00"]
    out = []
    for i in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "? "]) for _ in range(r.randrange(60)))
        out.append((i, t, r.choice(["en", "de", None, "und", ""])))
    return out


AWKWARD = [(1, None, "en"), (2, "", "fr"), (3, " .,;\n ", "es"), (None, "no id " * 12, "en"), (4, "hot words here " * 4000, "de"), (5, "same line again\n" * 30, None),
           (5, "same line again\n" * 30, None), (6, "z" * 300_000 + " z", "en")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # containers burst, tries spill, dictionaries start anew, long pieces are cut, many prefix partitions
        for name, value in {"BURST": 8, "ENTRIES": 500, "WORDS": 30, "CHUNK": 50, "TEXT_BYTES": 200, "PARTITION_BYTES": 3000, "SALTS": 3, "HELD_ENTRIES": 20}.items():
            monkeypatch.setattr(P, name, value)
    rows = random_docs(400, 7) + AWKWARD
    assert got(P.collocations(P.phrase_counts(table(spark, rows)))) == brute(rows)


def test_word_bytes_bound(spark, monkeypatch):
    monkeypatch.setattr(P, "WORD_BYTES", 200)
    monkeypatch.setattr(P, "CHUNK", 40)
    rows = random_docs(150, 8, 10)
    assert got(P.collocations(P.phrase_counts(table(spark, rows)))) == brute(rows)


def test_limit_and_ties(spark):
    rows = [(i, ". ".join(f"a{k} b{k}" for k in range(30)), "en") for i in range(10)]
    found = got(P.collocations(P.phrase_counts(table(spark, rows)), listed=7))
    assert found == brute(rows, listed=7) and [r[2] for r in found] == sorted(f"a{k} b{k}" for k in range(30))[:7]


def test_scores_beyond_64_bits(spark):
    rows = [("en", "a", None, None, 10 ** 13), ("en", "b", None, None, 10 ** 13), ("en", "a", "b", None, 10 ** 13 - 7), ("en", None, None, None, 3 * 10 ** 13)]
    t = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, f long")
    a = 10 ** 13 - 7
    assert got(P.collocations(t)) == [("en", 1, "a b", a, 10 ** 13, 10 ** 13, 3 * 10 ** 13, 1000000 * a * a // 10 ** 26)]


def test_empty_table(spark):
    assert got(P.collocations(P.phrase_counts(table(spark, [])))) == []


def test_test_table(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert got(P.query(spark, sf001)) == brute(rows)
