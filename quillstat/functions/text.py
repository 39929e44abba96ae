"""Text column functions: tokenizer, counts, detectors, shingles.

All but the shingles are built-in Spark expressions.  Regular expressions
are part of whole-stage codegen, higher-order array functions run in the JVM
outside it.
"""

from __future__ import annotations

import functools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

# Python's Unicode ``\w`` is letters, numbers and underscore (no combining
# marks).  Java's bare ``\w`` is ASCII-only, so spell the class out.
WORD_CLASS_COMPAT = r"\p{L}\p{N}_"
WORD_CLASS_FULL = r"\p{L}\p{M}\p{N}_"
# Unicode white space, as the reference's language has it.  Java's bare ``\s`` is
# ASCII-only, so spell the class out.
SPACE_CLASS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
URL_PATTERN = rf"(?i)https?://[^{SPACE_CLASS}]+|www\.[^{SPACE_CLASS}]+"
EMOJI_RUN_PATTERN = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in L.EMOJI_RANGES) + "]+"


def word_pattern(mode: str = "compat") -> str:
    cls = WORD_CLASS_COMPAT if mode == "compat" else WORD_CLASS_FULL
    return f"[#@]?[{cls}]+"


def question_pattern() -> str:
    cls = WORD_CLASS_COMPAT
    words = "|".join(L.QUESTION_WORDS)
    return rf"(?i)\?|(^|[^{cls}])({words})($|[^{cls}])"


def lexicon_pattern(words) -> str:
    return "|".join(words)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_urls(text) -> Column:
    return F.regexp_replace(_c(text), F.lit(URL_PATTERN), F.lit(""))


def word_count(text, mode: str = "compat") -> Column:
    """Words after URL removal (no stop-word removal); null text -> 0."""
    return F.coalesce(F.regexp_count(strip_urls(text), F.lit(word_pattern(mode))), F.lit(0)).cast("long")


def emoji_count(text) -> Column:
    """Number of runs of emoji-range characters; null text -> 0."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(EMOJI_RUN_PATTERN)), F.lit(0)).cast("long")


def raw_tokens(text, mode: str = "compat") -> Column:
    """Lower-cased, URL-stripped ``[#@]?word`` tokens before any filtering."""
    cleaned = strip_urls(F.lower(_c(text)))
    return F.regexp_extract_all(cleaned, F.lit(f"({word_pattern(mode)})"), 1)


def keep_token(t: Column, stopwords=L.STOPWORDS) -> Column:
    """Tokenizer rule for one token: #/@ tokens always; else no stop word, not all digits, >=3 chars."""
    tagged = t.startswith("#") | t.startswith("@")
    plain_ok = (F.length(t) >= 3) & ~t.isin(*stopwords) & ~t.rlike(r"^\p{Nd}+$")
    return tagged | plain_ok


def cheap_keep_token(t: Column) -> Column:
    """``keep_token`` without the stop-word test (that one is done as a join on aggregated rows)."""
    tagged = t.startswith("#") | t.startswith("@")
    return tagged | (~t.rlike(r"^\p{Nd}+$") & (F.length(t) >= 3))


def tokenize(text, mode: str = "compat") -> Column:
    """FN1: array of keyword tokens of one comment (null text -> empty)."""
    toks = F.coalesce(raw_tokens(text, mode), F.array().cast("array<string>"))
    return F.filter(toks, lambda t: keep_token(t))


def is_question(text) -> Column:
    """FLT5: contains '?' or a question word; null -> false."""
    return F.coalesce(_c(text).rlike(question_pattern()), F.lit(False))


def lexicon_hit(text, words, word_boundary: bool = False) -> Column:
    """FLT6/FLT7: substring match of any word (reference), or whole words."""
    if word_boundary:
        cls = WORD_CLASS_COMPAT
        pat = rf"(^|[^{cls}])({lexicon_pattern(words)})($|[^{cls}])"
    else:
        pat = lexicon_pattern(words)
    return F.coalesce(F.lower(_c(text)).rlike(pat), F.lit(False))


def cta_hit(text, word_boundary: bool = False) -> Column:
    return lexicon_hit(text, L.CTA_WORDS, word_boundary)


def toxic_hit(text, word_boundary: bool = False) -> Column:
    return lexicon_hit(text, L.TOXIC_WORDS, word_boundary)


def whitespace_words(text) -> Column:
    """``str.split()``: non-empty whitespace-separated words; null -> empty."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), f"[{SPACE_CLASS}]+")
    return F.filter(parts, lambda w: F.length(w) > 0)


def hashtags(text) -> Column:
    """AGG28 tokens: whitespace words that start with '#' (case kept)."""
    return F.filter(whitespace_words(text), lambda w: w.startswith("#"))


def mean_word_length(text) -> Column:
    """AGG30 per comment: sum of word lengths / max(1, words)."""
    ws = whitespace_words(text)
    total = F.aggregate(ws, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w))
    return total / F.greatest(F.lit(1), F.size(ws))


def normalize_language(lang) -> Column:
    """FN8: null -> 'unknown', lower case, bn -> bangla, en -> english."""
    low = F.lower(F.coalesce(_c(lang), F.lit("unknown")))
    out = low
    for code, name in L.LANGUAGE_NAMES.items():
        out = F.when(low == code, F.lit(name)).otherwise(out)
    return out


def sentiment3(sentiment) -> Column:
    """FLT4: positive / negative by prefix, anything else neutral."""
    s = F.lower(F.coalesce(_c(sentiment), F.lit("")))
    return (F.when(s.startswith("pos"), "positive")
            .when(s.startswith("neg"), "negative").otherwise("neutral"))


def normalized_for_shingles(text) -> Column:
    """Lower case, whitespace runs collapsed to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), f"[{SPACE_CLASS}]+", " "))


def stripped(text) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(text), f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def gram_codes(text: str, k: int = L.SHINGLE_K) -> np.ndarray:
    """Distinct k-grams of a normalised text, 21 bits a character, in rising order."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    n = max(1, len(points) - k + 1)
    points = np.concatenate((points, np.zeros(max(0, k - len(points)), np.int64)))
    code = points[:n]
    for j in range(1, k):
        code = (code << 21) + points[j:j + n]
    return np.unique(code)


@functools.cache
def _gram_codes_of(k: int):
    def codes(texts: pa.Array) -> pa.Array:
        found = [gram_codes(t.as_py(), k) for t in texts]
        ends = np.cumsum([0, *(len(c) for c in found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))

    return F.arrow_udf(codes, "array<long>")


def shingle_codes(text, k: int = L.SHINGLE_K) -> Column:
    """FN4: distinct character k-grams of the normalised text, as exact long codes.

    Each code point c becomes (c + 1), 21 bits; a k-gram packs k of them
    (k <= 3), so the encoding is injective (0 marks a missing position for texts
    shorter than k).  Built from k shifted slices of a text's code points with
    numpy on Arrow batches: array functions of Spark make a boxed value per
    character.  Texts of length <= k give one shingle (the whole text); empty
    gives an empty set.
    """
    assert 1 <= k <= 3
    return _gram_codes_of(k)(normalized_for_shingles(text))


def threshold_fraction(thr: float) -> Fraction:
    """Exact rational of a decimal threshold (0.55 -> 11/20)."""
    return Fraction(str(thr)).limit_denominator(10 ** 6)
