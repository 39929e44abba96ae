"""Secret scan: fixed patterns, then password guess costs of values in a credential context.

``scan_secrets`` finds spans in whole texts.  Three patterns give the base
spans (kinds ``assign``, ``access``, ``hex``).  A fourth kind, ``guess``, comes
from the values that stand behind a credential word and a separator: dynamic
programming finds the cheapest way to guess a value as a chain of dictionary
words (also with letter substitutions or read backwards), dates, repeats,
keyboard walks and brute-force characters, and a value that stays too dear to
guess is reported.  Every such value is priced, whatever its length and whether
or not a base span holds it.

The dictionary is the word list of a public tokenizer's vocabulary: a word's
rank is its id, so its size is fixed and no pass over the corpus is needed.

Defined results: a null or empty text has no span; spans of one start are in
the order of the kinds; repeated rows each get their row; offsets are code
points, end exclusive.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Order of the kinds where spans start together.
KINDS = ("assign", "access", "hex", "guess")

# Fixed values of the contract (an open repeat with a least length finds the runs that are long enough).
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

_KEY = r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|secret|access|private|auth|account|signing|encryption|master)[\x20_-]?key)"
_QUOTED = r"""{0}([^{0}\\\r\n]*+(?:\\.[^{0}\\\r\n]*+)*+){0}"""
#: Credential words and separators whose value is put to the guess cost, whatever stands before the word.  A quoted
#: value ends at its closing quote, any other (also one whose quote stays open on its line) at white space; a value
#: that begins with a credential word and a separator is left to that word.
CONTEXT = re.compile(rf"""(?ai){_KEY}["']?[\x20\t]*+(?::=|=>|:|=)[\x20\t]*+"""
                     rf"""(?>{_QUOTED.format('"')}|{_QUOTED.format("'")}|(?!{_KEY}["']?[\x20\t]*+[:=])["']?(\S++))""")
_HINT = re.compile(r"(?ai)pass|pwd|secret|token|key|credential")

#: Guesses, as a power of two, from which a value counts as a secret.
SECRET_BITS = 40.0

KEYBOARD_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Keys behind the shifted characters of the first row.
_SHIFTED = str.maketrans("!@#$%^&*()", "1234567890")
#: Characters that stand for letters, read in two ways.
_LEET = tuple(str.maketrans("@4837105$!+9", "abeet" + x + "ossitg") for x in "il")
_MONTH, _DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_ORDERS = ("{y}([-/._]?){m}\\1{d}", "{d}([-/._]?){m}\\1{y}", "{m}([-/._]?){d}\\1{y}")
#: The forms of a date (year first, day first, month first, with four and two digits of the year; a year alone) and how many there are.
_DATES = tuple((re.compile("(?a)" + o.format(y=y, m=_MONTH, d=_DAY)), 365 * years) for y, years in ((r"(?:19|20)\d\d", 200), (r"\d\d", 100)) for o in _ORDERS)
_DATES += ((re.compile(r"(?a)(?:19|20)\d\d"), 200),)
#: Longest block that a repeat step repeats; part of that step's definition.
LONGEST_PERIOD = 8
LEAST_WALK = 4
#: Rows that are rewritten at a time.
ROWS = 500


class Span(NamedTuple):
    start: int
    kind: str
    end: int


class Words(dict):
    """Words and their ranks, and the length of the longest."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__(ranks)
        self.longest = max(map(len, ranks), default=0)


class Step(NamedTuple):
    kind: str
    start: int
    end: int
    bits: float


def tokenizer_words(path: str) -> Words:
    """Alphabetic entries (3 letters or more, lower case) of a vocabulary file and their ranks, from 1."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words: dict[str, int] = {}
    for token, rank in sorted(vocab.items(), key=lambda x: x[1]):
        word = token.lstrip("Ġ").lower()
        if len(word) >= 3 and word.isascii() and word.isalpha():
            words.setdefault(word, rank + 1)
    return Words(words)


def _neighbours() -> dict[str, set[str]]:
    """Keys next to each other on the rows of a keyboard, in the row or diagonally."""
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEYBOARD_ROWS):
        for x, key in enumerate(row):
            around = {row[i] for i in (x - 1, x + 1) if 0 <= i < len(row)}
            around |= {r[i] for r, at in ((KEYBOARD_ROWS[y - 1] if y else "", (x, x + 1)),
                                          (KEYBOARD_ROWS[y + 1] if y + 1 < len(KEYBOARD_ROWS) else "", (x - 1, x)))
                       for i in at if 0 <= i < len(r)}
            near[key] = around
    return near


_NEAR = _neighbours()


def _alphabet(c: str) -> int:
    if c.isdigit() and c.isascii():
        return 10
    if c.isalpha() and c.isascii():
        return 26
    return 33 if c.isascii() else 200


class _Starts:
    """The start inside a run that gives the least ``bits + log2(j - start)``, for growing ends ``j``.

    The term of an earlier start grows more slowly, so once as cheap as a later
    one it stays so.  The stack holds the starts that are or will be the
    cheapest, the cheapest now on top, each with the end at which the one below
    takes over; every start comes and goes once.
    """

    def __init__(self) -> None:
        self.held: list[tuple[float, int, float]] = []

    def add(self, bits: float, start: int, j: int) -> None:
        """Take up a later start that may be used from the end ``j`` on."""
        if self.held and self.least(j)[0] <= bits + math.log2(j - start):
            return
        over = math.inf
        while self.held:
            b, i, below = self.held[-1]
            ratio = 2 ** min(bits - b, 1000.0)
            over = (ratio * start - i) / (ratio - 1) if ratio > 1 else math.inf
            if over < below:
                break
            self.held.pop()
            over = math.inf
        self.held.append((bits, start, over))

    def least(self, j: int) -> tuple[float, int]:
        while self.held[-1][2] <= j:
            self.held.pop()
        bits, start, _ = self.held[-1]
        return bits + math.log2(j - start), start


def guess_cost(value: str, words: dict[str, int]) -> tuple[float, list[Step]]:
    """Bits of the cheapest chain that spells ``value``, and the chain.

    ``best[j]`` is the cheapest cost of the first ``j`` characters; each step
    ends at ``j`` and pays its own guesses plus one bit for the cut.  Words
    cost their rank, two bits more where capitals are mixed in, two where
    characters stand for letters and one where they are read backwards; dates the
    days of 200 years (100 with two digits of the year) or the years; repeats of a
    block their block and count; walks, shifted or not, their first key and the
    turns taken; and a brute-force character its alphabet.
    A repeat or walk may start and end anywhere inside its run.
    Work is linear in the length of the value.
    """
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    longest = words.longest if isinstance(words, Words) else max(map(len, words), default=0)
    keys, read = low.translate(_SHIFTED), [t for t in {low, *(low.translate(m) for m in _LEET)} if t != low]
    best: list[float] = [0.0] + [math.inf] * n
    back: list[Step | None] = [None] * (n + 1)

    def offer(kind: str, i: int, j: int, bits: float) -> None:
        if best[i] + bits < best[j]:
            best[j], back[j] = best[i] + bits, Step(kind, i, j, bits)

    single = [math.log2(_alphabet(c)) for c in value]
    upto, turns = [0.0], [0, 0, 0]  # bits of the first characters, and turns among them
    for bits in single:
        upto.append(upto[-1] + bits)
    for k in range(2, n):
        turns.append(turns[-1] + (ord(keys[k]) - ord(keys[k - 1]) != ord(keys[k - 1]) - ord(keys[k - 2])))
    alike = {p: 0 for p in range(1, LONGEST_PERIOD + 1)}  # characters before j that equal the one p before them
    repeats = {p: _Starts() for p in alike}
    near, walks = 0, _Starts()  # keys before j that follow on a walk
    for j in range(n + 1):
        for p in alike:
            if j <= p or value[j - 1] != value[j - 1 - p]:
                if alike[p]:
                    alike[p], repeats[p] = 0, _Starts()
                continue
            alike[p] += 1
            if alike[p] >= max(2, p):
                i = j - p - max(2, p)
                repeats[p].add(best[i] + 1 + upto[i + p] - upto[i], i, j)
                bits, i = repeats[p].least(j)
                offer("repeat", i, j, bits - best[i])
        if j > 1 and keys[j - 1] in _NEAR.get(keys[j - 2], ()):
            near += 1
            if near >= LEAST_WALK - 1:
                i = j - LEAST_WALK
                walks.add(best[i] + 1 + math.log2(47) - 2.5 * turns[i + 2], i, j)
                bits, i = walks.least(j)
                offer("walk", i, j, bits + 2.5 * turns[j] - best[i])
        elif near:
            near, walks = 0, _Starts()
        if j == n:
            break
        offer("brute", j, j + 1, single[j])
        for k in range(j + 3, min(n, j + longest) + 1):
            y = low[j:k]
            ranks = [(words.get(y), 0), (words.get(y[::-1]), 1)]
            for t in read:
                if t[j:k] != y:
                    ranks += [(words.get(t[j:k]), 2), (words.get(t[j:k][::-1]), 3)]
            found = [more + math.log2(rank + 1) for rank, more in ranks if rank]
            if found:
                offer("word", j, k, 1 + min(found) + (0 if value[j:k] in (y, y.capitalize(), y.upper()) else 2))
        for form, dates in _DATES:
            if m := form.match(value, j):
                offer("date", j, m.end(), 1 + math.log2(dates))
    steps, j = [], n
    while j:
        step = back[j]
        steps.append(step)
        j = step.start
    return best[n], steps[::-1]


def base_spans(text: str) -> list[Span]:
    out = []
    if ":" in text or "=" in text:
        out = [Span(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [Span(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [Span(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def priced_values(text: str, words: dict[str, int]) -> list[tuple[int, int, float]]:
    """(start, end, bits) of the values in a credential context."""
    if not (":" in text or "=" in text) or not _HINT.search(text):
        return []
    spans = [m.span(m.lastindex) for m in CONTEXT.finditer(text)]
    return [(a, b, guess_cost(text[a:b], words)[0]) for a, b in spans if a < b]


def with_guessed(base: list[Span], priced: list[tuple[int, int, float]], bits: float = SECRET_BITS) -> list[Span]:
    """Base spans and the priced values that are too dear to guess."""
    return sorted(base + [Span(a, "guess", b) for a, b, cost in priced if cost >= bits], key=lambda s: (s.start, KINDS.index(s.kind)))


def secret_spans(text: str, words: dict[str, int], bits: float = SECRET_BITS) -> list[Span]:
    """All spans of ``text``: the base spans and the values that are too dear to guess."""
    return with_guessed(base_spans(text), priced_values(text, words), bits)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """``text`` with every stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def _vocabulary(path: str | None) -> str:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, bits: float = SECRET_BITS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_priced, priced`` of every row.

    ``priced`` lists start:end:bits of every value that was put to the guess cost.
    """
    path = _vocabulary(vocabulary)
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_words(path)
        for b in batches:
            counts, digests, spans, priced = {k: [] for k in KINDS[:3]}, [], [], []
            for text in b.column("text"):
                base, values = base_spans(text.as_py()), priced_values(text.as_py(), words)
                priced.append(values)
                for k, n in counts.items():
                    n.append(sum(s.kind == k for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(with_guessed(base, values, bits)))
            costs = [",".join(f"{a}:{z}:{c:.1f}" for a, z, c in p) for p in priced]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts.values()), pa.array(digests, pa.string()), pa.array(spans, pa.string()),
                 pa.array([len(p) for p in priced], pa.int64()), pa.array(costs, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_priced", "priced"])

    return src.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_priced long, priced string")


def redact_secrets(docs: DataFrame, vocabulary: str | None = None, bits: float = SECRET_BITS) -> DataFrame:
    """``docs`` with every secret replaced in ``text``, and ``n_chars`` counted again where a text changed."""
    path, schema = _vocabulary(vocabulary), docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_words(path)
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = b.column("text").to_pylist()
            new = [redact(t, secret_spans(t, words, bits)) if t else t for t in texts]
            cols = {name: b.column(name) for name in b.schema.names}
            cols["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in cols:
                n_chars = [len(t) if t != old else n for t, old, n in zip(new, texts, cols["n_chars"].to_pylist())]
                cols["n_chars"] = pa.array(n_chars, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(clean, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
