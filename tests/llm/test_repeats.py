import hashlib
import random

import numpy as np
import pytest
from helpers_llm import awkward, docs_of
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstat.llm import anchors as A
from quillstat.llm import repeats as R
from quillstat.llm import suffix as X


def brute(texts, least):
    """Removed byte spans by counting every window of all texts."""
    count = {}
    for t in texts:
        for i in range(len(t) - least + 1):
            count[t[i:i + least]] = count.get(t[i:i + least], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if count[t[i:i + least]] > 1:
                gone[i:i + least] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append([(int(a), int(b)) for a, b in edge.reshape(-1, 2)])
    return out


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    passages = [" ".join(word() for _ in range(r.choice([30, 60, 120]))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(3)]
        if r.random() < 0.7:
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            parts.insert(r.randint(0, 3), p[a:])
        if r.random() < 0.2:
            parts.append(r.choice(passages) * 2)
        texts.append(" ".join(parts))
    return texts + texts[:5] + ["ab" * 400, "x" * 700, "x" * 199, "x" * 200, "", "y" * 200]


@pytest.mark.parametrize("together", [R.TOGETHER, 3])
def test_against_brute_force(spark, together):
    """``together`` = 3 sends nearly every repeated anchor through the counted windows."""
    texts = corpus()
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    want = brute([t.encode() for t in texts], R.LEAST)
    got = {r["doc_id"]: r for r in R.remove_repeats(docs_of(spark, rows, extra=True), together=together).collect()}
    assert len(got) == len(texts) and any(want)
    for i, t in enumerate(texts):
        assert [(s["a"], s["b"]) for s in got[i]["spans"]] == want[i], i
        assert bytes(got[i]["kept"]) == R.kept(t.encode(), want[i])


def test_awkward_rows(spark):
    rows = awkward() + [(None, "z" * 150, "s"), (None, "z" * 150, "s"), (50, "q" * 300, "s"), (50, "r" * 300, "s")]
    want = brute([(t or "").encode() for _, t, _ in rows], R.LEAST)
    digest = lambda t, s: (len(t), sum(b - a for a, b in s), len(s), hashlib.sha256(R.kept(t, s)).hexdigest())
    got = R._each_text(docs_of(spark, rows), R.LEAST, R.TOGETHER, "n_removed long, n_spans long, kept_sha256 string",
                       lambda text, spans: (sum(b - a for a, b in spans), len(spans), hashlib.sha256(R.kept(text, spans)).hexdigest())).collect()
    want = sorted([(str(i), *digest((t or "").encode(), s)) for (i, t, _), s in zip(rows, want)])
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_empty_table(spark):
    assert R.remove_repeats(docs_of(spark, [])).count() == 0


def test_runs_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 700)
    r = random.Random(4)
    texts = [bytes(r.choice(b"abc ") for _ in range(n)) for n in (0, 50, 199, 200, 201, 640, 3000, 701, 1)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    met, by = {}, {}
    for run in A.runs(data, offsets, 200):
        for t, f, n, a, h in zip(*run[:5]):
            for s in range(f, f + n):
                assert s <= a <= s + 200 - A.GRAM
                met[(int(t), int(s))] = met.get((int(t), int(s)), 0) + 1
                by.setdefault(texts[t][s:s + 200], set()).add((int(h), int(a - s)))
    assert met == {(i, s): 1 for i, t in enumerate(texts) for s in range(len(t) - 199)}
    assert all(len(x) == 1 for x in by.values())  # equal windows have one anchor, at one place


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=40).map(str.encode), min_size=1, max_size=6))
def test_repeat_groups_are_the_maximal_repeats(segments):
    least = 4
    counts = [max(0, len(s) - least + 1) for s in segments]
    got = {}
    for length, places in X.repeat_groups(segments, counts, least):
        s, o = places[0]
        got[segments[s][o:o + length]] = set(places)
    at = {}
    for i, s in enumerate(segments):
        for a in range(len(s)):
            for b in range(a + least, len(s) + 1):
                at.setdefault(s[a:b], set()).add((i, a))
    want = {}
    for text, places in at.items():
        if len(places) > 1:
            before = {segments[i][o - 1] if o else -1 - n for n, (i, o) in enumerate(places)}
            after = {segments[i][o + len(text)] if o + len(text) < len(segments[i]) else -1 - n for n, (i, o) in enumerate(places)}
            if len(before) > 1 and len(after) > 1:
                want[text] = places
    assert got == want


def test_unequal_bytes_under_one_fingerprint(monkeypatch):
    monkeypatch.setattr(X, "mixed", lambda x: x & np.uint64(1))
    groups = {(g.length, frozenset(g.places)) for g in X.repeat_groups([b"xxabcdyy", b"zabcdw", b"qrst"], [5, 3, 1], 4)}
    assert groups == {(4, frozenset({(0, 2), (1, 1)}))}


def test_intervals():
    assert sorted(X.intervals([3, 5, 5, 2])) == sorted([(5, 1, 3), (3, 0, 3), (2, 0, 4)])
