import zlib
from collections import Counter

import numpy as np
from helpers_llm import awkward, docs_of
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstat.llm import packing as P


def one_by_one(lengths, capacity):
    """Best fit decreasing, document by document: bins as lists of lengths."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= n]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(n)
        else:
            bins.append([n])
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    plan, bins = P.best_fit_decreasing(Counter(lengths), 32)
    filled = {}
    for p in plan:
        for i in range(p.n):
            filled.setdefault(p.bin + i // p.per_bin, []).append((p.offset + i % p.per_bin * p.length, p.length))
    for items in filled.values():
        end = 0
        for start, n in sorted(items):
            assert start == end
            end += n
        assert end <= 32
    want = one_by_one(lengths, 32)
    assert bins == len(want) == len(filled)
    # bins of equal room are interchangeable, so only how full they get is compared
    assert Counter(sum(n for _, n in b) for b in filled.values()) == Counter(map(sum, want))


@given(st.sets(st.integers(1, 64)), st.integers(1, 64))
def test_tree_finds_the_tightest(rooms, need):
    tree = P.SegmentTree(64)
    for r in rooms:
        tree.set(r, True)
    assert tree.tightest(need) == min((r for r in rooms if r >= need), default=None)


@given(st.integers(1, 5000))
def test_cut(n):
    pieces = P.cut(n, 1024)
    assert sum(k for _, k in pieces) == n and all(k == 1024 for _, k in pieces[1:])
    assert [s for s, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\n ", " \n", "\t", "the", "don't", "'s", "9", "½", "é", "日本", "𝄞", "...", " ", "　", "\x1c", "\x85",
                                 "<|endoftext|>", "endoftext", "_", "ﬁ", "é"]), max_size=25).map("".join))
def test_encoder_gives_the_tokenizers_ids(text):
    from tokenizers import Tokenizer
    global _T, _E
    try:
        _T
    except NameError:
        _T = Tokenizer.from_file(P.tokenizer_path())
        _E = P.Encoder(P.tokenizer_path(), P.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert np.frombuffer(_E(text), "<u4").tolist() == _T.encode(text, add_special_tokens=False).ids


def test_pack_rows(spark):
    rows = awkward()
    got = P.pack_documents(docs_of(spark, rows, extra=True)).collect()
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.tokenizer_path())
    want = Counter()
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [P.END_ID]
        for k, (s, n) in enumerate(P.cut(len(ids))):
            want[(i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= P.CAPACITY
    assert len(by) == len(one_by_one([k[3] for k, c in want.items() for _ in range(c)], P.CAPACITY))


def test_many_of_one_length(spark):
    """More pieces of one length than are ranked together: places stay distinct and gapless."""
    n = 3 * P.RANKED_TOGETHER
    got = P.pack_documents(docs_of(spark, [(i, "one two three", "a") for i in range(n)])).collect()
    places = {(r["sequence_id"], r["offset"]) for r in got}
    per = P.CAPACITY // got[0]["length"]
    assert len(places) == n and len({s for s, _ in places}) == -(-n // per)


def test_empty_table(spark):
    assert P.pack_documents(docs_of(spark, [])).count() == 0
