"""Strips and links give the results of the definition."""

import numpy as np
from conftest import make_comments
from similar_texts import shingles
from test_similarity_blocks import by_post, rows_of, texts

from quillstat.functions import text as X
from quillstat.operators import similarity as SIM


def test_strips_count_every_pair_once(monkeypatch):
    monkeypatch.setattr(SIM, "STRIP", 7)
    monkeypatch.setattr(SIM, "MATCHES", 50)
    monkeypatch.setattr(SIM, "MOST_DENSE", 20)
    sets = [X.gram_codes(t) for t in texts(60, 5)]
    own = [set(s.tolist()) for s in sets]
    for left, right in ((np.arange(60), None), (np.arange(0, 60, 2), np.arange(1, 60, 2))):
        a, b = SIM._blocks(sets, left, left if right is None else right)
        got = []
        for rows, cols, overlap, hit in SIM._overlaps(a, b, 11, 20):
            for i, j in zip(*np.nonzero(hit)):
                x, y = int(a.items[rows][i]), int(b.items[cols][j])
                assert overlap[i, j] == len(own[x] & own[y])
                got.append((min(x, y), max(x, y)))
        pairs = {(min(x, y), max(x, y)) for x in left.tolist() for y in (left if right is None else right).tolist() if x != y}
        assert sorted(got) == sorted((x, y) for x, y in pairs if 20 * len(own[x] & own[y]) >= 11 * len(own[x] | own[y]))
        assert got


def test_groups_are_joined_over_chains():
    root = SIM._joined(np.arange(8), np.array([6, 5, 4, 1]), np.array([5, 4, 3, 7]))
    assert root.tolist() == [0, 1, 2, 3, 3, 3, 3, 1]
    assert SIM._joined(root, np.array([7]), np.array([6])).tolist() == [0, 1, 2, 1, 1, 1, 1, 1]


def test_links_equal_brute_force_and_are_one_row_a_comment(spark, monkeypatch):
    monkeypatch.setattr(SIM, "ITEMS_PER_BLOCK", 20)
    found = texts(90, 6)
    found += found[:10] + ["  " + found[0].upper() + " "] * 6 + [" " * 20] * 3  # copies, and texts without shingles
    df = make_comments(spark, rows_of(found)).cache()
    want = {}
    for p, its in by_post(df).items():
        sh = {c: shingles(t) for c, t in its}
        near = {c: {d for d in sh if d != c and sh[c] and len(sh[c] & sh[d]) / len(sh[c] | sh[d]) >= 0.55} for c in sh}
        for c in sh:
            seen, todo = {c}, [c]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            want[p, c] = (len(near[c]), min(seen))
    got = {(r["post_id"], r["cid"]): (r["n_links"], r["component_id"]) for r in SIM.similar_links(df).collect()}
    assert got == want and max(n for n, _ in want.values()) > 6


def test_the_query_lists_every_pair(spark, sf001):
    import __spark_entry__ as E
    from quillstat.plans.registry import enriched
    rows = E.queries()["similar_pairs"](spark, sf001)
    assert rows.columns == ["post_id", "cid_a", "cid_b", "overlap", "union_size", "jaccard"]
    got = {(r["post_id"], r["cid_a"], r["cid_b"]): (r["overlap"], r["union_size"], r["jaccard"]) for r in rows.collect()}
    want = {}
    for p, its in by_post(enriched(spark, sf001)).items():
        sh = [shingles(t) for _, t in its]
        for j in range(len(its)):
            for i in range(j):
                o, u = len(sh[i] & sh[j]), len(sh[i] | sh[j])
                if 20 * o >= 11 * u > 0:
                    want[p, its[i][0], its[j][0]] = (o, u, round(o / u, 6))
    assert got == want and got
