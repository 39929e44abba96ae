import numpy as np
import pytest

from quillstat.llm import near_vectors as N

SCHEMA = "vec_id long, embedding array<float>, label int, node long, v string, w int"


def table(spark, rows):
    return spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], lab, 1, "x", 2) for i, v, lab in rows], SCHEMA)


def brute(rows, least=0.98):
    ok = [v is not None and lab is not None and len(v) > 0 and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(np.float32(c) != 0 for c in v) for _, v, lab in rows]
    dim = max((len(v) for (_, v, _), o in zip(rows, ok) if o), default=0)
    u = np.zeros((len(rows), dim))
    for i, ((_, v, _), o) in enumerate(zip(rows, ok)):
        if o:
            u[i, :len(v)] = np.array(v, np.float32).astype(np.float64)
            u[i] /= np.linalg.norm(u[i])
    lab = np.array([-1 if not o else r[2] for r, o in zip(rows, ok)])
    link = (u @ u.T >= least) & (lab[:, None] == lab[None, :]) & (lab >= 0)[:, None]
    np.fill_diagonal(link, False)
    out = []
    for i, (vid, _, _) in enumerate(rows):
        seen, new = np.zeros(len(rows), bool), np.arange(len(rows)) == i
        while new.any():
            seen |= new
            new = link[new].any(axis=0) & ~seen
        ids = [rows[j][0] for j in np.flatnonzero(seen) if rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((vid, int(link[i].sum()), comp, vid == comp))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def vectors(n, dim=6, labels=2, seed=3, copies=40):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    chain = np.array([[np.cos(t), np.sin(t), *[0.0] * (dim - 2)] for t in np.arange(0, 2, 0.15)])  # neighbours link, ends don't
    near = x[0] + 0.02 * r.standard_normal((copies, dim))
    x = np.concatenate([x, chain, near, x[:5] * 3, near[:3]]).astype(np.float32)
    ids = r.permutation(len(x))
    lab = [0 if i >= n else int(r.integers(labels)) for i in range(len(x))]
    return [(int(i), [float(c) for c in v], k) for i, v, k in zip(ids, x, lab)]


def awkward():
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]
    return [(5001, None, 0), (5002, [nan] * 6, 0), (5003, [inf, 0, 0, 0, 0, 0.0], 0), (5004, [None, 1.0], 0), (5005, [0.0] * 6, 0), (5006, [], 0), (5007, one, None), (5008, one, None),
            (5010, one, 1), (5011, [1.0, 2.0, 3.0], 1), (5011, one, 1), (5012, [-0.0, 1.0, 0, 0, 0, 0], 1), (5013, [0.0, 1.0, 0, 0, 0, 0], 1), (None, one, 1), (None, [0, 0, 0, 0, 0, -1.0], 1)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many cells, split three times, several blocks a cell
        for name, value in {"CELL": 10, "CENTRES": 4, "SAMPLED": 6, "SPLIT": 25, "ASSIGNED": 40, "LEFT": 12, "RIGHT": 30, "SALTS": 3, "SPLITS": 3}.items():
            monkeypatch.setattr(N, name, value)
    rows = vectors(350) + awkward()
    assert got(N.near_duplicates(table(spark, rows))) == brute(rows)


def test_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 20)
    rows = vectors(300, dim=3, labels=1, copies=100)  # dense on the sphere: most links cross cells
    want = brute(rows)
    assert sum(r[1] for r in want) > 3000
    assert got(N.near_duplicates(table(spark, rows))) == want


def test_other_thresholds(spark):
    rows = vectors(200, dim=4)
    assert got(N.near_duplicates(table(spark, rows), 0.9)) == brute(rows, 0.9)


def test_a_hot_group_takes_no_products(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal(16) + 0.01 * r.standard_normal((700, 16))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    _, n = N.nodes(table(spark, rows))
    cells = N.cells(n, N.LEAST)
    assert cells.where("not core").count() == 0
    assert got(N.near_duplicates(table(spark, rows))) == sorted([(i, 699, 0, i == 0) for i in range(700)], key=str)


def test_empty_table(spark):
    assert got(N.near_duplicates(table(spark, []))) == []


def test_test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(N.query(spark, sf)) == brute(rows)
