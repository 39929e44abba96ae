"""Near-duplicate vectors of one label: spherical k-means cells, blocked cosine products, one representative a group.

Equal unit vectors of a label are one node that counts its copies; rows find
their node by two 64-bit hashes.  Every label is
split into cells by spherical k-means fitted on a bounded sample, and cells of
more than ``SPLIT`` rows again, so a task holds the centres of one cell only.  A
node's home is its nearest cell.  Two unit vectors with cosine >= ``least`` are
at most ``reach`` apart, so a partner in another cell lies beyond the plane
between the two centres by no more than that: a node visits each later cell
whose plane is that near, and every link is met once, exactly.

In a cell, nodes within half the linking angle of its centre (its core) all link
with each other, which takes no products; so a hot group of near copies, which
draws a centre, costs its size.  All other pairs of home and home, home and
visitor are tested in blocks.  A block gives each node its number of links and
one link to its group in the block, never its pairs; the groups are the
components of those.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those of a null label, link with nothing; shorter vectors count
as filled with zeros; repeated rows are vectors of their own and link with each
other; a group's id is its smallest non-null ``vec_id``; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import embeddings, written
from .components import components
from .vectors import matrix, usable

LEAST = 0.98
#: Nodes a centre stands for, most centres of one split, nodes sampled a centre, nodes of a cell that is split again, splits at most.
CELL, CENTRES, SAMPLED, SPLIT, SPLITS = 512, 64, 64, 8192, 8
#: Rows assigned together, home and other rows of a block, and salts of joins on a cell.
ASSIGNED, LEFT, RIGHT, SALTS = 16_384, 2048, 8192, 16
STEPS, SEED = 12, 12
#: Kept apart from the exact bounds, so that rounding never loses a link or adds one.
_ROUNDING = 1e-9

_ROWS = "cell string, node long, w long, v array<double>, home boolean, core boolean"


def reach(least: float) -> float:
    """Sine of the linking angle: how far beyond a plane through the origin a partner can lie."""
    return math.sqrt(1 - least * least) + _ROUNDING


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column ``v`` scaled to unit length, null where it is null, empty or zero."""
    for b in batches:
        v = b.column("v")
        sizes = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = v.flatten().to_numpy(zero_copy_only=False)
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        top = np.maximum.reduceat(np.abs(x), starts) if len(x) else np.zeros(0)
        one = np.where(top > 0, top, 1.0)
        x = x / np.repeat(one, sizes[some])  # neither overflows nor vanishes when squared
        norm = np.sqrt(np.add.reduceat(x * x, starts)) if len(x) else np.zeros(0)
        x = x / np.repeat(np.where(norm > 0, norm, 1.0), sizes[some]) + 0.0  # no -0.0
        known = some.copy()
        known[some] = norm > 0
        values = x[np.repeat(known, sizes)]
        offsets = np.concatenate([[0], np.cumsum(np.where(known, sizes, 0))]).astype(np.int32)
        units = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~known))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), units], names=["vec_id", "label", "v"])


def nodes(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written rows ``row, vec_id, label, v`` (unit vector or null) with hashes ``h1, h2`` of ``v``, and nodes ``node, label, v, w, id, h1, h2``."""
    t = table.select("vec_id", "label", F.when(usable(F.col("embedding")) & F.col("label").isNotNull(), F.col("embedding").cast("array<double>")).alias("v"))
    t = written(t.mapInArrow(_units, t.schema).withColumn("row", F.monotonically_increasing_id()), "vectors")
    s = t.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.coalesce(F.min(F.size("v")), F.lit(0)).alias("least")).first()
    if s["least"] != s["dim"]:
        t = t.withColumn("v", F.when(F.col("v").isNotNull(), F.concat("v", F.array_repeat(F.lit(0.0), F.lit(s["dim"]) - F.size("v")))))
    # copies beside the hashes of their vector, so that rows find their node without the vector
    t = t.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(SEED), "v")})
    n = t.where("v is not null").groupBy("label", "v").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("id"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    return t, written(n.select("node", "label", "v", "w", "id", "h1", "h2"), "nodes")


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means: ``k`` unit centres of unit rows."""
    r = np.random.default_rng(SEED)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(STEPS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def _fit(sample: pa.Table) -> pa.Table:
    s = sample.sort_by("node")
    v = s.column("v")
    x = matrix(v, len(v[0]))
    c = centres(x, s.column("k")[0].as_py())
    return pa.table({"cell": s.column("cell")[:1], "centres": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})


def _assign(least: float):
    near, half = reach(least), math.cos(math.acos(least) / 2 - _ROUNDING) + _ROUNDING

    def assign(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        dim = len(rows.column("v")[0])
        x, c = matrix(rows.column("v"), dim), matrix(fitted.column("centres"), len(fitted.column("centres")[0])).reshape(-1, dim)
        s = x @ c.T
        own = s.argmax(axis=1)
        gap = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2)
        home = rows.column("home").to_numpy(zero_copy_only=False)
        # a visitor's partners are at home on either side, a home row meets those of earlier cells there
        goes = (s[np.arange(len(x)), own][:, None] - s) <= near * gap[own] + _ROUNDING
        goes &= (np.arange(len(c))[None, :] > own[:, None]) | ~home[:, None]
        goes[np.arange(len(x)), own] = True
        at, to = np.nonzero(goes)
        t = rows.take(pa.array(at))
        cell = pa.array([f"{a}.{b}" for a, b in zip(t.column("cell").to_pylist(), to.tolist())], pa.string())
        return pa.table({"cell": cell, "node": t.column("node"), "w": t.column("w"), "v": t.column("v"),
                         "home": pa.array(home[at] & (to == own[at])), "core": pa.array(s[at, to] >= half)})
    return assign


def _beside(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Values of a cell beside its rows; the rows of one cell are dealt to ``SALTS`` keys."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["cell", "_salt"]).drop("_salt")


def split(rows: DataFrame, least: float) -> DataFrame:
    """All rows, dealt from their cells to the cells of one k-means each."""
    sizes = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("n")).select(
        "cell", F.least(F.lit(CENTRES), F.ceil(F.col("homes") / CELL)).cast("int").alias("k"), F.ceil(F.col("n") / ASSIGNED).cast("int").alias("parts"))
    sizes = written(sizes, "sizes")
    order = W.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(SEED)), "node")
    sample = rows.where("home").select("cell", "node", "v").withColumn("i", F.row_number().over(order)).where(F.col("i") <= CENTRES * SAMPLED)
    # the whole sample of a cell is one bounded group
    fitted = written(sample.join(sizes.select("cell", "k"), "cell").where(F.col("i") <= F.col("k") * SAMPLED).groupBy("cell").applyInArrow(
        _fit, "cell string, centres array<double>"), "centres")
    parted = _beside(rows, sizes.select("cell", "parts")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    dealt = fitted.join(sizes.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return parted.select("cell", "part", "node", "w", "v", "home").groupBy("cell", "part").cogroup(
        dealt.select("cell", "part", "centres").groupBy("cell", "part")).applyInArrow(_assign(least), _ROWS)


def cells(of: DataFrame, least: float) -> DataFrame:
    """Rows of the final cells: ``cell, node, w, v, home, core``."""
    open_ = of.select(F.col("label").cast("string").alias("cell"), "node", "w", "v", F.lit(True).alias("home"))
    done = None
    for _ in range(SPLITS):
        rows = written(split(open_, least), "cells")
        # the core of a cell needs no splitting
        large = rows.groupBy("cell").agg(F.count_if(F.expr("home and not core")).alias("n")).where(F.col("n") > SPLIT).select("cell")
        kept = rows.join(large, "cell", "left_anti")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        done = kept if done is None else done.unionByName(kept)
        open_ = rows.join(large, "cell", "left_semi").drop("core")
    return done.unionByName(open_.withColumn("core", F.lit(False)))


def _grouped(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest position that each of ``n`` positions reaches over the links ``u, v``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _products(least: float):
    def products(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links between home rows and the rows beside them: ``node, links, root``."""
        none = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return none
        dim = len(left.column("v")[0])
        a, b = matrix(left.column("v"), dim), matrix(right.column("v"), dim)
        na, nb = left.column("node").to_numpy(), right.column("node").to_numpy()
        wa, wb = left.column("w").to_numpy(), right.column("w").to_numpy()
        back = right.column("back").to_numpy(zero_copy_only=False)
        ids, at = np.unique(np.concatenate([na, nb]), return_inverse=True)
        ia, ib = at[:len(na)], at[len(na):]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, len(a), 256):
            hit = (a[i:i + 256] @ b.T >= least) & (na[i:i + 256, None] != nb[None, :])
            r, c = np.nonzero(hit)
            np.add.at(links, ia[i + r], wb[c])
            np.add.at(links, ib[c], np.where(back[c], wa[i + r], 0))
            if len(r):  # one link a node stands for those found so far
                was = np.flatnonzero(root != np.arange(len(ids)))
                root = _grouped(np.concatenate([ia[i + r], was]), np.concatenate([ib[c], root[was]]), len(ids))
        some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"node": ids[some], "links": links[some], "root": ids[root[some]]})
    return products


def links(rows: DataFrame, least: float) -> DataFrame:
    """``node, links, root``: shares of each node's number of links, and a node that it is grouped with."""
    core, rest = F.col("core"), ~F.col("core")
    count = lambda c: F.count_if(c)
    home = F.col("home")
    parts = lambda n, size: F.ceil(n / size).cast("int")
    at = written(rows.groupBy("cell").agg(
        F.sum(F.when(home & core, F.col("w"))).alias("home_core"), F.sum(F.when(~home & core, F.col("w"))).alias("guest_core"), F.min(F.when(home & core, F.col("node"))).alias("root"),
        parts(count(home & rest), LEFT).alias("rests"), parts(count(home & core), LEFT).alias("cores"),
        parts(count(F.lit(True)), RIGHT).alias("all"), parts(count(~home & rest), RIGHT).alias("guests")), "cell_sizes")
    t = written(_beside(rows, at), "placed")
    near = t.where("core and root is not null").select("node", (F.when(F.col("home"), F.col("home_core") - F.col("w") + F.coalesce("guest_core", F.lit(0)))
                                                                .otherwise(F.col("home_core"))).alias("links"), "root")
    # rest of the home rows x all rows, then core of the home rows x rest of the visitors
    deal = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    keys = ["cell", "with_core", "i", "j"]

    def side(which, with_core: bool, own, other, salt: int, left: bool) -> DataFrame:
        i, j = ("i", "j") if left else ("j", "i")
        back = F.lit(True) if with_core else ~(F.col("home") & rest)  # rest x rest meets from either side
        return t.where(which).where(own > 0).select("cell", F.lit(with_core).alias("with_core"), deal(own, salt).alias(i), every(other).alias(j), "node", "w", "v", back.alias("back"))

    left = side(home & rest, False, F.col("rests"), F.col("all"), 2, True).unionByName(side(home & core, True, F.col("cores"), F.col("guests"), 2, True))
    right = side(F.lit(True), False, F.col("all"), F.col("rests"), 3, False).unionByName(side(~home & rest, True, F.col("guests"), F.col("cores"), 3, False))
    found = left.select(*keys, "node", "w", "v").groupBy(*keys).cogroup(right.select(*keys, "node", "w", "v", "back").groupBy(*keys)).applyInArrow(
        _products(least), "node long, links long, root long")
    return near.unionByName(found)


def near_duplicates(table: DataFrame, least: float = LEAST) -> DataFrame:
    """``vec_id, label, n_links, component_id, kept``: every row, its links, its group and whether it represents it."""
    t, n = nodes(table)
    found = written(links(cells(n, least), least), "links")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = (n.join(totals, "node", "left").join(roots, "node", "left")
              .select("node", "label", "h1", "h2", "id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    placed = written(placed, "placed")
    groups = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    known = placed.join(groups, "root").select("label", "h1", "h2", "n_links", "component_id")
    # copies of a hot vector are dealt to several keys
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = (t.select("vec_id", "label", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), "h2", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("_salt"))
            .join(salted, ["label", "h1", "h2", "_salt"], "left"))
    id_ = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), id_.alias("component_id"),
                       F.col("vec_id").eqNullSafe(id_).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(embeddings(spark, sf_dir)).select("vec_id", "n_links", "component_id", "kept")


#: Links by brute force and reachability, for DuckDB.
ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
unit AS (
  SELECT vec_id, label, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS u FROM usable
  WHERE list_sum([y * y FOR y IN v]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c ON c.a = e.vec_id
"""
