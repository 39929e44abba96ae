"""Approximate nearest neighbours by collision counting over single projections.

Vectors get one more component that brings them to the largest norm, so the
largest inner products are the nearest vectors.  Rows are dealt to blocks of
bounded size.  A block holds many random projections, each sorted and cut into
pages of equal numbers of rows.  A query reads only the projections on which it
lies farthest from the block's mean, as these tell most about nearness.  A
window around its own projection grows on each (virtual rehashing: the
half-width rises by a factor), a row in one of the window's pages collides, and
a vector that collides on enough projections is verified by its exact inner
product.  The windows stop when the ``k`` best verified vectors would collide on
more than the share that is asked for.  Every row is indexed, every block is
searched, and the blocks' results are merged.

Recall of the 20 nearest against brute force: see ``tests/llm/test_search.py``
and the README.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part; repeated rows are rows of their own; a query does not
find its own row; ties go to the smaller id (null ids last); shorter vectors
count as filled with zeros; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import embeddings
from .vectors import best, matrix, prepared

K, EVERY = 20, 20
#: Vectors of a block; queries of a block and their components at most.
BLOCK, QUERY_BLOCK, QUERY_CELLS = 16_384, 32_768, 2 ** 22
#: Projections, how many of them a query reads, and on how many of these a candidate collides.
PROJECTIONS, READ, COLLISIONS = 256, 24, 12
#: Pages of a projection (their numbers are bytes).
PAGES = 256
#: First half-width of a window as a share of the query's distance from the mean, its growth,
#: and the chance of a collision that the ``k`` best must have when the windows stop.
FIRST, GROWTH, CHANCE = 0.2, 1.15, 0.66
#: Vectors of a block that a query verifies at least: smaller blocks are searched whole, as chances tell little there.
LEAST = 512
SEED = 20
_ROOT2 = math.sqrt(2)


class Index:
    """Pages of one block's projections."""

    def __init__(self, x: np.ndarray, top: float):
        self.x, self.top = x, top
        self.axes = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, PROJECTIONS))
        lift = np.sqrt(np.maximum(0.0, top * top - np.einsum("ij,ij->i", x, x))) / top
        self.mean = np.append(x.mean(axis=0) / top, lift.mean())
        self.to_mean = x @ self.mean[:-1] / top + lift * self.mean[-1]
        first = np.arange(1, PAGES) * len(x) // PAGES
        self.edges, self.pages = np.empty((PROJECTIONS, PAGES - 1)), np.empty((PROJECTIONS, len(x)), np.uint8)
        for j, axis in enumerate(self.axes.T):
            p = x @ axis[:-1] / top + lift * axis[-1]
            self.edges[j] = np.sort(p)[first]
            self.pages[j] = np.searchsorted(self.edges[j], p, "right")

    def _collisions(self, read: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, bool]:
        """On how many of the projections ``read`` each row's page lies in the window; whether the windows hold the whole block."""
        count, page, hit = (np.zeros(len(self.x), np.uint8) for _ in range(3))
        edges = self.edges[read]
        first, last = (edges <= lo[:, None]).sum(axis=1), (edges <= hi[:, None]).sum(axis=1)
        for j, a, n in zip(read.tolist(), first.astype(np.uint8), (last - first).astype(np.uint8)):
            np.subtract(self.pages[j], a, out=page)  # pages before the window wrap round
            np.less_equal(page, n, out=hit.view(bool))
            np.add(count, hit, out=count)
        return count, bool((last - first == PAGES - 1).all())

    def search(self, q: np.ndarray, own: np.ndarray, k: int):
        """For each query: positions of verified vectors and their inner products; ``own`` is the query's position here or -1."""
        norm = np.sqrt(np.einsum("ij,ij->i", q, q))
        unit = q / norm[:, None]
        at = unit @ self.axes[:-1]  # a query has no lifted component
        off = at - self.mean @ self.axes
        reads = np.argsort(-np.abs(off), axis=1, kind="stable")[:, :READ]
        q_mean, mean_sq = unit @ self.mean[:-1], self.mean @ self.mean
        level, back = 0, 1
        for i in range(len(q)):
            read = reads[i]
            mid, far = at[i, read], np.maximum(np.abs(off[i, read]), 1e-9)
            strength, q_sq = far.mean(), max(1 - 2 * q_mean[i] + mean_sq, 1e-18)
            checked = np.zeros(len(self.x), bool)
            if own[i] >= 0:
                checked[own[i]] = True
            found, score = np.zeros(0, np.int64), np.zeros(0)
            # the queries before tell where to start; a first window that was too wide doubles the step back
            level = start = max(0, level - back)
            while True:
                t = FIRST * GROWTH ** level
                count, whole = self._collisions(read, mid - t * far, mid + t * far)
                new = np.flatnonzero((count >= COLLISIONS) & ~checked)
                checked[new] = True
                found, score = np.concatenate([found, new]), np.concatenate([score, self.x.take(new, axis=0) @ q[i]])
                if whole or checked.all():
                    break
                if len(score) >= max(k, LEAST):
                    top_k = np.argpartition(score, len(score) - k)[len(score) - k:]
                    near = score[top_k] / (norm[i] * self.top)
                    # as seen from the mean: how far the farthest of the k falls short of the query, and off its line
                    short = 1 - ((near - self.to_mean[found[top_k]] - q_mean[i] + mean_sq) / q_sq).min()
                    aside = math.sqrt(max(2 - 2 * near.min() - short * short * q_sq, 1e-18))
                    if math.erf((t - short) * strength / aside / _ROOT2) + math.erf((t + short) * strength / aside / _ROOT2) >= 2 * CHANCE:
                        break
                level += 1
            back = 2 * back if level == start else 1
            yield found, score


def _best(found: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to earlier positions of the block."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((found[at], -score[at]))[:k]]


def _search(dim: int, top: float, k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column("vec_id").fill_null(2 ** 63 - 1).to_numpy(), kind="stable")
        ids, rows = left.column("vec_id").take(pa.array(order)).combine_chunks(), left.column("row").to_numpy()[order]
        right = right.sort_by("row")
        x, q, q_rows = matrix(left.column("v"), dim)[order], matrix(right.column("v"), dim), right.column("row").to_numpy()
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if len(x) and len(q):
            place = {r: i for i, r in enumerate(rows.tolist())}
            index = Index(x, top)
            for i in range(0, len(q), 512):
                own = np.array([place.get(r, -1) for r in q_rows[i:i + 512].tolist()])
                for j, (found, score) in enumerate(index.search(q[i:i + 512], own, k)):
                    pick = _best(found, score, k)
                    out.append((np.full(len(pick), q_rows[i + j]), found[pick], score[pick]))
        q_row, at, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"q_row": q_row.astype(np.int64), "vec_id": ids.take(pa.array(at)), "score": score, "c_row": rows[at]})
    return search


def nearest(table: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose ``vec_id`` is divisible by ``every``."""
    nonzero = F.exists("v", lambda x: x != 0)
    base, s = prepared(table, lambda x: x.cast("double"), extra=nonzero, every=every)
    q_block = max(1, min(QUERY_BLOCK, QUERY_CELLS // max(1, s["dim"])))
    blocks, q_parts = max(1, -(-s["n"] // BLOCK)), max(1, -(-s["queries"] // q_block))
    queries = base.where("is_query")
    keys = ["block", "q_part"]
    left = (base.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
            .withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)))).select(*keys, "row", "vec_id", "v"))
    right = (queries.withColumn("q_part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(q_parts)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select(*keys, "row", "v"))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _search(s["dim"], math.sqrt(s["sq"]) or 1.0, k), "q_row long, vec_id long, score double, c_row long")
    return best(found, queries, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(embeddings(spark, sf_dir))
