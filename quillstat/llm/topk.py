"""Exact top-k by inner product with a pivot-distance index.

Largest inner products are nearest neighbours once every vector gets one more
component that brings it to the largest norm.  There, each vector is keyed by
its nearest pivot and its distance to it; the distances of one pivot are cut
into sorted annuli, and annuli into blocks of bounded size.  A query first
searches a block of the annulus nearest to it, which bounds the distance of its
k-th neighbour.  The triangle inequality then tells which annuli can hold
anything nearer; only their blocks are searched, and results are merged.

All scores are exact integers.  Bounds are widened by a relative 1e-6, so
rounding never leaves an annulus out.

Defined results: vectors that are null or hold null or non-finite components
take no part; repeated rows are rows of their own; a query does not find its
own row; ties go to the smaller id (null ids last); shorter vectors count as
filled with zeros; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import embeddings, written
from .vectors import best, matrix, prepared, top_of_block

K, EVERY, SCALE = 20, 20, 64
#: Vectors of a block, queries of a block, most pivots, annuli per pivot.
BLOCK, QUERY_BLOCK, PIVOTS, ANNULI = 4096, 8192, 64, 4
_EXACT = 2.0 ** 53


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that brings their norm to ``top``."""
    rest = np.maximum(0.0, top * top - np.einsum("ij,ij->i", x, x))
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def keyed(vectors: DataFrame, pivots: np.ndarray, dim: int, top: float) -> DataFrame:
    """``vectors`` with the nearest pivot and the distance to it."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            d = _distances(_lifted(matrix(t.column("v"), dim), top), held.value)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near], pa.float64())],
                                             names=[*b.schema.names, "pivot", "d"])

    return vectors.mapInArrow(key, vectors.withColumns({"pivot": F.lit(0), "d": F.lit(0.0)}).schema)


def annuli(keyed_: DataFrame) -> DataFrame:
    """``keyed_`` with ``annulus``: the place of ``d`` among the quantiles of its pivot's distances."""
    cuts = [i / ANNULI for i in range(1, ANNULI)]
    edges = keyed_.groupBy("pivot").agg(F.percentile_approx("d", cuts, 1000).alias("edges"))
    edges = {r["pivot"]: r["edges"] for r in edges.collect()}  # PIVOTS rows
    table = F.create_map(*[x for p, e in edges.items() for x in (F.lit(p), F.array(*[F.lit(v) for v in e]))]) if edges else F.lit(None).cast("map<int,array<double>>")
    return keyed_.withColumn("annulus", F.size(F.filter(F.element_at(table, F.col("pivot")), lambda e: e < F.col("d"))))


def _search(dim: int, k: int, exact: bool):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """Vectors of a block against the queries sent to it."""
        order = np.argsort(left.column("vec_id").fill_null(2 ** 63 - 1).to_numpy(), kind="stable")
        ids, rows = left.column("vec_id").take(pa.array(order)).combine_chunks(), left.column("row").to_numpy()[order]
        x, q = matrix(left.column("v"), dim)[order], matrix(right.column("v"), dim)
        if not exact:
            x, q = x.astype(np.int64), q.astype(np.int64)
        q_rows, least = right.column("row").to_numpy(), right.column("least").to_numpy()
        out_q, out_at, out_s = [], [], []
        for i in range(0, len(q), 256):
            scores = q[i:i + 256] @ x.T
            for j, s in enumerate(scores):
                at = top_of_block(s, ids, rows, q_rows[i + j], k, least[i + j])
                out_q.append(np.full(len(at), q_rows[i + j]))
                out_at.append(at)
                out_s.append(s[at])
        at = np.concatenate(out_at) if out_at else np.zeros(0, np.int64)
        cat = lambda a: np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64)
        return pa.table({"q_row": cat(out_q), "vec_id": ids.take(pa.array(at)), "score": cat(out_s), "c_row": rows[at]})
    return search


def _searched(vectors: DataFrame, asked: DataFrame, q_parts: int, dim: int, k: int, exact: bool) -> DataFrame:
    """Search ``asked`` (``cell, part, q_part, row, v, least``) in the blocks of ``vectors`` (``cell, part, row, vec_id, v``)."""
    spread = vectors.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    keys = ["cell", "part", "q_part"]
    return (spread.select(*keys, "row", "vec_id", "v").groupBy(*keys)
            .cogroup(asked.select(*keys, "row", "v", "least").groupBy(*keys))
            .applyInArrow(_search(dim, k, exact), "q_row long, vec_id long, score long, c_row long"))


def top_k(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose ``vec_id`` is divisible by ``every``."""
    spark = table.sparkSession
    base, s = prepared(table, lambda x: F.floor(x.cast("double") * scale), every=every)
    dim, top, exact = s["dim"], math.sqrt(s["sq"]), s["sq"] < _EXACT
    n_pivots = max(1, min(PIVOTS, s["n"] // (ANNULI * BLOCK)))
    chosen = base.orderBy(F.xxhash64("row"), "row").limit(n_pivots).collect()
    raw = np.array([r["v"] for r in chosen], dtype=np.float64).reshape(len(chosen), dim)
    pivots = _lifted(raw, top) if len(raw) else np.zeros((1, dim + 1))
    vectors = annuli(written(keyed(base, pivots, dim, top), "keyed")).withColumn("cell", F.col("pivot") * (ANNULI + 1) + F.col("annulus"))
    cells = vectors.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    parts = {r["cell"]: -(-r["n"] // BLOCK) for r in cells}  # at most PIVOTS * ANNULI cells
    part_of = F.element_at(F.create_map(*[F.lit(x) for cp in parts.items() for x in cp]), F.col("cell")) if parts else F.lit(1)
    vectors = written(vectors.withColumn("part", F.pmod(F.xxhash64("row"), part_of).cast("int")), "blocks")
    queries = vectors.where("is_query")
    q_parts = max(1, -(-s["queries"] // QUERY_BLOCK))
    queries = queries.withColumn("q_part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(q_parts)).cast("int"))

    first = written(_searched(vectors, queries.withColumn("least", F.lit(-math.inf)), q_parts, dim, k, exact), "first")
    kth = (first.groupBy("q_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
           .select(F.col("q_row").alias("row"), F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(-math.inf).alias("least")))
    asked = queries.select("row", "v", "q_part", F.col("cell").alias("home"), F.col("part").alias("home_part")).join(kth, "row", "left") \
        .withColumn("least", F.coalesce("least", F.lit(-math.inf)))
    order = sorted(cells, key=lambda r: r["cell"])
    held = spark.sparkContext.broadcast((pivots, np.array([[r["cell"], r["pivot"], r["lo"], r["hi"], parts[r["cell"]]] for r in order]).reshape(-1, 5)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block that the triangle inequality leaves to a query."""
        pivots_, table_ = held.value
        for b in batches:
            q = matrix(pa.Table.from_batches([b]).column("v"), dim)
            own = np.einsum("ij,ij->i", q, q)
            flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)  # a query has no lifted component
            to_pivot = _distances(flat, pivots_)
            reach = np.sqrt(np.maximum(0.0, own + top * top - 2 * b.column("least").to_numpy()))  # infinite without a k-th score
            reach = reach + 1e-6 * (1 + np.where(np.isfinite(reach), reach, 0))
            near = to_pivot[:, table_[:, 1].astype(int)]
            gap = np.maximum(0.0, np.maximum(near - table_[:, 3], table_[:, 2] - near))
            at_q, at_c = np.nonzero(gap <= reach[:, None])
            n = table_[at_c, 4].astype(int)
            at_q, cell = np.repeat(at_q, n), np.repeat(table_[at_c, 0].astype(int), n)
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            new = (cell != b.column("home").to_numpy()[at_q]) | (part != b.column("home_part").to_numpy()[at_q])
            at_q, cell, part = at_q[new], cell[new], part[new]
            took = b.take(pa.array(at_q))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), took.column("q_part"), took.column("row"),
                                              took.column("v"), took.column("least")], names=["cell", "part", "q_part", "row", "v", "least"])

    asked = asked.mapInArrow(route, "cell int, part int, q_part int, row long, v array<long>, least double")
    rest = _searched(vectors, asked, q_parts, dim, k, exact)
    return best(first.unionByName(rest), queries, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(embeddings(spark, sf_dir))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, a.r AS ar, b.vec_id, b.r AS br,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) AS rank FROM s) WHERE rank <= {K}
"""
