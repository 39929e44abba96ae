"""Vector tables as blocks: what the two searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

RESULT = "q_row long, vec_id long, score {}, c_row long"


def usable(v: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def prepared(table: DataFrame, component, extra: Column | None = None, every: int = 20) -> tuple[DataFrame, dict]:
    """Written rows ``row, vec_id, v, is_query`` with equally long vectors, and their statistics.

    ``row`` tells repeated rows apart; shorter vectors are filled up with zeros,
    which changes no inner product.
    """
    t = table.select("vec_id", F.col("embedding").alias("v")).where(usable(F.col("v")))
    t = t.withColumn("v", F.transform("v", component))
    if extra is not None:
        t = t.where(extra)
    t = written(t.withColumn("row", F.monotonically_increasing_id())
                .withColumn("is_query", F.coalesce(F.col("vec_id") % every == 0, F.lit(False))), "vectors")
    sq = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    s = t.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("queries"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"),
              F.coalesce(F.min(F.size("v")), F.lit(0)).alias("least"), F.coalesce(F.max(sq), F.lit(0.0)).alias("sq")).first().asDict()
    if s["least"] != s["dim"]:
        zero = F.lit(0).cast(t.schema["v"].dataType.elementType)
        t = t.withColumn("v", F.concat("v", F.array_repeat(zero, F.lit(s["dim"]) - F.size("v"))))
    return t, s


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as float64 rows."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return flat.astype(np.float64).reshape(len(column), dim)


def best(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of what the blocks found for each query row."""
    order = W.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c_row")
    names = queries.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(names, "q_row").select("query_id", "rank", "vec_id", "score"))


def top_of_block(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, q_row: int, k: int, least: float) -> tuple[np.ndarray, ...] | None:
    """Positions of the ``k`` best scores that reach ``least``; ``ids`` ascend, so ties fall to smaller ones."""
    at = np.flatnonzero((scores >= least) & (rows != q_row))
    if len(at) > k:
        s = scores[at]
        bar = np.partition(s, len(s) - k)[len(s) - k]
        at = at[s >= bar]
        at = at[np.argsort(-scores[at], kind="stable")][:k]
    return at
