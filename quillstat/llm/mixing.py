"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source gets a target in words.  The rates of its documents are the
closest ones to 1 in relative entropy that meet the target without passing
``MOST`` copies: ``min(MOST, exp(lambda * size / mean size))``, one multiplier
per source.  Distributed Newton iterations on the convex dual find the
multipliers; each reads only the counts per (source, size).  The rates are then
rounded to whole copies: systematic rounding along falling sizes within a
source, and small documents take up what is left to the target.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are kept once and take nothing; repeated
rows count as rows of their own; which of several documents of one source and
size get the odd copy is decided by a hash of ``doc_id``, so reruns agree.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, written

#: Weights of the sources in code point order, repeating.  Fixed values of the contract.
WEIGHTS = (3, 1, 2)
#: Words of the whole mix as a share of all words.
SHARE = 1.5
#: Most copies of a document, and most of a source's target over its size.
MOST = 2
#: Documents of one source and size that are ranked together; larger groups are split.
RANKED_TOGETHER = 256
#: Newton steps between two materialised states, and the gap at which they stop.
STEPS, GAP = 4, 1e-7


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(cells: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``_src, source_size, target, docs`` per source.

    The words are shared by weight; a source stops at ``most`` times its size
    and what it leaves is shared again.  The level at which that ends is found
    in one pass over the sources in order of size per weight.
    """
    s = cells.groupBy("_src", "_named").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"),
                                            F.sum(F.when(F.col("_size") > 0, F.col("_n")).otherwise(0)).alias("docs"))
    k = F.row_number().over(W.orderBy(F.desc("_named"), "_src"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((k - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), "_src")
    all_ = W.partitionBy()
    s = (s.withColumn("rn", F.row_number().over(order))
         .withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("rest", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
         .withColumn("level", (F.lit(share) * F.sum("source_size").over(all_) - F.col("full")) / F.col("rest")))
    s = s.withColumn("level", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("rn", "level"))).over(all_)["level"])
    return s.select("_src", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"), "docs")


def _rate(lam: Column, most: int) -> Column:
    return F.exp(F.least(lam * F.col("_z"), F.lit(math.log(most))))


def multipliers(cells: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``_src, lam`` for each source whose target lies between 0 and ``most`` times its size.

    Newton's method on the dual, kept inside a bracket that every step narrows:
    a step that would leave it becomes a bisection.
    """
    cells = cells.where("_size > 0")
    limits = cells.groupBy("_src").agg(F.min("_size").alias("least"))
    state = (targets.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))).join(limits, "_src")
             .withColumn("mean", F.col("source_size") / F.col("docs"))
             .select("_src", "target", "mean", F.log(F.col("target") / F.col("source_size")).alias("lam"),
                     (-700.0 * F.col("mean") / F.col("least")).alias("lo"), (1.0 * F.col("mean") / F.col("least")).alias("hi"),
                     F.lit(math.inf).alias("gap")))
    state = written(state, "multipliers")
    while not state.where(F.col("gap") > GAP).isEmpty():
        for _ in range(STEPS):
            at = cells.join(state, "_src").withColumn("_z", F.col("_size") / F.col("mean")).withColumn("r", _rate(F.col("lam"), most))
            mass = F.col("_n") * F.col("_size") * F.col("r")
            at = at.groupBy("_src", "target", "mean", "lam", "lo", "hi").agg(
                (F.sum(mass) - F.col("target")).alias("f"),
                F.sum(F.when(F.col("r") < most, mass * F.col("_z")).otherwise(0.0)).alias("df"))
            at = (at.withColumn("lo", F.when(F.col("f") < 0, F.col("lam")).otherwise(F.col("lo")))
                  .withColumn("hi", F.when(F.col("f") > 0, F.col("lam")).otherwise(F.col("hi")))
                  .withColumn("next", F.when(F.col("df") > 0, F.col("lam") - F.col("f") / F.col("df")))
                  .withColumn("width", (F.col("hi") - F.col("lo")) / F.greatest(F.lit(1.0), F.abs(F.col("lam")))))
            done = F.abs(F.col("f")) <= GAP * F.col("target")
            state = at.select(
                "_src", "target", "mean",
                F.when(done, F.col("lam")).when((F.col("next") > F.col("lo")) & (F.col("next") < F.col("hi")), F.col("next"))
                .otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "lo", "hi",
                F.when(done | (F.col("width") < 1e-12), 0.0).otherwise(F.abs(F.col("f")) / F.col("target")).alias("gap"))
        state = written(state, "multipliers")
    return state.select("_src", "lam", "mean")


def cell_copies(cells: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``_src, _size, _n, source_size, target, _copies``: whole copies for all documents of a source and size together."""
    lam = multipliers(cells, targets, most)
    c = (cells.join(targets, "_src").join(lam, "_src", "left")
         .withColumn("_z", F.col("_size") / F.col("mean"))
         .withColumn("x", F.col("_n") * F.when(F.col("_size") == 0, 1.0).when(F.col("lam").isNull(), float(most)).otherwise(_rate(F.col("lam"), most)))
         .select("_src", "_size", "_n", "source_size", "target", "x"))
    falling = W.partitionBy("_src").orderBy(F.desc("_size"))
    before = falling.rowsBetween(W.unboundedPreceding, -1)
    upto = F.sum("x").over(falling.rowsBetween(W.unboundedPreceding, W.currentRow))
    c = c.withColumn("_copies", (F.floor(upto + 0.5) - F.floor(F.coalesce(F.sum("x").over(before), F.lit(0.0)) + 0.5)).cast("long"))
    c = c.withColumn("_copies", F.when(F.col("_size") == 0, F.col("_n")).otherwise(F.greatest(F.lit(0), F.least(F.col("_copies"), most * F.col("_n")))))
    whole = W.partitionBy("_src")
    for _ in range(4):  # what is left shrinks below the size of the last document changed
        c = c.withColumn("left", F.round(F.col("target")).cast("long") - F.sum(F.col("_copies") * F.col("_size")).over(whole))
        fits = (F.col("_size") > 0) & (F.col("_size") <= F.abs("left"))
        room = F.when(fits, F.when(F.col("left") > 0, most * F.col("_n") - F.col("_copies")).otherwise(F.col("_copies"))).otherwise(F.lit(0))
        c = c.withColumn("room", room.cast("long"))
        spent = F.coalesce(F.sum(F.col("room") * F.col("_size")).over(before), F.lit(0))
        take = F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("left") - spent) / F.greatest(F.col("_size"), F.lit(1)))))
        c = c.withColumn("_copies", (F.col("_copies") + F.signum("left").cast("long") * take).cast("long"))
    return c.select("_src", "_size", "_n", "source_size", "target", "_copies")


def mixed(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``docs`` with ``_size, source_size, target, _times``: whole copies of each row.

    ``docs`` needs ``doc_id``, ``_source`` and ``_size``; all its columns are carried.
    """
    d = docs.withColumn("_named", F.col("_source").isNotNull()).withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")))
    cells = written(d.groupBy("_src", "_named", "_size").agg(F.count(F.lit(1)).alias("_n")), "cells")
    plan = written(cell_copies(cells, source_targets(cells, most=most), most), "copies")
    d = (d.join(plan, ["_src", "_size"])
         .withColumn("_h", F.xxhash64("doc_id"))
         .withColumn("_b", F.pmod("_h", F.ceil(F.col("_n") / RANKED_TOGETHER).cast("long"))))
    large = (docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")).alias("_src"), "_size")
             .join(plan.where(F.col("_n") > RANKED_TOGETHER).select("_src", "_size", "_n"), ["_src", "_size"])
             .withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_n") / RANKED_TOGETHER).cast("long")))
             .groupBy("_src", "_size", "_b").agg(F.count(F.lit(1)).alias("in_b")))
    offsets = large.withColumn("_before", F.sum("in_b").over(W.partitionBy("_src", "_size").orderBy("_b")) - F.col("in_b")).drop("in_b")
    d = (d.withColumn("_k", F.row_number().over(W.partitionBy("_src", "_size", "_b").orderBy("_h", "doc_id")))
         .join(offsets, ["_src", "_size", "_b"], "left"))
    rank = F.coalesce("_before", F.lit(0)) + F.col("_k")
    odd = (rank <= F.col("_copies") % F.col("_n")).cast("long")
    return (d.withColumn("_times", F.floor(F.col("_copies") / F.col("_n")).cast("long") + odd)
            .drop("_named", "_src", "_n", "_copies", "_h", "_b", "_k", "_before"))


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with its own columns."""
    cols = [F.col(c) for c in docs.columns]
    d = docs.select(F.struct(*cols).alias("_row"), F.col("doc_id"), F.col("source").cast("string").alias("_source"),
                    word_count(F.col("text")).alias("_size"))
    return (mixed(d, most).where("_times > 0")
            .withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = written(documents(spark, sf_dir).select("doc_id", F.col("source").cast("string").alias("_source"),
                                                   word_count(F.col("text")).alias("_size")), "sizes")
    return mixed(base).select("doc_id", F.col("_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"),
                              (F.col("_times") * F.col("_size")).alias("taken"))
