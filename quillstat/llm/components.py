"""Connected components of a link table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Salts of a join on a node: the links of a hub are dealt to as many keys.
SALTS = 16


def _beside(links: DataFrame, table: DataFrame) -> DataFrame:
    """``links`` with the row of ``table`` (one a node ``u``) of their node."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["u", "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """``u, v`` links -> ``node, root``: every linked node but the roots, with the smallest node it reaches.

    Alternates two contractions: every larger neighbour of a node moves to the
    smallest one, then every smaller one does.  Chains halve, so rounds grow
    with the logarithm of the longest one; a round ends at written tables, and
    the rounds end when the links no longer change.  Joins are shuffled: the links
    of a round are held in far fewer bytes than a broadcast of them takes.
    """
    e = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def state(t):
        return t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    now = state(e)
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _beside(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _beside(large, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = written(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        before, now = now, state(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
