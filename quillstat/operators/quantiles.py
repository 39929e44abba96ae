"""Exact quantiles per group by radix selection: no group's values meet in one buffer.

Rows are first counted per (group, column, value).  The wanted ranks then
descend the values' binary digits, ``DIGIT_BITS`` at a time: a pass counts the
next digit below each prefix that a rank has reached (partially aggregated, at
most 2^DIGIT_BITS counts a prefix) and every rank takes the digit that holds it.
Leading digits that all values share take no pass, so counts and scores, which
are small, need one or two.

Interpolation is linear between the two neighbouring ranks, as ``percentile``
and ``quantile_cont`` do it.  Nulls take no part; NaN is the largest value; a
group without values has null quantiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

DIGIT_BITS = 16
_LOW = -(1 << 63)


def value_cells(df: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """``by..., which, value, n``: how often each value of each column occurs in each group."""
    kind = T.LongType()
    for c in columns.values():
        if not isinstance(df.select(c).schema[0].dataType, T.IntegralType):
            kind = T.DoubleType()
    pairs = F.array(*[F.struct(F.lit(name).alias("which"), c.cast(kind).alias("value")) for name, c in columns.items()])
    return (df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.which", "_p.value").filter("value is not null")
            .groupBy(*by, "which", "value").agg(F.count(F.lit(1)).cast("long").alias("n")))


def _with_key(cells: DataFrame) -> DataFrame:
    """``key``: longs in the order of ``value``."""
    if isinstance(cells.schema["value"].dataType, T.IntegralType):
        return cells.withColumn("key", F.col("value").cast("long"))

    def keys(batches):
        for b in batches:
            bits = (b.column("value").to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
            key = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], names=[*b.schema.names, "key"])

    return cells.mapInArrow(keys, T.StructType([*cells.schema.fields, T.StructField("key", T.LongType())]))


def _shifted(c: Column, bits: int) -> Column:
    return F.lit(0).cast("long") if bits >= 64 else F.shiftrightunsigned(c, bits)


def values_at(cells: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """``targets`` (``by..., which, target, rank``; rank from 0) with ``value``: the value at that rank.

    ``cells`` are read several times, so they should be materialised."""
    keyed = _with_key(cells)
    cells = keyed if isinstance(cells.schema["value"].dataType, T.IntegralType) else cut_lineage(keyed)
    low, high = cells.agg(F.min("key"), F.max("key")).first()
    span = 0 if low is None else high - low
    if span < 1 << 62:
        u, bits = F.col("key") - F.lit(low if low is not None else 0).cast("long"), max(1, span.bit_length())
    else:  # the whole range, as unsigned numbers
        u, bits = F.col("key").bitwiseXOR(F.lit(_LOW)), 64
    cells = cells.withColumn("_u", u)
    group = [*by, "which"]
    mask = F.lit((1 << DIGIT_BITS) - 1).cast("long")
    at = targets.withColumn("_prefix", F.lit(0).cast("long"))
    for shift in range(-(-bits // DIGIT_BITS) * DIGIT_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        t = cells.withColumn("_prefix", _shifted(F.col("_u"), shift + DIGIT_BITS)).withColumn("_digit", _shifted(F.col("_u"), shift).bitwiseAND(mask))
        if shift + DIGIT_BITS < bits:
            at = cut_lineage(at)
            t = t.join(at.select(*group, "_prefix").distinct(), [*group, "_prefix"], "left_semi")
        counts = t.groupBy(*group, "_prefix", "_digit").agg(F.sum("n").alias("_n"), F.min("value").alias("value"))
        w = Window.partitionBy(*group, "_prefix").orderBy("_digit")
        counts = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
        held = (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))
        at = at.drop("value").join(counts, [*group, "_prefix"]).filter(held).select(
            *group, "target", (F.col("rank") - F.col("_before")).alias("rank"),
            F.shiftleft("_prefix", DIGIT_BITS).bitwiseOR(F.col("_digit")).alias("_prefix"), "value")
    return at.select(*group, "target", "value")


def quantiles_of_cells(cells: DataFrame, by: list[str], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """``by...`` and one double column per entry ``name: (which, p)``, from the rows of ``value_cells``."""
    cells = cut_lineage(cells)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(which).alias("of"), F.lit(float(p)).alias("p")) for name, (which, p) in quantiles.items()])
    totals = cells.groupBy(*by, "which").agg(F.sum("n").alias("_all")).select("*", F.explode(wanted).alias("_w")).filter("which = _w.of")
    place = (F.col("_all") - 1) * F.col("_w.p")
    totals = totals.select(*by, "which", "_w.name", place.alias("_place"), F.explode(F.array(
        F.struct(F.lit("lo").alias("end"), F.floor(place).cast("long").alias("rank")),
        F.struct(F.lit("hi").alias("end"), F.ceil(place).cast("long").alias("rank")))).alias("_e"))
    targets = totals.select(*by, "which", F.struct("name", "_place", "_e.end").alias("target"), "_e.rank")
    found = values_at(cells, by, targets).select(*by, "target.*", F.col("value").cast("double").alias("value"))
    two = found.groupBy(*by, "name", "_place").agg(
        F.max(F.when(F.col("end") == "lo", F.col("value"))).alias("lo"), F.max(F.when(F.col("end") == "hi", F.col("value"))).alias("hi"))
    part = F.col("_place") - F.floor("_place")
    exact = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - part) + F.col("hi") * part)
    return two.select(*by, "name", exact.alias("value")).groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles])


def exact_quantiles(df: DataFrame, by: list[str], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per group of ``df`` that has values: ``name: (column, p)`` gives the exact ``p``-quantile of a column."""
    columns = {c: F.col(c) for c, _ in quantiles.values()}
    return quantiles_of_cells(value_cells(df, by, columns), by, quantiles)
