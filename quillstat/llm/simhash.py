"""SimHash near-duplicates: segment popcounts as a lower bound of the bit distance.

A document's fingerprint is the bitwise majority of its word shingles' hashes.
Fingerprints are mapped to the bit counts of their 16 segments of 4 bits.  The
Manhattan distance of two such vectors never exceeds the bit distance, so
fingerprints that link lie within ``max_bits`` there.  The join runs over the
unit grid of the vectors: any two vectors within distance 2 have a grid point
within distance 1 of both, so every fingerprint is entered at its own point and
its neighbours, points are joined, and each pair is verified by its exact bit
distance.  Equal fingerprints are one node throughout.  Joins are shuffled: both
sides grow with the documents, and Spark sizes what comes from an explode or a
written table many times too low to broadcast it safely.

Defined results: a null or empty text has fingerprint 0 and links like any
other; fewer words than a shingle make one shingle of all of them; repeated
rows share their component; a component of null ids alone has a null id; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, written
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
_BLOCK = 1 << 14
#: Working column beside a table's own columns.
_PRINT = "__simhash_print"


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit majority fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = words[i:i + _BLOCK + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [part]
        h = np.array([xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str], shingle: int = SHINGLE_WORDS, name: str = _PRINT) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the fingerprint of ``text``."""
    src = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("_bytes"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in b.column("_bytes")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), fp], names=[*keep, name])

    return src.mapInArrow(prints, docs.select(*keep).withColumn(name, F.lit(0).cast("long")).schema)


def segment_popcounts(fp: Column) -> Column:
    """Bit counts of the 16 segments, one in each 4 bits of a long."""
    def half(x: Column) -> Column:  # 32 bits at a time, so that no sum reaches the sign bit
        pairs = x.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))
        return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x33333333))

    low = F.lit(0xFFFFFFFF)
    return F.shiftleft(half(F.shiftrightunsigned(fp, 32).bitwiseAND(low)), 32).bitwiseOR(half(fp.bitwiseAND(low)))


def grid_points(counts: Column) -> Column:
    """The vector's own grid point and its neighbours at Manhattan distance 1."""
    points = [counts]
    for i in range(16):
        c = F.shiftrightunsigned(counts, 4 * i).bitwiseAND(F.lit(15))
        one = F.shiftleft(F.lit(1).cast("long"), 4 * i)
        points += [F.when(c > 0, counts - one), F.when(c < 4, counts + one)]
    return F.filter(F.array(*points), lambda x: x.isNotNull())


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``u, v``: pairs of distinct fingerprints (column ``_fp``) at most ``max_bits`` (0 to 2) apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("neighbours at distance 1 cover bit distances up to 2")
    at = fps.select("_fp", F.explode(grid_points(segment_popcounts(F.col("_fp")))).alias("point"))
    a, b = at.select("point", F.col("_fp").alias("u")), at.select("point", F.col("_fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return a.join(b.hint("merge"), "point").where(near).select("u", "v").distinct()


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``_fp, component_id, keep_fp``: the component of each fingerprint of ``prints`` (``doc_id, _fp``).

    ``component_id`` is the smallest id in the component, ``keep_fp`` the
    fingerprint of the document that has it.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_fp")))
    nodes = written(prints.groupBy("_fp").agg(first.alias("first")), "fingerprints")
    roots = components(links(nodes, max_bits))
    placed = nodes.join(roots.hint("merge"), nodes["_fp"] == roots["node"], "left").select("_fp", "first", F.coalesce("root", "_fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("f"))
    return written(placed.join(firsts.hint("merge"), "root").select("_fp", F.col("f.doc_id").alias("component_id"), F.col("f._fp").alias("keep_fp")), "groups")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    prints = written(with_fingerprint(docs, ["doc_id"], shingle, "_fp"), "prints")
    return prints.join(groups(prints, max_bits).hint("merge"), "_fp").select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id``."""
    prints = written(with_fingerprint(docs, docs.columns, shingle), "printed")
    keep = groups(prints.select("doc_id", F.col(_PRINT).alias("_fp")), max_bits).where("_fp = keep_fp").select(
        F.col("component_id").alias("__id"), F.col("_fp").alias("__of"))
    again = W.partitionBy("doc_id", _PRINT).orderBy(F.lit(0))
    return (prints.join(keep.hint("merge"), (prints[_PRINT] == keep["__of"]) & prints["doc_id"].eqNullSafe(keep["__id"]), "left_semi")
            .withColumn("__again", F.row_number().over(again)).where("__again = 1").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
