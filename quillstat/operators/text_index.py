"""FLT11 / FLT12 at scale: a stored trigram index for case-insensitive substring search.

Every text is entered once under each of its distinct 3-grams.  Postings lie in
buckets of their gram, sorted by it, so a search opens a few buckets and skips
the row groups of other grams.  A search takes the rarest grams of what is
looked for, keeps the texts that have all of them, and verifies those texts
alone; so its results are those of ``contains``.  Shorter strings than a gram
are looked for in all texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
BUCKETS = 64
#: Grams that a search intersects, the rarest of its string.
INTERSECTED = 6
#: Tasks that write one bucket.
WRITERS = 8


def grams(text):
    """Distinct runs of three characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _bucket(c: str):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def build(df: DataFrame, path: str, key: list[str], text: str) -> TextIndex:
    """Store the index of ``text`` at ``path``; null texts match nothing and are left out.  Searches return ``key`` columns."""
    spark, path = df.sparkSession, path.rstrip("/")
    docs = df.filter(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("doc"), *key, F.lower(text).alias("_text"))
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    postings = docs.select("doc", F.explode(grams(F.col("_text"))).alias("gram")).withColumn("bucket", _bucket("gram"))
    # a bucket is dealt to several writers by text, so a frequent gram doesn't meet in one task
    (postings.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(WRITERS))).sortWithinPartitions("bucket", "gram", "doc")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings"))
    counts = spark.read.schema("gram string, bucket int").parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.withColumn("bucket", _bucket("gram")).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    return TextIndex(spark, path, key)


class TextIndex:
    """A stored index; ``key`` are the columns that searches return."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _of(self, what: str, schema: str, wanted: list[str]) -> DataFrame:
        ids = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket("gram").alias("b")).distinct()
        buckets = [r["b"] for r in ids.collect()]
        return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{what}").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))

    def postings(self, wanted: list[str]) -> DataFrame:
        """Postings of some grams: only their buckets are opened."""
        return self._of("postings", "doc long, gram string", wanted)

    def candidates(self, q: str) -> DataFrame | None:
        """``doc`` of the texts that hold the rarest grams of ``q`` (lower case); None where ``q`` has no gram."""
        wanted = sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})
        if not wanted:
            return None
        known = self._of("grams", "gram string, n long", wanted)
        if known.count() < len(wanted):
            return self.spark.createDataFrame([], "doc long")
        rare = [r["gram"] for r in known.orderBy("n", "gram").limit(INTERSECTED).collect()]
        return self.postings(rare).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare)).select("doc")

    def search(self, q: str) -> DataFrame:
        """``key`` columns of the texts that contain ``q``, upper and lower case alike."""
        q = self.spark.range(1).select(F.lower(F.lit(q))).first()[0]
        docs = self.spark.read.parquet(f"{self.path}/docs")
        found = self.candidates(q)
        if found is not None:
            docs = docs.join(found, "doc", "left_semi")
        return docs.filter(F.col("_text").contains(q)).select(*self.key)
