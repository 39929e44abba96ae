"""SNK1 / SRC7: a stored history that takes upserts and rewrites no more than it must.

Snapshots lie in buckets of their post.  An upsert writes a new generation of
the touched buckets only (old rows merged with new ones; a later write of the
same post and time wins), each compacted and sorted, and then publishes which
generation every bucket is at.  Until that is written readers see the old state,
whole; a job that dies in between leaves files that nothing refers to, and an
upsert that runs again changes nothing.  Readers of single posts open their
buckets alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KPI_SNAPSHOT_SCHEMA
from .history import latest_per_post

BUCKETS = 64
#: Tasks that write one bucket of an upsert.
WRITERS = 4
_STATE = "bucket int, generation long, at long, buckets int"


class SnapshotStore:
    """A history table at ``path``; ``schema`` must hold ``post_id`` and ``ts``, the key."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = KPI_SNAPSHOT_SCHEMA, buckets: int = BUCKETS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.buckets = buckets
        found = self._published()
        if found:
            self.buckets = found[0]["buckets"]  # fixed when the store is made

    def _published(self) -> list:
        """One row a bucket that has snapshots: the state of the last complete upsert."""
        try:
            states = self.spark.read.schema(_STATE).parquet(f"{self.path}/states")
            last = states.agg(F.max("at")).first()[0]
            return [] if last is None else states.filter(F.col("at") == last).collect()  # at most one row a bucket
        except AnalysisException as ex:
            if "PATH_NOT_FOUND" in str(ex):
                return []
            raise

    def _bucket(self, c="post_id"):
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _files(self, state: list, buckets: set[int] | None = None) -> list[str]:
        return [f"{self.path}/data/generation={r['generation']}/bucket={r['bucket']}" for r in state if buckets is None or r["bucket"] in buckets]

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def read(self, posts: list[str] | None = None) -> DataFrame:
        """All snapshots, or those of some posts (only their buckets are opened)."""
        state = self._published()
        if posts is None:
            return self._rows(self._files(state))
        ids = self.spark.createDataFrame([(p,) for p in posts], "post_id string")
        buckets = {r["b"] for r in ids.select(self._bucket().alias("b")).collect()}
        return self._rows(self._files(state, buckets)).filter(F.col("post_id").isin(*posts))

    def latest(self, posts: list[str] | None = None) -> DataFrame:
        """The newest snapshot of each post."""
        return latest_per_post(self.read(posts))

    def upsert(self, snapshots: DataFrame) -> set[int]:
        """Merge ``snapshots`` in; returns the buckets that were rewritten.

        Of several rows with one key in ``snapshots``, the one with the largest values stays."""
        names = [f.name for f in self.schema.fields]
        values = [n for n in names if n not in ("post_id", "ts")]
        new = snapshots.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        state = self._published()
        touched = {r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect()}  # at most BUCKETS numbers
        if not touched:
            return touched
        at = 1 + max((r["at"] for r in state), default=-1)
        both = self._rows(self._files(state, touched)).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        merged = both.groupBy("post_id", "ts").agg(F.max(F.struct("_new", *values)).alias("v")).select(
            "post_id", "ts", *[F.col(f"v.{n}").alias(n) for n in values])
        (merged.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64("post_id", "ts"), F.lit(WRITERS)))
         .sortWithinPartitions("bucket", "post_id", "ts").select(*names, "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/generation={at}"))
        now = {r["bucket"]: r["generation"] for r in state} | {b: at for b in touched}
        rows = [(b, g, at, self.buckets) for b, g in sorted(now.items())]
        self.spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/states")
        return touched

    def unused(self) -> list[str]:
        """Folders of bucket generations that no reader of the present state opens."""
        states = self.spark.read.schema(_STATE).parquet(f"{self.path}/states")
        state = self._published()
        kept = set(self._files(state))
        every = states.select("bucket", "generation").distinct().collect()  # upserts times buckets
        return sorted(set(self._files(every)) - kept)
