"""KPI history: snapshots, percentile ranks and deltas (SRC7, SNK1, JN5, AGG35-AGG37).

The history is an append-only ``kpi_snapshots`` table.  "The last 20
snapshots" and "the previous snapshot of another post" are defined over the
global order (ts, post_id).  A global window would put every snapshot into one
task, so the order is materialised as a dense row number computed with a
distributed sort plus per-partition offsets, and the window operators become
bounded equi-joins on that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import KPI_SNAPSHOT_SCHEMA
from ..session import cut_lineage
from .kpis import count_if
from .quantiles import exact_quantiles

METRICS_PCT = ("advocacy", "safety_score", "avg_reactions_per_comment", "total_comments")
METRICS_DELTA = ("total_comments", "avg_reactions_per_comment", "positivity_ratio", "median_engagement")
BLOCK = 1 << 20


def kpi_snapshots(df: DataFrame, bucket_hours: int = 6) -> DataFrame:
    """Snapshots derived from comments: the KPIs of each post over each
    ``bucket_hours`` bucket of comment time; ``ts`` = bucket start."""
    us = F.lit(bucket_hours * 3_600_000_000)
    d = df.filter(F.col("created_time").isNotNull()).withColumn(
        "ts", F.timestamp_micros(F.floor(F.unix_micros("created_time") / us).cast("long") * us))
    n = F.count(F.lit(1)).cast("long")
    pos = count_if(F.col("sentiment") == "positive")
    neg = count_if(F.col("sentiment") == "negative")
    out = d.groupBy("post_id", "ts").agg(
        n.alias("total_comments"),
        (pos * 100.0 / F.greatest(F.lit(1), n)).alias("advocacy"),
        F.greatest(F.lit(0.0), 100.0 - neg * 100.0 / F.greatest(F.lit(1), n)).alias("safety_score"),
        F.avg("total_reactions").cast("double").alias("avg_reactions_per_comment"),
        (pos * 100.0 / F.greatest(F.lit(1), pos + neg)).alias("positivity_ratio"))
    return out.join(exact_quantiles(d, ["post_id", "ts"], {"median_engagement": ("engagement_score", 0.5)}), ["post_id", "ts"], "left")


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """SNK1: append (the history is never rewritten)."""
    snapshots.select(*[f.name for f in KPI_SNAPSHOT_SCHEMA.fields]).write.mode("append").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: the history table; missing -> empty."""
    try:
        return spark.read.schema(KPI_SNAPSHOT_SCHEMA).parquet(path)
    except Exception as ex:  # noqa: BLE001 - a missing folder means an empty history
        if "PATH_NOT_FOUND" in str(ex) or "does not exist" in str(ex):
            return spark.createDataFrame([], KPI_SNAPSHOT_SCHEMA)
        raise


def latest_per_post(snapshots: DataFrame) -> DataFrame:
    """The upsert view of SNK1: newest snapshot per post (aggregate, no window)."""
    # newest first by time; rows of one post and time are told apart by their values
    cols = ["ts"] + [c for c in snapshots.columns if c not in ("post_id", "ts")]
    latest = snapshots.groupBy("post_id").agg(F.max(F.struct(*cols)).alias("s"))
    return latest.select(*[F.col(c) if c == "post_id" else F.col(f"s.{c}").alias(c) for c in snapshots.columns])


def snapshot(kpis: DataFrame, ts) -> DataFrame:
    """SNK1: the current KPIs (``insights_kpis``) as stamped snapshot rows, one per post."""
    stamped = kpis.withColumn("ts", F.lit(ts).cast("timestamp"))
    return stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in KPI_SNAPSHOT_SCHEMA.fields])


def benchmark_current(current: DataFrame, history: DataFrame, window: int = 20) -> DataFrame:
    """AGG35 for the current snapshots: each against the last ``window`` posts, one row per post (the upsert view)."""
    cols = [f.name for f in KPI_SNAPSHOT_SCHEMA.fields]
    view = latest_per_post(history.select(*cols).unionByName(current.select(*cols)))
    return benchmark_percentiles(view, window).join(current.select("post_id").distinct(), "post_id", "left_semi")


def global_row_number(df: DataFrame, order: list[str], name: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """Dense 1-based row number over a global order, without a single-partition window.

    Range-partition and sort, number rows inside each partition, checkpoint (so
    the partition assignment is fixed), then add the row count of all earlier
    partitions (a table with one row per partition, broadcast).
    """
    spark = df.sparkSession
    nparts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(nparts, *order).sortWithinPartitions(*order)
    s = s.withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*order)
    s = cut_lineage(s.withColumn("_lrn", F.row_number().over(w).cast("long")))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).cast("long").alias("_c"))
    offs = counts.select("_pid", (F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).alias("_off"))
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(name, F.col("_off") + F.col("_lrn")).drop("_pid", "_lrn", "_off"))


def _ordered(snapshots: DataFrame) -> DataFrame:
    return global_row_number(snapshots, ["ts", "post_id"])


def benchmark_percentiles(snapshots: DataFrame, window: int = 20,
                          metrics=METRICS_PCT, ordered: DataFrame | None = None) -> DataFrame:
    """AGG35/AGG36: for each snapshot, the percent of the last ``window``
    snapshots (itself included) whose metric is <= its own; count_history."""
    o = ordered if ordered is not None else _ordered(snapshots)
    # Blocks of row numbers; the last rows of a block are copied ahead of the next one,
    # so a window inside a block sees all it needs.
    blk = F.floor((F.col("rn") - 1) / BLOCK).cast("long")
    ahead = F.when((F.col("rn") - 1) % BLOCK >= BLOCK - (window - 1), blk + 1)
    c = o.select("rn", "post_id", "ts", *metrics, blk.alias("_own"), F.explode(F.array_compact(F.array(blk, ahead))).alias("_blk"))
    w = Window.partitionBy("_blk").orderBy("rn").rowsBetween(-(window - 1), 0)
    c = c.withColumn("_seen", F.collect_list(F.struct(*metrics)).over(w)).where("_blk = _own")

    def pct(m: str) -> Column:
        known = F.filter("_seen", lambda x: x[m].isNotNull())
        at_most = F.filter(known, lambda x: x[m] <= F.col(m))
        return F.when(F.size(known) > 0, 100.0 * F.size(at_most) / F.greatest(F.size(known), F.lit(1))).alias(f"pct_{m}")

    return c.select("rn", "post_id", "ts", F.size("_seen").cast("long").alias("count_history"), *[pct(m) for m in metrics])


def kpi_deltas(snapshots: DataFrame, metrics=METRICS_DELTA, ordered: DataFrame | None = None) -> DataFrame:
    """AGG37/JN5: each snapshot minus the latest earlier snapshot of another post
    (missing -> 0).  Found as: the row before the start of the snapshot's run of
    same-post rows in the global order; run starts are carried forward with a
    two-level running max (inside blocks of rows, then across blocks)."""
    o = ordered if ordered is not None else _ordered(snapshots)
    prev = o.select((F.col("rn") + 1).alias("rn"), F.col("post_id").alias("_pp"))
    s = o.join(prev, "rn", "left").withColumn(
        "_start", F.when(F.col("_pp").isNull() | (F.col("_pp") != F.col("post_id")), F.col("rn")))
    s = s.withColumn("_blk", F.floor((F.col("rn") - 1) / BLOCK).cast("long"))
    wb = Window.partitionBy("_blk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_run_local", F.max("_start").over(wb))
    blk = s.groupBy("_blk").agg(F.max("_start").alias("_bmax"))
    carry = blk.select("_blk", F.max("_bmax").over(
        Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    s = s.join(F.broadcast(carry), "_blk", "left").withColumn(
        "_run", F.coalesce(F.col("_run_local"), F.col("_carry")))
    other = o.select((F.col("rn") + 1).alias("_run"), *[F.col(m).alias(f"_p_{m}") for m in metrics],
                     F.col("post_id").alias("prev_post_id"))
    j = s.join(other, "_run", "left")
    return j.select("rn", "post_id", "ts", "prev_post_id",
                    *[(F.col(m) - F.coalesce(F.col(f"_p_{m}"), F.lit(0))).cast("double").alias(f"delta_{m}")
                      for m in metrics])
