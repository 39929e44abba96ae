"""Durable results of streams: a Parquet table in which every micro-batch owns one partition.

A micro-batch that is run again (the process died between the write and the
commit of its offsets) has the same id and the same rows, and overwrites its
own partition: the table holds every row once, whatever was killed when.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def batch_writer(path: str, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that replaces the batch's own partition of the table at ``path``."""

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.sortWithinPartitions(*order) if order else df
        (rows.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path))

    return write


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True,
                 write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start ``stream`` into the table at ``path``; a restart with the same checkpoint goes on where it ended."""
    w = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(write or batch_writer(path)))
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of all batches, without the batch id."""
    r = spark.read.option("basePath", path)
    return (r.schema(schema) if schema else r).parquet(path).drop(BATCH)


def totals(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of a table of changes; keys whose changes cancel out are left out."""
    return table.groupBy(*keys).agg(F.sum(value).cast("long").alias(value)).filter(F.col(value) != 0)
