"""Sinks: CSV export (SNK2) and JSON results (SNK3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_comments_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK2: enriched comments as UTF-8 CSV with a header (no BOM, ruling R24);
    nested columns are written as JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """SNK3: tidy results as JSON lines (optionally one folder per post)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def report_rows(kpis: DataFrame, **lists: DataFrame) -> DataFrame:
    """SNK3 report: one JSON document per post, ``{kpis: {...}, <list>: [...]}``.

    Each list must already be a bounded top-k table (post_id, rank, ...); it is
    collected per post in rank order, so a report row holds at most k entries
    per list.
    """
    kp = kpis.select("post_id", F.struct(*[c for c in kpis.columns if c != "post_id"]).alias("kpis"))
    out = kp
    for name, tbl in lists.items():
        cols = [c for c in tbl.columns if c != "post_id"]
        agg = tbl.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(agg, "post_id", "left")
    return out.select("post_id", F.to_json(F.struct(*[c for c in out.columns if c != "post_id"])).alias("report"))
