"""STR5: sentiment pairs of consecutive comments, in event time and any order of arrival.

Comments are keyed by (post, time bucket), so a busy post is as many keys as it
has buckets.  A bucket is at least as wide as the largest gap; a comment of its
last ``max_gap`` seconds is handed to the next bucket as well, so the
predecessor of every comment, if near enough to count, lies in the bucket's own
state.  A pair belongs to the bucket of its second comment.

Each trigger emits by how much the pair counts of the buckets it touched have
changed, so the sums over all triggers equal the batch ``contagion`` counts
after every trigger: out-of-order files split earlier pairs and are paid back
by negative changes, comments delivered again (same post, time and id) change
nothing.  With a watermark, a timer drops a bucket's state once no more of its
comments can come, and later ones are ignored; without one, state is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PAIR_SCHEMA = "post_id string, bucket long, prev string, next string, pairs long"
_ROWS_SCHEMA = "us long, cid string, sentiment string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pair_counts(rows: list[tuple[int, str, str | None]], start_us: int, gap_us: int) -> Counter:
    """(prev, next) counts of rows ``(us, cid, sentiment)`` whose second comment is not before ``start_us``."""
    if len(rows) < 2:
        return Counter()
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    us = np.fromiter((r[0] for r in rows), np.int64, len(rows))
    near = np.flatnonzero((np.diff(us) <= gap_us) & (us[1:] >= start_us)).tolist()
    return Counter((rows[i][2], rows[i + 1][2]) for i in near)


class BucketPairs(StatefulProcessor):
    """List state of one (post, bucket): every comment seen, those handed over from the bucket before included."""

    def __init__(self, bucket_seconds: int, max_gap_seconds: int, expires: bool):
        self.width_us = bucket_seconds * 1_000_000
        self.gap_us = max_gap_seconds * 1_000_000
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ROWS_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        post, bucket = key
        start = int(bucket) * self.width_us
        known = [(int(u), c, s) for u, c, s in self.rows.get()] if self.rows.exists() else []
        seen = {r[:2] for r in known}
        new = []
        for batch in rows:
            for r in zip(batch["us"].tolist(), batch["cid"], batch["sentiment"]):
                if r[:2] not in seen:
                    seen.add(r[:2])
                    new.append(r)
        if not new:
            return
        if not known and self.expires:
            self.handle.registerTimer((start + self.width_us) // 1000)
        self.rows.appendList(new)
        change = pair_counts(known + new, start, self.gap_us)
        change.subtract(pair_counts(known, start, self.gap_us))
        out = [(post, int(bucket), *k, n) for k, n in sorted(change.items(), key=str) if n]
        if out:
            yield pd.DataFrame(out, columns=["post_id", "bucket", "prev", "next", "pairs"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def contagion_pairs(stream: DataFrame, max_gap_seconds: int = 1800, bucket_seconds: int = 3600, delay: str | None = None,
                    not_after: str | None = None) -> DataFrame:
    """Changes of pair counts: ``post_id, bucket, prev, next, pairs`` (append mode).

    ``delay``: how late comments may be; None keeps all state.  ``not_after``:
    comments with a later time stamp are left out, since a single one of year
    9999 would carry the watermark past all others.  Needs the RocksDB state
    store, which is set here if the session names no other.
    """
    if bucket_seconds < max_gap_seconds:
        raise ValueError("a bucket must be as wide as the largest gap")
    conf = stream.sparkSession.conf
    if "RocksDB" not in conf.get(_PROVIDER, ""):
        conf.set(_PROVIDER, _ROCKSDB)
    src = stream.filter(F.col("created_time").isNotNull())
    if not_after:
        src = src.filter(F.col("created_time") <= F.lit(not_after).cast("timestamp"))
    if delay:
        src = src.withWatermark("created_time", delay)
    us, width = F.unix_micros("created_time"), bucket_seconds * 1_000_000
    own = F.floor(us / F.lit(width)).cast("long")
    # the last max_gap of a bucket is handed over
    over = us >= (own + 1) * F.lit(width) - F.lit(max_gap_seconds * 1_000_000)
    buckets = F.when(over, F.array(own, own + 1)).otherwise(F.array(own))
    rows = src.select("post_id", F.explode(buckets).alias("bucket"), "created_time", us.alias("us"), "cid", "sentiment")
    return rows.groupBy("post_id", "bucket").transformWithStateInPandas(
        BucketPairs(bucket_seconds, max_gap_seconds, bool(delay)), PAIR_SCHEMA, "Append", "EventTime" if delay else "None")
