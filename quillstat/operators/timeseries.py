"""Time-series operators (WIN1-WIN12, AGG34).

Bin width is chosen per post (WIN1).  Counting is a plain aggregate on
(post, bin), and only bins that hold comments are ever kept: a gap is the number
of empty bins behind one.  The fit takes empty bins as closed-form sums, running
counts change at counted bins only, and both work in two levels (inside blocks
of bins, then over blocks), so neither a long span nor a busy post meets in one
group; a stray time stamp of year 9999 adds one row.  Only the zero-filled
timeline spells its gaps out, piece by piece.  The contagion lag is split into
time buckets (see ``contagion``).
Rows without a timestamp are left out of time operators (ruling R7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .kpis import count_if
from .perpost import per_post
from .rankings import top_k

HOUR_US = 3_600_000_000
#: Bins of a block, and of the pieces in which a gap is spelled out.
BLOCK_BINS = 4096
LABELS3 = ("positive", "neutral", "negative")


def _timed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("created_time").isNotNull()).withColumn("_us", F.unix_micros("created_time"))


def post_bins(df: DataFrame) -> DataFrame:
    """WIN1 per post: tmin/tmax (µs), bin width (s) and first/last bin index."""
    t = _timed(df).groupBy("post_id").agg(F.min("_us").alias("tmin"), F.max("_us").alias("tmax"))
    span_h = F.greatest(F.lit(1e-6), (F.col("tmax") - F.col("tmin")) / F.lit(float(HOUR_US)))
    width = F.when(span_h <= 6, F.lit(900)).otherwise(F.lit(3600)).cast("long")
    t = t.withColumn("width_s", width)
    w_us = F.col("width_s") * 1_000_000
    return t.withColumns({"b0": F.floor(F.col("tmin") / w_us).cast("long"),
                          "b1": F.floor(F.col("tmax") / w_us).cast("long")})


def _binned(df: DataFrame, bins: DataFrame) -> DataFrame:
    d = per_post(_timed(df), bins.select("post_id", "width_s", "b0", "b1"), "inner")
    return d.withColumn("bin", F.floor(F.col("_us") / (F.col("width_s") * 1_000_000)).cast("long"))


def bin_counts(df: DataFrame) -> DataFrame:
    """``post_id, bin, width_s, b0, b1, blk, count``: the bins that hold comments."""
    return (_binned(df, post_bins(df)).groupBy("post_id", "bin", "width_s", "b0", "b1").agg(F.count(F.lit(1)).cast("long").alias("count"))
            .withColumn("blk", F.floor((F.col("bin") - F.col("b0")) / BLOCK_BINS).cast("long")))


def _with_gaps(counts: DataFrame) -> DataFrame:
    """``gap``: empty bins between each counted bin and the next one (or the end)."""
    inner = Window.partitionBy("post_id", "blk").orderBy("bin")
    outer = Window.partitionBy("post_id").orderBy("blk")
    blocks = counts.groupBy("post_id", "blk").agg(F.min("bin").alias("_first"))
    blocks = blocks.select("post_id", "blk", F.lead("_first").over(outer).alias("_after"))
    t = counts.withColumn("_next", F.lead("bin").over(inner)).join(blocks, ["post_id", "blk"])
    return t.withColumn("gap", F.coalesce("_next", "_after", F.col("b1") + 1) - F.col("bin") - 1).drop("_next", "_after")


def _with_running(counts: DataFrame) -> DataFrame:
    """``cum``: comments up to each counted bin."""
    inner = Window.partitionBy("post_id", "blk").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("post_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("post_id", "blk").agg(F.sum("count").alias("_n"))
    blocks = blocks.select("post_id", "blk", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before"))
    return counts.withColumn("_own", F.sum("count").over(inner)).join(blocks, ["post_id", "blk"]).withColumn(
        "cum", F.col("_own") + F.col("_before")).drop("_own", "_before")


def _label(bin_col: Column, width: Column, short: bool = False) -> Column:
    ts = F.timestamp_micros(bin_col * width * 1_000_000)
    full = F.date_format(ts, "yyyy-MM-dd HH:mm")
    if short:  # WIN12: the 15-minute emotion stack is labelled HH:mm
        return F.when(width == 900, F.date_format(ts, "HH:mm")).otherwise(full)
    return full


def timeline(df: DataFrame) -> DataFrame:
    """WIN2: zero-filled counts per bin.  Rows: post_id, idx, t, count, width_s."""
    runs = _with_gaps(cut_lineage(bin_counts(df)))
    # a gap is spelled out in pieces, so no array is longer than a piece
    at = F.col("_piece") * BLOCK_BINS
    every = runs.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("gap") / BLOCK_BINS).cast("long")))).withColumn(
        "_off", F.explode(F.sequence(at, F.least(F.col("gap"), at + BLOCK_BINS - 1))))
    bin_ = F.col("bin") + F.col("_off")
    return every.select("post_id", (bin_ - F.col("b0")).alias("idx"), _label(bin_, F.col("width_s")).alias("t"),
                        F.when(F.col("_off") == 0, F.col("count")).otherwise(0).cast("long").alias("count"), "width_s")


def daily_timeline(df: DataFrame) -> DataFrame:
    """WIN3: comments per UTC day, only days that have comments."""
    return (_timed(df).groupBy("post_id", F.date_format("created_time", "yyyy-MM-dd").alias("day"))
            .agg(F.count(F.lit(1)).cast("long").alias("count")))


def forecast_next_day(df: DataFrame, min_comments: int = 30) -> DataFrame:
    """WIN10: max(0, last + (last - prev)) on the daily series, when the post has
    >= min_comments comments and >= 2 days."""
    days = top_k(daily_timeline(df), [F.col("day").desc()], 2, rank_col="r")
    p = days.groupBy("post_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("count"))).alias("last"),
        F.max(F.when(F.col("r") == 2, F.col("count"))).alias("prev"),
        F.count(F.lit(1)).alias("n_days"))
    n = df.groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(p, "post_id", "left").select(
        "post_id", F.when((F.col("n") >= min_comments) & (F.col("n_days") >= 2),
                          F.greatest(F.lit(0), 2 * F.col("last") - F.col("prev"))).cast("long").alias("forecast"))


def top_emotions(df: DataFrame, k: int = 5) -> DataFrame:
    counts = df.filter(F.col("emotion").isNotNull()).groupBy("post_id", "emotion").agg(
        F.count(F.lit(1)).alias("n"))
    return top_k(counts, [F.col("n").desc(), F.col("emotion").asc()], k).select("post_id", "emotion")


def emotion_stack(df: DataFrame, k: int = 5) -> DataFrame:
    """WIN4: top-k emotions x bins that hold any emotion; zeros only inside those
    bins (ruling R8).  Rows: post_id, bin, t, emotion, count."""
    bins = post_bins(df)
    b = _binned(df.filter(F.col("emotion").isNotNull()), bins)
    counts = b.groupBy("post_id", "bin", "emotion").agg(F.count(F.lit(1)).cast("long").alias("count"))
    nonempty = counts.select("post_id", "bin").distinct()
    grid = nonempty.join(top_emotions(df, k), "post_id")  # exactly k rows per bin
    out = grid.join(counts, ["post_id", "bin", "emotion"], "left").fillna(0, ["count"])
    out = out.join(bins.select("post_id", "width_s"), "post_id")
    return out.select("post_id", "bin", _label(F.col("bin"), F.col("width_s"), short=True).alias("t"),
                      "emotion", "count", "width_s")


def spikes(df: DataFrame, mode: str = "trailing", k: int = 8, z_min: float = 2.0,
           v_min: int = 2) -> DataFrame:
    """WIN5: z-score of each emotion's bin count against a rolling mean / sample sd.

    ``literal``: window of 3 including the current bin (the reference's rule;
    it can never reach z >= 2, so it is always empty - ruling R5).
    ``trailing``: the 3 bins before the current one.  Bins with sd = 0 never
    fire.  Top k per post by z desc.
    """
    st = emotion_stack(df)
    w = Window.partitionBy("post_id", "emotion").orderBy("bin")
    frame = w.rowsBetween(-2, 0) if mode == "literal" else w.rowsBetween(-3, -1)
    s = st.withColumns({"_mu": F.avg("count").over(frame), "_sd": F.stddev_samp("count").over(frame),
                        "_n": F.count("count").over(frame)})
    z = (F.col("count") - F.col("_mu")) / F.col("_sd")
    s = s.filter((F.col("_n") == 3) & (F.col("_sd") > 0)).withColumn("z", z)
    s = s.filter((F.col("z") >= z_min) & (F.col("count") >= v_min))
    s = s.withColumn("t", _label(F.col("bin"), F.col("width_s")))
    r = top_k(s, [F.col("z").desc(), F.col("t").asc(), F.col("emotion").asc()], k)
    return r.select("post_id", "rank", "t", "emotion", "z", F.col("count").alias("value"))


def decay_fit(df: DataFrame) -> DataFrame:
    """WIN6: OLS of ln(max(count, 1e-6)) on bin offset from the first peak (needs
    >= 4 bins).  tau = -1/slope when slope < 0.  One tail point -> slope null (R6)."""
    c = cut_lineage(bin_counts(df)).withColumn("idx", F.col("bin") - F.col("b0"))  # read several times, comments once
    stats = c.groupBy("post_id").agg(
        (F.max("b1") - F.max("b0") + 1).cast("long").alias("n_bins"),
        F.min(F.struct((-F.col("count")).alias("c"), F.col("idx").alias("i"))).alias("_peak")).select("post_id", "n_bins", F.col("_peak.i").alias("peak_index"))
    # offsets 0..n-1 from the peak are evenly spaced, so their sums are known; an empty bin's y is a constant,
    # and only what counted bins differ from it is summed
    n = (F.col("n_bins") - F.col("peak_index")).cast("double")
    mean_x, sxx = (n - 1) / 2, n * (n * n - 1) / 12
    empty = F.log(F.lit(1e-6))
    over = F.log(F.greatest(F.col("count").cast("double"), F.lit(1e-6))) - empty
    t = c.join(stats, "post_id").filter((F.col("n_bins") >= 4) & (F.col("idx") >= F.col("peak_index")))
    x = (F.col("idx") - F.col("peak_index")).cast("double")
    sums = t.groupBy("post_id", "n_bins", "peak_index").agg(F.sum((x - mean_x) * over).alias("_sxy"), F.sum(over).alias("_sy"))
    slope = F.when(n > 1, F.col("_sxy") / F.when(sxx > 0, sxx))
    fit = sums.select("post_id", slope.alias("slope"), (empty + F.col("_sy") / n - slope * mean_x).alias("intercept"))
    out = stats.join(fit, "post_id", "left")
    return out.select("post_id", "n_bins", "peak_index", "slope", "intercept",
                      # tau is reported at 2 decimals, as the reference does; it is
                      # 1/slope, so unrounded digits only carry float noise.
                      F.round(F.when(F.col("slope") < 0, -1.0 / F.col("slope")), 2).alias("tau_bins"))


def decay_curve(df: DataFrame) -> DataFrame:
    """WIN6: the fitted decay per bin, exp(intercept + slope * bins since the peak); null before the peak and without a fit."""
    fit = decay_fit(df).select("post_id", "peak_index", "slope", "intercept")
    since = F.col("idx") - F.col("peak_index")
    value = F.when(since >= 0, F.exp(F.col("intercept") + F.col("slope") * since))
    return timeline(df).join(fit, "post_id").select("post_id", "idx", "t", "count", value.alias("fitted"))


def half_life(df: DataFrame) -> DataFrame:
    """WIN7/WIN8: first bin where the running count reaches half of all, and 10."""
    c = cut_lineage(bin_counts(df))
    tot = c.groupBy("post_id").agg(F.sum("count").alias("total"))
    c = _with_running(c).join(tot, "post_id").withColumn("idx", F.col("bin") - F.col("b0"))
    hrs = F.when(F.col("width_s") == 900, F.lit(0.25)).otherwise(F.lit(1.0))
    return c.groupBy("post_id").agg(
        (F.min(F.when((F.col("total") > 0) & (F.col("cum") >= 0.5 * F.col("total")), F.col("idx")))
         * F.first(hrs)).alias("half_life_hours"),
        (F.min(F.when((F.col("total") >= 10) & (F.col("cum") >= 10), F.col("idx")))
         * F.first(hrs)).alias("t_first10_hours"))


def reaction_curve(df: DataFrame) -> DataFrame:
    """AGG34/WIN11: mean total reactions per whole hour of age since the post's first comment."""
    t = _timed(df)
    first = t.groupBy("post_id").agg(F.min("_us").alias("_t0"))
    d = per_post(t, first, "inner").withColumn("age_h", F.floor((F.col("_us") - F.col("_t0")) / HOUR_US).cast("long"))
    return d.groupBy("post_id", "age_h").agg(F.avg("total_reactions").cast("double").alias("value"))


def _ordered_pairs(df: DataFrame, bucket_seconds: int) -> DataFrame:
    """Each timed comment with its predecessor in (created_time, cid) order.

    Two-level lag so no task holds a whole post: ``lag`` inside (post, time
    bucket); the first row of a bucket takes the last row of the post's previous
    non-empty bucket (a window over per-bucket summaries, one row per bucket).
    """
    t = _timed(df).select("post_id", "cid", "_us", "sentiment")
    t = t.withColumn("bk", F.floor(F.col("_us") / (bucket_seconds * 1_000_000)).cast("long"))
    w = Window.partitionBy("post_id", "bk").orderBy("_us", "cid")
    t = t.withColumns({"prev_us": F.lag("_us").over(w), "prev_s": F.lag("sentiment").over(w),
                       "rn": F.row_number().over(w)})
    last = t.groupBy("post_id", "bk").agg(
        F.max_by(F.struct("_us", "sentiment"), F.struct("_us", "cid")).alias("last"))
    wb = Window.partitionBy("post_id").orderBy("bk")
    carry = last.select("post_id", "bk", F.lag("last").over(wb).alias("carry"))
    t = t.join(carry, ["post_id", "bk"], "left")
    first = F.col("rn") == 1
    return t.select(
        "post_id", "cid", "_us", "sentiment",
        F.when(first, F.col("carry._us")).otherwise(F.col("prev_us")).alias("prev_us"),
        F.when(first, F.col("carry.sentiment")).otherwise(F.col("prev_s")).alias("prev_s"))


def contagion(df: DataFrame, max_gap_seconds: int = 1800, bucket_seconds: int = 3600) -> DataFrame:
    """WIN9: 3x3 sentiment lift between consecutive comments <= max_gap apart.

    lift(i, j) = P(next = j | prev = i) / P(j); P(j) over all the post's
    comments; the row total is 1 when a row has no pairs; an absent base rate
    gives 0.  Rows: post_id, prev, next, pairs, lift.
    """
    p = _ordered_pairs(df, bucket_seconds)
    p = p.filter(F.col("prev_us").isNotNull() & ((F.col("_us") - F.col("prev_us")) <= max_gap_seconds * 1_000_000))
    pairs = p.groupBy("post_id", F.col("prev_s").alias("prev"), F.col("sentiment").alias("next")).agg(
        F.count(F.lit(1)).cast("long").alias("pairs"))
    base = df.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[count_if(F.col("sentiment") == s).alias(f"_b_{s}") for s in LABELS3])
    grid = base.select("post_id", "_n", *[f"_b_{s}" for s in LABELS3], F.explode(F.array(*[
        F.struct(F.lit(i).alias("prev"), F.lit(j).alias("next")) for i in LABELS3 for j in LABELS3])).alias("g"))
    grid = grid.select("*", "g.prev", "g.next").drop("g")
    out = grid.join(pairs, ["post_id", "prev", "next"], "left").fillna(0, ["pairs"])
    row_tot = F.sum("pairs").over(Window.partitionBy("post_id", "prev"))
    base_n = F.when(F.col("next") == "positive", F.col("_b_positive")).when(
        F.col("next") == "neutral", F.col("_b_neutral")).otherwise(F.col("_b_negative"))
    base_p = F.when(base_n > 0, base_n / F.col("_n")).otherwise(F.lit(1e-9))
    out = out.withColumn("_rt", row_tot)
    lift = (F.col("pairs") / F.when(F.col("_rt") == 0, F.lit(1)).otherwise(F.col("_rt"))) / base_p
    return out.select("post_id", "prev", "next", "pairs", lift.alias("lift"))
