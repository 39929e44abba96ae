"""Registered similarity, history and join queries."""

from __future__ import annotations

from ..operators import similarity as SIM


def _on(enriched, fn, **kw):
    def q(spark, sf_dir):
        return fn(enriched(spark, sf_dir), **kw)
    q.__name__ = getattr(fn, "__name__", "query")
    return q


def _groups(df):
    return SIM.similar_groups(df)[0]


def _members(df):
    return SIM.similar_groups(df)[1]


def _similarity_queries(enriched):
    return {
        "similar_pairs": _on(enriched, SIM.similar_pairs),
        "similar_groups": _on(enriched, _groups),
        "similar_group_members": _on(enriched, _members),
    }


def _history_queries(enriched):
    from ..operators import history as H

    from pyspark.sql import functions as F

    def _fmt(df):  # timestamps as text, so both engines print them alike
        return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))

    def _snaps(spark, sf_dir):
        return H.kpi_snapshots(enriched(spark, sf_dir))

    def snaps(spark, sf_dir):
        return _fmt(_snaps(spark, sf_dir))

    def pct(spark, sf_dir):
        return _fmt(H.benchmark_percentiles(_snaps(spark, sf_dir)))

    def deltas(spark, sf_dir):
        return _fmt(H.kpi_deltas(_snaps(spark, sf_dir)))

    def latest(spark, sf_dir):
        return _fmt(H.latest_per_post(_snaps(spark, sf_dir)))

    def current(spark, sf_dir):
        from ..operators import kpis as K
        now = H.snapshot(K.insights_kpis(enriched(spark, sf_dir)), "2030-01-01 00:00:00")
        return _fmt(H.benchmark_current(now, _snaps(spark, sf_dir)))

    def stored(spark, sf_dir):
        """Two upserts into a stored history, the second with corrected rows, read back."""
        import uuid

        from ..operators.snapshot_store import SnapshotStore
        from ..session import cut_lineage, ensure_checkpoint_dir
        right = cut_lineage(_snaps(spark, sf_dir))
        store = SnapshotStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}", buckets=16)
        store.upsert(right.filter(F.crc32("post_id") % 3 > 0).withColumn("total_comments", F.lit(-1).cast("long")))
        store.upsert(right)
        return _fmt(store.read())

    return {"snapshot_store": stored, "benchmark_current": current, "kpi_snapshots": snaps, "benchmark_percentiles": pct, "kpi_deltas": deltas,
            "latest_snapshot": latest}


def _extra_queries(enriched):
    from pyspark.sql import functions as F

    from ..functions.links import object_id
    from ..operators import cells as CE
    from ..operators import filters as FL
    from ..operators import joins as J
    from ..operators import kpis as K
    from ..session import cut_lineage
    from ..schema import REACTION_TYPES, ROW_PAYLOAD_COLS, WINDOW_PAYLOAD_COLS
    from ..sources.testdata import comments_v, table

    def _payload(df, cols):
        df = df.withColumn("created_time", F.date_format("created_time", "yyyy-MM-dd HH:mm:ss"))
        return df.select("post_id", *[c for c in cols if c in df.columns])

    def row_payload(spark, sf_dir):
        return _payload(enriched(spark, sf_dir), ROW_PAYLOAD_COLS)

    def window_payload(spark, sf_dir):
        return _payload(FL.time_window(enriched(spark, sf_dir), rng="24h"), WINDOW_PAYLOAD_COLS)

    def window_kpis(spark, sf_dir):
        return K.insights_kpis(FL.time_window(enriched(spark, sf_dir), rng="3d"))

    def presets(spark, sf_dir):
        return CE.preset_kpis(enriched(spark, sf_dir))

    def uniques(spark, sf_dir):
        cells = cut_lineage(CE.distinct_cells(enriched(spark, sf_dir), exact=True))
        return CE.distinct_over(cells, CE.last_days(cells))

    def sketched(spark, sf_dir):
        """Estimates of merged sketches against the exact counts: within four standard errors."""
        d = enriched(spark, sf_dir)
        cells = cut_lineage(CE.distinct_cells(d, exact=True))
        windows = CE.last_days(cells)
        near = CE.distinct_over(CE.distinct_cells(d), windows).select("post_id", "window", F.col("unique_users").alias("estimate"))
        bound = F.lit(4 * CE.sketch_error()) * F.col("unique_users") + 1
        return CE.distinct_over(cells, windows).join(near, ["post_id", "window"]).select(
            "post_id", "window", (F.abs(F.col("estimate") - F.col("unique_users")) <= bound).alias("within_error"))

    def filtered(spark, sf_dir):
        d = FL.filter_comments(enriched(spark, sf_dir), q="an", flags=("pos", "high"))
        return d.select("post_id", "cid", "engagement_score")

    def unhandled(spark, sf_dir):
        d = enriched(spark, sf_dir)
        handled = d.filter(F.col("reply_count") >= 3).select("post_id", "cid")
        return J.without_handled(d, handled).select("post_id", "cid", "reply_count")

    def backfill(spark, sf_dir):
        n = table(spark, sf_dir, "documents").count()
        ev = table(spark, sf_dir, "events")
        types = F.array(*[F.lit(t) for t in REACTION_TYPES])
        reactions = ev.select(
            F.concat(F.lit("cmt_"), (F.col("event_id") % n).cast("string")).alias("comment_id"),
            F.element_at(types, (F.col("event_id") % 7 + 1).cast("int")).alias("type"),
            # posts that must be left alone get other counts, so filling them shows
            (F.floor(F.col("value") / 25) + F.when(F.col("event_id") % n % 4 >= 2, 5).otherwise(0)).cast("long").alias("cnt"))
        blocked = J.zero_reactions(comments_v(spark, sf_dir), ["post_0", "post_1"])
        out = J.reaction_backfill(blocked, reactions)
        return out.select("post_id", "comment_id", *[f"{t}_count" for t in REACTION_TYPES])

    def link_ids(spark, sf_dir):
        # The test urls carry no id; nine in ten are given one of the shapes.
        n = F.concat(F.lit("10"), F.col("page_id").cast("string"))
        base = "https://www.facebook.com/"
        shapes = [(base + "reel/", ""), (base + "some.page/videos/", "/"), ("https://FACEBOOK.com/watch/?v=", ""), ("https://m.example.com/x?a=1&v=", ""),
                  (base + "photo.php?set=a&fbid=", ""), (base + "permalink.php?story_fbid=", "&id=7"), (base + "some.page/posts/", ""),
                  (base + "groups/77/permalink/", ""), ("\u00a0", "_5\u3000")]
        url = F.col("url")
        for i, (head, tail) in enumerate(shapes):
            url = F.when(F.col("page_id") % 10 == i, F.concat(F.lit(head), n, F.lit(tail))).otherwise(url)
        return table(spark, sf_dir, "pages").withColumn("url", url).select("page_id", "url", object_id("url").alias("object_id"))

    def quality(spark, sf_dir):
        d, n = enriched(spark, sf_dir), F.substring("cid", 5, 20).cast("long")
        d = d.withColumns({"comment_text": F.when(n % 9 != 0, F.col("comment_text")), "created_time": F.when(n % 10 != 0, F.col("created_time")),
                           "user_id": F.when(n % 8 != 0, F.col("user_id"))})
        return K.data_quality(d, as_of=F.lit("2024-02-01 00:00:00").cast("timestamp")) \
            .withColumn("newest_comment", F.date_format("newest_comment", "yyyy-MM-dd HH:mm:ss"))

    def _landed(spark, sf_dir):
        """The pages table as landed API pages: ten in a chain, some lost, damaged, empty, landed twice or pointing back."""
        n = F.col("page_id")
        chain, place = F.floor(n / 10), n % 10
        url = lambda c: F.concat(F.lit("u"), c.cast("string"))
        following = F.when((n % 41 == 7) & (place > 0), url(n - 1)).when(place < 9, url(n + 1))
        page = F.to_json(F.struct(url(n).alias("url"), F.array(F.struct(F.concat(F.lit("c"), n.cast("string")).alias("id"), F.col("url").alias("message"))).alias("data"),
                                  F.struct(following.alias("next")).alias("paging")))
        value = F.when(n % 53 == 3, F.substring(page, 1, 20)).when(n % 59 == 4, F.lit(" ")).when(n % 61 == 6, F.lit('{"error": "limit"}')).otherwise(page)
        t = table(spark, sf_dir, "pages").filter(n % 37 != 5)
        twice = F.explode(F.sequence(F.lit(1), F.when(n % 43 == 2, 2).otherwise(1))).alias("copy")
        return t.select(F.concat(F.lit("post_"), chain.cast("string")).alias("post_id"), value.alias("value"), n.alias("page_id"), twice).select(
            "post_id", F.concat_ws("-", F.lpad(F.col("page_id").cast("string"), 12, "0"), "copy").alias("place"), "value")

    def chains(spark, sf_dir):
        from ..sources.page_chains import ingest
        return ingest(_landed(spark, sf_dir))[2]

    def quarantine(spark, sf_dir):
        from ..sources.page_chains import ingest
        return ingest(_landed(spark, sf_dir))[1].select("post_id", "place", "reason")

    def ingested(spark, sf_dir):
        from ..sources.page_chains import ingest
        return ingest(_landed(spark, sf_dir))[0].select("post_id", "comment_id", "comment_text")

    def story(spark, sf_dir):
        from ..operators import text as TX
        from .composites import story_highlights
        d = enriched(spark, sf_dir)
        return story_highlights(K.insights_kpis(d).join(TX.top_keyword(d), "post_id", "left"))

    def modal(spark, sf_dir):
        d = enriched(spark, sf_dir)
        return d.groupBy("post_id").agg(F.mode("sentiment", True).alias("modal_sentiment"),
                                        F.mode("emotion", True).alias("modal_emotion"))

    def text_stats(spark, sf_dir):
        from ..functions import text as X
        d = enriched(spark, sf_dir)
        return d.select("post_id", "cid", "word_count", "emoji_count",
                        X.is_question("comment_text").alias("is_question"),
                        X.cta_hit("comment_text").alias("is_cta"),
                        X.toxic_hit("comment_text").alias("is_toxic"),
                        F.size(X.tokenize("comment_text")).cast("long").alias("n_tokens"),
                        F.size(X.shingle_codes("comment_text")).cast("long").alias("n_shingles"),
                        F.size(X.hashtags("comment_text")).cast("long").alias("n_hashtags"),
                        X.mean_word_length("comment_text").alias("mean_word_len"))

    return {"comment_text_stats": text_stats, "story_highlights": story, "modal_labels": modal, "row_payload": row_payload, "window_payload": window_payload, "window_kpis": window_kpis,
            "preset_kpis": presets, "unique_windows": uniques, "unique_windows_sketched": sketched,
            "filtered_comments": filtered, "unhandled_comments": unhandled, "reaction_backfill": backfill,
            "page_chains": chains, "page_quarantine": quarantine, "page_comments": ingested, "link_ids": link_ids, "data_quality": quality}


def queries(enriched):
    q = {}
    from . import more_queries3
    for part in (_similarity_queries, _history_queries, _extra_queries, more_queries3.queries):
        q.update(part(enriched))
    return q
