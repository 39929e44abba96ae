"""DuckDB oracle SQL of sources, sinks, streams, fitted scorers and small filters."""

from .sql import W

SQL: dict[str, str] = {}

SQL["caption_search"] = "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'an')"

SQL["indexed_search"] = """
SELECT q, doc_id FROM documents, (VALUES ('what'), ('ING A'), ('e.'), ('no such words')) v(q) WHERE contains(lower(text), lower(q))
"""

_POSTS = """
, posts AS (SELECT post_id AS id, CAST(sum(like_count) AS BIGINT) AS like_count, count(*) AS comment_count, CAST(sum(reply_count) AS BIGINT) AS share_count,
  strftime(max(created_time), '%Y-%m-%dT%H:%M:%S+0000') AS created_time FROM enriched GROUP BY post_id)
"""
SQL["posts_compared"] = W(_POSTS + "SELECT id, like_count, comment_count, share_count FROM posts WHERE id IN ('post_0', 'post_2')")
SQL["posts_ordered"] = W(_POSTS + "SELECT id, created_time FROM posts")
SQL["preview_size"] = W("SELECT least(100, count(*)) AS \"rows\" FROM enriched")

_HANDLED = ", handled AS (SELECT post_id, cid FROM enriched WHERE reply_count >= 3)\n"
SQL["handled_marked"] = W(_HANDLED + "SELECT post_id, cid FROM handled UNION SELECT post_id, cid FROM enriched WHERE post_id = 'post_1' AND like_count > 0")
SQL["handled_cleared"] = W(_HANDLED + "SELECT post_id, cid FROM handled WHERE post_id <> 'post_1'")

SQL["filtered_flags"] = W("""
SELECT 'neg' AS flag, post_id, cid FROM enriched WHERE sentiment = 'negative'
UNION ALL SELECT 'question', post_id, cid FROM enriched WHERE is_q
UNION ALL SELECT 'bangla', post_id, cid FROM enriched WHERE lower(language) IN ('bangla', 'bn')
UNION ALL SELECT 'english', post_id, cid FROM enriched WHERE lower(language) IN ('english', 'en')
UNION ALL SELECT 'question_compat', post_id, cid FROM enriched WHERE contains(comment_text, '?')
UNION ALL SELECT 'high_compat', e.post_id, cid FROM enriched e JOIN thr t USING (post_id) WHERE engagement_score >= round_even(t.high_engagement, 0)
""")
SQL["unanswered"] = W("SELECT post_id, cid FROM enriched WHERE reply_count <= 0")
SQL["long_comments"] = W("SELECT post_id, cid FROM enriched WHERE length(comment_text) >= 2000")
SQL["dashboard_table"] = W("SELECT post_id, user_name, comment_text, sentiment, emotion, total_reactions, engagement_score FROM enriched")

SQL["parsed_times"] = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 2 THEN strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') END AS from_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_seconds
FROM events
"""
SQL["short_numbers"] = """
WITH t AS (SELECT event_id, event_id * event_id * 37 % 2000000000003 AS n FROM events)
SELECT event_id, CASE WHEN n >= 1000000000 THEN replace(printf('%.1f', n / 1000000000.0), '.0', '') || 'B'
  WHEN n >= 1000000 THEN replace(printf('%.1f', n / 1000000.0), '.0', '') || 'M'
  WHEN n >= 1000 THEN replace(printf('%.1f', n / 1000.0), '.0', '') || 'K' ELSE CAST(n AS VARCHAR) END AS short
FROM t
"""
SQL["cards"] = W("SELECT post_id, cid, strftime(created_time, '%Y-%m-%d') AS day, substr(comment_text, 1, 120) AS snippet FROM enriched")

SQL["csv_round_trip"] = W("""
SELECT post_id, comment_id, user_name, strftime(created_time, '%Y-%m-%d %H:%M:%S') AS created_time, like_count, reply_count, language,
  CAST(NULL AS VARCHAR) AS parent_comment_id, '["' || language || '","' || sentiment || '"]' AS tags,
  CAST(length(trim(regexp_replace(comment_text, '[\\r\\n]+', ' ', 'g'))) AS BIGINT) AS chars
FROM enriched
""")
SQL["json_round_trip"] = W("""
SELECT post_id, label, CAST(value AS BIGINT) AS value FROM (
  SELECT post_id, sum(like_count) AS "LIKE", sum(love_count) AS LOVE, sum(haha_count) AS HAHA, sum(wow_count) AS WOW, sum(sad_count) AS SAD,
    sum(angry_count) AS ANGRY, sum(care_count) AS CARE FROM enriched GROUP BY post_id) t
UNPIVOT (value FOR label IN ("LIKE", LOVE, HAHA, WOW, SAD, ANGRY, CARE))
""")

SQL["stream_dedupe"] = W("SELECT post_id, comment_id FROM enriched")
SQL["stream_timeline"] = W("""
SELECT post_id, strftime(date_trunc('hour', created_time), '%Y-%m-%d %H:%M:%S') AS bin_start, count(*) AS count
FROM enriched WHERE created_time IS NOT NULL GROUP BY ALL
""")
SQL["stream_sentiment"] = W("""
SELECT post_id, strftime(date_trunc('hour', created_time), '%Y-%m-%d %H:%M:%S') AS bin_start, sentiment, count(*) AS count
FROM enriched WHERE created_time IS NOT NULL GROUP BY ALL
""")
SQL["stream_contagion"] = W("""
, o AS (SELECT post_id, created_time, sentiment, lag(created_time) OVER w AS pt, lag(sentiment) OVER w AS ps
        FROM enriched WHERE created_time IS NOT NULL WINDOW w AS (PARTITION BY post_id ORDER BY created_time, cid))
SELECT post_id, ps AS prev, sentiment AS next, count(*) AS pairs FROM o WHERE created_time - pt <= INTERVAL 30 MINUTE GROUP BY ALL
""")

# that the model finds the language is the claim; its estimates are not recomputed here
SQL["language_heldout"] = "SELECT lang, count(*) AS documents, true AS over_90 FROM documents WHERE doc_id % 5 = 0 AND lang IS NOT NULL GROUP BY lang"

SQL["sentiment_predicted"] = W("""
, x AS (SELECT e.comment_id, CAST(substr(e.comment_id, 5) AS BIGINT) AS id, e.sentiment, e.comment_text FROM enriched e
        WHERE CAST(substr(e.comment_id, 5) AS BIGINT) IN (SELECT doc_id FROM labels)),
tok AS (SELECT comment_id, id, sentiment, unnest(regexp_extract_all(lower(comment_text), '[\\p{L}\\p{M}]+')) AS w FROM x),
cnt AS (SELECT w, sentiment AS c, count(*) AS n FROM tok WHERE id % 5 <> 0 GROUP BY ALL),
voc AS (SELECT DISTINCT w FROM cnt),
cls AS (SELECT p.c, p.docs, t.total, (SELECT count(*) FROM voc) AS v, (SELECT count(*) FROM x WHERE id % 5 <> 0) AS rows
        FROM (SELECT sentiment AS c, count(*) AS docs FROM x WHERE id % 5 <> 0 GROUP BY ALL) p
        JOIN (SELECT c, sum(n) AS total FROM cnt GROUP BY c) t ON t.c = p.c),
held AS (SELECT comment_id, w, count(*) AS k FROM tok WHERE id % 5 = 0 AND w IN (SELECT w FROM voc) GROUP BY ALL),
pts AS (SELECT h.comment_id, cls.c, sum(h.k * ln((coalesce(cnt.n, 0) + 0.5) / (cls.total + 0.5 * cls.v))) AS s
        FROM held h CROSS JOIN cls LEFT JOIN cnt ON cnt.w = h.w AND cnt.c = cls.c GROUP BY ALL),
fin AS (SELECT x.comment_id, cls.c, coalesce(pts.s, 0) + ln(cls.docs / cls.rows) AS s
        FROM x CROSS JOIN cls LEFT JOIN pts ON pts.comment_id = x.comment_id AND pts.c = cls.c WHERE x.id % 5 = 0)
SELECT comment_id, c AS sentiment FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY s DESC, c) AS r FROM fin) WHERE r = 1
""")
