"""DuckDB oracle SQL, one statement per registered query.

Shares no code, pattern or word list with the Spark side (see ``fixed``): plain SQL over the
pre-registered test-table views.  Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from . import fixed as X


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EMOJI = _q(X.EMOJI)
URL = _q(X.LINK)
SPACE = X.SPACE
WORD = _q(X.WORD)
QUESTION = _q(X.QUESTION)
CTA = _q(X.CTA)
TOXIC = _q(X.TOXIC)
LANG = ("CASE lower(coalesce(language, 'unknown')) WHEN 'bn' THEN 'bangla' WHEN 'en' THEN 'english' "
        "ELSE lower(coalesce(language, 'unknown')) END")

ENRICHED_SQL = X.COMMENTS_V + f""",
enriched AS (
  SELECT *,
    like_count + love_count + haha_count + wow_count + sad_count + angry_count + care_count AS total_reactions,
    like_count + love_count + haha_count + wow_count + sad_count + angry_count + care_count + reply_count AS engagement_score,
    comment_id AS cid,
    CAST(coalesce(len(regexp_extract_all(comment_text, {EMOJI})), 0) AS BIGINT) AS emoji_count,
    CAST(coalesce(len(regexp_extract_all(regexp_replace(comment_text, {URL}, '', 'g'), {WORD})), 0) AS BIGINT) AS word_count,
    coalesce(regexp_matches(comment_text, {QUESTION}), false) AS is_q,
    coalesce(regexp_matches(lower(comment_text), {TOXIC}), false) AS is_toxic,
    coalesce(regexp_matches(lower(comment_text), {CTA}), false) AS is_cta
  FROM comments_v),
thr AS (
  SELECT post_id, quantile_cont(engagement_score, 0.75) AS high_engagement,
         quantile_cont(engagement_score, 0.5) AS median_engagement
  FROM enriched GROUP BY post_id)
"""


def W(body: str) -> str:
    return "WITH " + ENRICHED_SQL + body


def _card(src: str, order: str, k: int, part: str = "post_id") -> str:
    return f"""
SELECT post_id, rank, cid, user_name AS "user", comment_text AS text, sentiment AS sent, emotion AS emo,
       total_reactions AS react, engagement_score AS eng, permalink_url AS link
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS BIGINT) AS rank FROM {src})
WHERE rank <= {k}"""


SQL: dict[str, str] = {}

SQL["kpis"] = W(f"""
, hr AS (SELECT post_id, CAST(hour(created_time) AS BIGINT) AS h, count(*) AS n
         FROM enriched WHERE created_time IS NOT NULL GROUP BY ALL),
bh AS (SELECT post_id, h AS best_hour FROM (
         SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, h ASC) AS rn FROM hr) WHERE rn = 1),
ec AS (SELECT post_id, emotion, count(*) AS n FROM enriched WHERE emotion IS NOT NULL GROUP BY ALL),
te AS (SELECT post_id, emotion AS top_emotion FROM (
         SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, emotion ASC) AS rn FROM ec) WHERE rn = 1),
k AS (
  SELECT post_id, count(*) AS total_comments,
    CASE WHEN count(user_id) = 0 THEN count(DISTINCT user_name) ELSE count(DISTINCT user_id) END AS unique_users,
    CAST(sum(total_reactions) AS BIGINT) AS total_reactions,
    avg(total_reactions) AS avg_reactions_per_comment,
    quantile_cont(total_reactions, 0.5) AS median_reactions,
    quantile_cont(engagement_score, 0.5) AS median_engagement,
    100 * avg(CASE WHEN emoji_count > 0 THEN 1.0 ELSE 0.0 END) AS emoji_pct,
    count(DISTINCT {LANG}) AS language_diversity,
    count(*) FILTER (WHERE sentiment = 'positive') AS positive,
    count(*) FILTER (WHERE sentiment = 'negative') AS negative,
    (epoch_us(max(created_time)) - epoch_us(min(created_time))) / 3.6e9 AS span_h
  FROM enriched GROUP BY post_id)
SELECT k.post_id, total_comments, unique_users, total_reactions,
  round(avg_reactions_per_comment, 6) AS avg_reactions_per_comment,
  round(median_reactions, 6) AS median_reactions, round(median_engagement, 6) AS median_engagement,
  round(emoji_pct, 6) AS emoji_pct, language_diversity, positive, negative,
  greatest(total_comments - positive - negative, 0) AS neutral,
  round(positive * 100.0 / greatest(1, positive + negative), 6) AS positivity_ratio,
  round(greatest(0.0, 100.0 - negative * 100.0 / greatest(1, total_comments)), 6) AS safety_score,
  round(positive * 100.0 / greatest(1, total_comments), 6) AS advocacy,
  bh.best_hour,
  round(total_comments / coalesce(greatest(1.0, span_h), 1.0), 6) AS velocity_cph,
  coalesce(te.top_emotion, 'neutral') AS top_emotion
FROM k LEFT JOIN bh USING (post_id) LEFT JOIN te USING (post_id)
""")

SQL["top_comments_kpis"] = W("""
SELECT e.post_id, count(*) AS total, round(avg(total_reactions), 6) AS avg_reacts,
  round(count(*) FILTER (WHERE sentiment = 'positive') * 100.0 /
        greatest(1, count(*) FILTER (WHERE sentiment IN ('positive', 'negative'))), 6) AS positivity,
  count(*) FILTER (WHERE sentiment = 'negative') AS negatives,
  count(*) FILTER (WHERE is_q) AS questions,
  count(*) FILTER (WHERE engagement_score >= t.high_engagement) AS high_eng,
  count(*) FILTER (WHERE reply_count <= 0) AS unanswered,
  round(CASE WHEN count(*) FILTER (WHERE is_q) > 0 THEN
    count(*) FILTER (WHERE is_q AND reply_count > 0) * 100.0 / count(*) FILTER (WHERE is_q) END, 6)
    AS reply_coverage_questions_pct,
  round(any_value(t.high_engagement), 6) AS high_engagement,
  round(any_value(t.median_engagement), 6) AS median_engagement
FROM enriched e JOIN thr t USING (post_id) GROUP BY e.post_id
""")

SQL["sentiment_counts"] = W("""
, k AS (SELECT post_id, count(*) AS n, count(*) FILTER (WHERE sentiment = 'positive') AS p,
               count(*) FILTER (WHERE sentiment = 'negative') AS g FROM enriched GROUP BY post_id)
SELECT post_id, 'Positive' AS label, p AS value FROM k
UNION ALL SELECT post_id, 'Negative', g FROM k
UNION ALL SELECT post_id, 'Neutral', greatest(n - p - g, 0) FROM k
""")

SQL["emotion_counts"] = W("""
SELECT * FROM (
  SELECT post_id, label, value,
         CAST(row_number() OVER (PARTITION BY post_id ORDER BY value DESC, label ASC) AS BIGINT) AS rank
  FROM (SELECT post_id, emotion AS label, count(*) AS value FROM enriched WHERE emotion IS NOT NULL GROUP BY ALL))
WHERE rank <= 7
""")

SQL["language_counts"] = W(f"""
SELECT * FROM (
  SELECT post_id, label, value,
         CAST(row_number() OVER (PARTITION BY post_id ORDER BY value DESC, label ASC) AS BIGINT) AS rank
  FROM (SELECT post_id, {LANG} AS label, count(*) AS value FROM enriched GROUP BY ALL))
WHERE rank <= 6
""")

SQL["reaction_mix"] = W(" " + " UNION ALL ".join(
    f"SELECT post_id, '{t.upper()}' AS label, CAST(sum({t}_count) AS BIGINT) AS value FROM enriched GROUP BY post_id"
    for t in ("like", "love", "haha", "wow", "sad", "angry", "care")))

SQL["hourly_sentiment"] = W("""
, h AS (SELECT post_id, CAST(hour(created_time) AS BIGINT) AS hour,
          count(*) FILTER (WHERE sentiment = 'positive') AS pos,
          count(*) FILTER (WHERE sentiment = 'negative') AS neg, count(*) AS total
        FROM enriched WHERE created_time IS NOT NULL GROUP BY ALL),
sp AS (SELECT p.post_id, CAST(g.hour AS BIGINT) AS hour
       FROM (SELECT DISTINCT post_id FROM enriched) p, (SELECT unnest(generate_series(0, 23)) AS hour) g)
SELECT sp.post_id, sp.hour, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg,
       coalesce(total, 0) - coalesce(pos, 0) - coalesce(neg, 0) AS neu, coalesce(total, 0) AS total
FROM sp LEFT JOIN h USING (post_id, hour)
""")

for _col in ("sentiment", "emotion"):
    SQL[f"engagement_by_{_col}"] = W(f"""
SELECT post_id, {_col}, engagement,
       CAST(row_number() OVER (PARTITION BY post_id ORDER BY engagement DESC, {_col} ASC) AS BIGINT) AS rank
FROM (SELECT post_id, {_col}, CAST(sum(engagement_score) AS BIGINT) AS engagement FROM enriched GROUP BY ALL)
""")

SQL["influencers"] = W("""
SELECT * FROM (
  SELECT post_id, user_name, comments, round(avg_reacts, 6) AS avg_reacts, eng,
    CAST(row_number() OVER (PARTITION BY post_id ORDER BY eng DESC, comments DESC, user_name ASC) AS BIGINT) AS rank
  FROM (SELECT post_id, user_name, count(comment_text) AS comments, avg(total_reactions) AS avg_reacts,
               CAST(sum(engagement_score) AS BIGINT) AS eng
        FROM enriched WHERE user_name IS NOT NULL GROUP BY ALL))
WHERE rank <= 8
""")

SQL["pareto_share"] = W("""
, r AS (SELECT post_id, engagement_score,
          row_number() OVER (PARTITION BY post_id ORDER BY engagement_score DESC, cid ASC) AS rn FROM enriched)
SELECT post_id, round(100.0 * sum(engagement_score) FILTER (WHERE rn <= 10) / greatest(1.0, sum(engagement_score)), 6)
       AS pareto_top10_pct
FROM r GROUP BY post_id
""")

SQL["content_intel"] = W(f"""
, w AS (SELECT post_id, is_cta, is_toxic,
          list_filter(regexp_split_to_array(coalesce(comment_text, ''), '{SPACE}+'), lambda x: length(x) > 0) AS ws
        FROM enriched)
SELECT post_id, count(*) FILTER (WHERE is_cta) AS cta_hits,
  round(avg(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) / greatest(1, len(ws))), 6) AS readability,
  round(100.0 * avg(CASE WHEN is_toxic THEN 1.0 ELSE 0.0 END), 6) AS tox_rate
FROM w GROUP BY post_id
""")

SQL["top_loved"] = W(_card("(SELECT * FROM enriched WHERE love_count > 0)", "love_count DESC, cid ASC", 5))
SQL["top_haha"] = W(_card("(SELECT * FROM enriched WHERE haha_count > 0)", "haha_count DESC, cid ASC", 5))
SQL["top_reacted"] = W(_card("enriched", "total_reactions DESC, cid ASC", 5))
SQL["top_engaged"] = W(_card("enriched", "engagement_score DESC, cid ASC", 5))
SQL["examples"] = W(_card("(SELECT * FROM enriched WHERE sentiment IN ('positive', 'negative'))",
                          "engagement_score DESC, cid ASC", 3, part="post_id, sentiment")
                    .replace("sentiment AS sent", "sentiment AS kind"))
_RISK = ("(SELECT e.* FROM enriched e JOIN thr t USING (post_id) "
         "WHERE e.sentiment = 'negative' AND e.engagement_score >= t.high_engagement)")
SQL["risks"] = W(_card(_RISK, "engagement_score DESC, cid ASC", 5))
SQL["reply_queue"] = W(_card(_RISK, "engagement_score DESC, cid ASC", 10))
SQL["question_bank"] = W(_card("(SELECT * FROM enriched WHERE is_q AND reply_count <= 0)",
                               "engagement_score DESC, cid ASC", 10))
SQL["recent_toxic"] = W(_card(
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY created_time DESC NULLS LAST, cid ASC) AS rr "
    "FROM enriched) WHERE rr <= 200 AND is_toxic)", "engagement_score DESC, cid ASC", 5))


def oracle_sql() -> dict[str, str]:
    from . import sql_more, sql_sources
    out = dict(SQL)
    out.update(sql_more.SQL)
    out.update(sql_sources.SQL)
    return out
