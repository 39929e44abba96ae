"""More oracle SQL (text, time)."""

from . import fixed as X

from .sql import SQL as BASE_SQL
from .sql import LANG, SPACE, URL, W, _q

STOP = "[" + ", ".join(_q(w) for w in X.STOPWORDS) + "]"
SQL: dict[str, str] = {}

_TOKENS = f"""
, tk AS (SELECT post_id, sentiment,
           unnest(regexp_extract_all(regexp_replace(lower(comment_text), {URL}, '', 'g'),
                                     '([#@]?[\\p{{L}}\\p{{N}}_]+)', 1)) AS word
         FROM enriched),
kp AS (SELECT * FROM tk WHERE word LIKE '#%' OR word LIKE '@%'
         OR (NOT list_contains({STOP}, word) AND NOT regexp_full_match(word, '\\p{{Nd}}+') AND length(word) >= 3)),
tc AS (SELECT post_id, word, count(*) AS c_all,
         count(*) FILTER (WHERE sentiment = 'positive') AS c_pos,
         count(*) FILTER (WHERE sentiment = 'negative') AS c_neg
       FROM kp GROUP BY ALL),
sc AS (SELECT * FROM (
         SELECT post_id, word, 'all' AS scope, c_all AS count FROM tc
         UNION ALL SELECT post_id, word, 'pos', c_pos FROM tc
         UNION ALL SELECT post_id, word, 'neg', c_neg FROM tc) WHERE count > 0),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY post_id, scope ORDER BY count DESC, word ASC) AS BIGINT) AS rank
       FROM sc)
"""

SQL["keyword_counts"] = W(_TOKENS + """
SELECT post_id, scope, rank, word, count FROM rk
WHERE rank <= CASE scope WHEN 'all' THEN 15 ELSE 10 END
""")

SQL["top_keyword"] = W(_TOKENS + """
SELECT p.post_id, coalesce(r.word, '') AS top_keyword
FROM (SELECT DISTINCT post_id FROM enriched) p
LEFT JOIN (SELECT post_id, word FROM rk WHERE scope = 'all' AND rank = 1) r USING (post_id)
""")

SQL["hashtag_counts"] = W(f"""
, tg AS (SELECT post_id, unnest(regexp_split_to_array(coalesce(comment_text, ''), '{SPACE}+')) AS tag FROM enriched),
c AS (SELECT post_id, tag, count(*) AS count FROM tg WHERE tag LIKE '#%' GROUP BY ALL)
SELECT * FROM (SELECT post_id, tag, count,
  CAST(row_number() OVER (PARTITION BY post_id ORDER BY count DESC, tag ASC) AS BIGINT) AS rank FROM c)
WHERE rank <= 10
""")

_BINS = """
, tm AS (SELECT post_id, cid, epoch_us(created_time) AS us, emotion, sentiment, total_reactions
         FROM enriched WHERE created_time IS NOT NULL),
pb AS (SELECT post_id, min(us) AS tmin, max(us) AS tmax FROM tm GROUP BY post_id),
pw AS (SELECT *, CAST(CASE WHEN greatest(1e-6, (tmax - tmin) / 3.6e9) <= 6 THEN 900 ELSE 3600 END AS BIGINT) AS width_s
       FROM pb),
pw2 AS (SELECT *, CAST(floor(tmin / (width_s * 1000000)) AS BIGINT) AS b0,
               CAST(floor(tmax / (width_s * 1000000)) AS BIGINT) AS b1 FROM pw),
tb AS (SELECT tm.*, pw2.width_s, pw2.b0, CAST(floor(us / (pw2.width_s * 1000000)) AS BIGINT) AS bin
       FROM tm JOIN pw2 USING (post_id)),
cnt AS (SELECT post_id, bin, count(*) AS c FROM tb GROUP BY ALL),
sp AS (SELECT post_id, width_s, b0, unnest(generate_series(b0, b1)) AS bin FROM pw2),
tl AS (SELECT sp.post_id, sp.bin - sp.b0 AS idx, sp.bin, sp.width_s, coalesce(cnt.c, 0) AS count,
              strftime(make_timestamp(sp.bin * sp.width_s * 1000000), '%Y-%m-%d %H:%M') AS t
       FROM sp LEFT JOIN cnt USING (post_id, bin))
"""

SQL["timeline"] = W(_BINS + "SELECT post_id, idx, t, count, width_s FROM tl")

SQL["daily_timeline"] = W("""
SELECT post_id, strftime(created_time, '%Y-%m-%d') AS day, count(*) AS count
FROM enriched WHERE created_time IS NOT NULL GROUP BY ALL
""")

SQL["forecast_next_day"] = W("""
, d AS (SELECT post_id, strftime(created_time, '%Y-%m-%d') AS day, count(*) AS c
        FROM enriched WHERE created_time IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY day DESC) AS rn FROM d),
p AS (SELECT post_id, max(c) FILTER (WHERE rn = 1) AS last, max(c) FILTER (WHERE rn = 2) AS prev,
             count(*) FILTER (WHERE rn <= 2) AS n_days FROM r GROUP BY post_id),
n AS (SELECT post_id, count(*) AS n FROM enriched GROUP BY post_id)
SELECT n.post_id, CAST(CASE WHEN n.n >= 30 AND p.n_days >= 2 THEN greatest(0, 2 * p.last - p.prev) END AS BIGINT)
       AS forecast
FROM n LEFT JOIN p USING (post_id)
""")

_STACK = _BINS + """
, ec AS (SELECT post_id, emotion, count(*) AS n FROM enriched WHERE emotion IS NOT NULL GROUP BY ALL),
te AS (SELECT post_id, emotion FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, emotion ASC) AS rn
       FROM ec) WHERE rn <= 5),
bc AS (SELECT post_id, bin, emotion, count(*) AS c FROM tb WHERE emotion IS NOT NULL GROUP BY ALL),
ne AS (SELECT DISTINCT post_id, bin FROM bc),
st AS (SELECT ne.post_id, ne.bin, te.emotion, coalesce(bc.c, 0) AS count, pw2.width_s
       FROM ne JOIN te USING (post_id) JOIN pw2 USING (post_id)
       LEFT JOIN bc ON bc.post_id = ne.post_id AND bc.bin = ne.bin AND bc.emotion = te.emotion)
"""

SQL["emotion_stack"] = W(_STACK + """
SELECT post_id, bin,
  CASE WHEN width_s = 900 THEN strftime(make_timestamp(bin * width_s * 1000000), '%H:%M')
       ELSE strftime(make_timestamp(bin * width_s * 1000000), '%Y-%m-%d %H:%M') END AS t,
  emotion, count, width_s
FROM st
""")

for _mode, _frame in (("literal", "2 PRECEDING AND CURRENT ROW"), ("trailing", "3 PRECEDING AND 1 PRECEDING")):
    SQL[f"spikes_{_mode}"] = W(_STACK + f"""
, z AS (SELECT *, avg(count) OVER w AS mu, stddev_samp(count) OVER w AS sd, count(count) OVER w AS nn
        FROM st WINDOW w AS (PARTITION BY post_id, emotion ORDER BY bin ROWS BETWEEN {_frame})),
f AS (SELECT post_id, emotion, count, (count - mu) / sd AS z,
             strftime(make_timestamp(bin * width_s * 1000000), '%Y-%m-%d %H:%M') AS t
      FROM z WHERE nn = 3 AND sd > 0)
SELECT post_id, rank, t, emotion, round(z, 6) AS z, count AS value FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY post_id ORDER BY z DESC, t ASC, emotion ASC) AS BIGINT) AS rank
  FROM f WHERE z >= 2 AND count >= 2)
WHERE rank <= 8
""")

SQL["decay_fit"] = W(_BINS + """
, st AS (SELECT post_id, count(*) AS n_bins, max(count) AS mx FROM tl GROUP BY post_id),
pk AS (SELECT tl.post_id, min(idx) AS peak_index FROM tl JOIN st USING (post_id) WHERE count = mx GROUP BY tl.post_id),
ft AS (SELECT tl.post_id, regr_slope(ln(greatest(count, 1e-6)), CAST(idx - pk.peak_index AS DOUBLE)) AS slope,
              regr_intercept(ln(greatest(count, 1e-6)), CAST(idx - pk.peak_index AS DOUBLE)) AS intercept
       FROM tl JOIN pk USING (post_id) JOIN st USING (post_id)
       WHERE st.n_bins >= 4 AND idx >= pk.peak_index GROUP BY tl.post_id)
SELECT st.post_id, n_bins, peak_index, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(CASE WHEN slope < 0 THEN -1.0 / slope END, 2) AS tau_bins
FROM st JOIN pk USING (post_id) LEFT JOIN ft USING (post_id)
""")

SQL["decay_curve"] = W(_BINS + """
, st AS (SELECT post_id, count(*) AS n_bins, max(count) AS mx FROM tl GROUP BY post_id),
pk AS (SELECT tl.post_id, min(idx) AS peak_index FROM tl JOIN st USING (post_id) WHERE count = mx GROUP BY tl.post_id),
ft AS (SELECT tl.post_id, regr_slope(ln(greatest(count, 1e-6)), CAST(idx - pk.peak_index AS DOUBLE)) AS slope,
              regr_intercept(ln(greatest(count, 1e-6)), CAST(idx - pk.peak_index AS DOUBLE)) AS intercept
       FROM tl JOIN pk USING (post_id) JOIN st USING (post_id)
       WHERE st.n_bins >= 4 AND idx >= pk.peak_index GROUP BY tl.post_id)
SELECT tl.post_id, idx, t, count, round(CASE WHEN idx >= peak_index THEN exp(intercept + slope * (idx - peak_index)) END, 6) AS fitted
FROM tl JOIN pk USING (post_id) LEFT JOIN ft USING (post_id)
""")

SQL["half_life"] = W(_BINS + """
, c AS (SELECT *, sum(count) OVER (PARTITION BY post_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
               sum(count) OVER (PARTITION BY post_id) AS total FROM tl)
SELECT post_id,
  round(min(idx) FILTER (WHERE total > 0 AND cum >= 0.5 * total) * CASE WHEN any_value(width_s) = 900 THEN 0.25 ELSE 1.0 END, 6)
    AS half_life_hours,
  round(min(idx) FILTER (WHERE total >= 10 AND cum >= 10) * CASE WHEN any_value(width_s) = 900 THEN 0.25 ELSE 1.0 END, 6)
    AS t_first10_hours
FROM c GROUP BY post_id
""")

SQL["reaction_curve"] = W("""
, tm AS (SELECT post_id, epoch_us(created_time) AS us, total_reactions FROM enriched WHERE created_time IS NOT NULL),
f AS (SELECT post_id, min(us) AS t0 FROM tm GROUP BY post_id)
SELECT post_id, CAST(floor((us - t0) / 3600000000) AS BIGINT) AS age_h, round(avg(total_reactions), 6) AS value
FROM tm JOIN f USING (post_id) GROUP BY ALL
""")

SQL["contagion"] = W("""
, tm AS (SELECT post_id, cid, epoch_us(created_time) AS us, sentiment FROM enriched WHERE created_time IS NOT NULL),
lg AS (SELECT *, lag(us) OVER w AS pus, lag(sentiment) OVER w AS ps FROM tm
       WINDOW w AS (PARTITION BY post_id ORDER BY us, cid)),
pr AS (SELECT post_id, ps AS prev, sentiment AS next, count(*) AS pairs FROM lg
       WHERE pus IS NOT NULL AND us - pus <= 1800000000 GROUP BY ALL),
b AS (SELECT post_id, count(*) AS n, count(*) FILTER (WHERE sentiment = 'positive') AS bp,
             count(*) FILTER (WHERE sentiment = 'neutral') AS bu,
             count(*) FILTER (WHERE sentiment = 'negative') AS bn FROM enriched GROUP BY post_id),
lb AS (SELECT * FROM (VALUES ('positive'), ('neutral'), ('negative')) v(s)),
g AS (SELECT b.*, a.s AS prev, c.s AS next FROM b, lb a, lb c),
j AS (SELECT g.*, coalesce(pr.pairs, 0) AS pairs FROM g LEFT JOIN pr USING (post_id, prev, next)),
k AS (SELECT *, sum(pairs) OVER (PARTITION BY post_id, prev) AS rt,
        CASE next WHEN 'positive' THEN bp WHEN 'neutral' THEN bu ELSE bn END AS bcount FROM j)
SELECT post_id, prev, next, pairs,
  round((pairs / CASE WHEN rt = 0 THEN 1 ELSE rt END) / CASE WHEN bcount > 0 THEN bcount / n ELSE 1e-9 END, 6) AS lift
FROM k
""")

# JN3 / FN4 / FN5: brute force over every pair in a post, string shingles.
SQL["similar_pairs"] = W(f"""
, it AS (SELECT post_id, cid, coalesce(epoch_us(created_time), 9223372036854775807) AS ord,
                trim(regexp_replace(lower(comment_text), '{SPACE}+', ' ', 'g')) AS s
         FROM enriched WHERE comment_text IS NOT NULL AND length(comment_text) >= 12),
sh AS (SELECT post_id, cid, ord,
         CASE WHEN length(s) = 0 THEN []
              WHEN length(s) <= 3 THEN [s]
              ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) END AS sh
       FROM it),
pr AS (SELECT a.post_id, a.cid AS cid_a, b.cid AS cid_b, len(list_intersect(a.sh, b.sh)) AS o,
              len(a.sh) + len(b.sh) AS t
       FROM sh a JOIN sh b ON a.post_id = b.post_id AND (a.ord < b.ord OR (a.ord = b.ord AND a.cid < b.cid))
       WHERE len(a.sh) > 0 AND len(b.sh) > 0)
SELECT post_id, cid_a, cid_b, CAST(o AS BIGINT) AS overlap, CAST(t - o AS BIGINT) AS union_size,
       round(o / greatest(1, t - o), 6) AS jaccard
FROM pr WHERE o * 20 >= (t - o) * 11
""")

_SNAPS = """
, sn AS (
  SELECT post_id, make_timestamp(CAST(floor(epoch_us(created_time) / 21600000000) AS BIGINT) * 21600000000) AS ts,
    count(*) AS total_comments,
    count(*) FILTER (WHERE sentiment = 'positive') * 100.0 / greatest(1, count(*)) AS advocacy,
    greatest(0.0, 100.0 - count(*) FILTER (WHERE sentiment = 'negative') * 100.0 / greatest(1, count(*))) AS safety_score,
    avg(total_reactions) AS avg_reactions_per_comment,
    count(*) FILTER (WHERE sentiment = 'positive') * 100.0 /
      greatest(1, count(*) FILTER (WHERE sentiment IN ('positive', 'negative'))) AS positivity_ratio,
    quantile_cont(engagement_score, 0.5) AS median_engagement
  FROM enriched WHERE created_time IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY ts, post_id) AS rn FROM sn)
"""
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"

SQL["kpi_snapshots"] = W(_SNAPS + f"""
SELECT post_id, {_TS}, total_comments, round(advocacy, 6) AS advocacy, round(safety_score, 6) AS safety_score,
  round(avg_reactions_per_comment, 6) AS avg_reactions_per_comment, round(positivity_ratio, 6) AS positivity_ratio,
  round(median_engagement, 6) AS median_engagement
FROM sn
""")

SQL["latest_snapshot"] = W(_SNAPS + f"""
SELECT post_id, {_TS}, total_comments, round(advocacy, 6) AS advocacy, round(safety_score, 6) AS safety_score,
  round(avg_reactions_per_comment, 6) AS avg_reactions_per_comment, round(positivity_ratio, 6) AS positivity_ratio,
  round(median_engagement, 6) AS median_engagement
FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ts DESC) AS r FROM sn) WHERE r = 1
""")

SQL["benchmark_percentiles"] = W(_SNAPS + f"""
, j AS (
  SELECT a.rn, a.post_id, a.ts, count(*) AS count_history,
""" + ",\n".join(
    f"    100.0 * count(*) FILTER (WHERE b.{m} <= a.{m}) / count(b.{m}) AS pct_{m}"
    for m in ("advocacy", "safety_score", "avg_reactions_per_comment", "total_comments")) + f"""
  FROM o a JOIN o b ON b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY a.rn, a.post_id, a.ts)
SELECT rn, post_id, {_TS}, count_history, round(pct_advocacy, 6) AS pct_advocacy,
  round(pct_safety_score, 6) AS pct_safety_score,
  round(pct_avg_reactions_per_comment, 6) AS pct_avg_reactions_per_comment,
  round(pct_total_comments, 6) AS pct_total_comments
FROM j
""")

# One current row per post, all of one time: the upsert view is these rows, in order of post.
SQL["benchmark_current"] = "WITH k AS (" + BASE_SQL["kpis"] + """),
o AS (SELECT post_id, total_comments, advocacy, safety_score, avg_reactions_per_comment,
             row_number() OVER (ORDER BY post_id) AS rn FROM k)
SELECT a.rn, a.post_id, '2030-01-01 00:00:00' AS ts, count(*) AS count_history,
""" + ",\n".join(
    f"  round(100.0 * count(*) FILTER (WHERE b.{m} <= a.{m}) / count(b.{m}), 6) AS pct_{m}"
    for m in ("advocacy", "safety_score", "avg_reactions_per_comment", "total_comments")) + """
FROM o a JOIN o b ON b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY a.rn, a.post_id
"""

SQL["kpi_deltas"] = W(_SNAPS + f"""
, po AS (SELECT a.rn, max(b.rn) AS prn FROM o a LEFT JOIN o b ON b.rn < a.rn AND b.post_id <> a.post_id GROUP BY a.rn)
SELECT a.rn, a.post_id, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS ts, p.post_id AS prev_post_id,
""" + ",\n".join(
    f"  round(CAST(a.{m} - coalesce(p.{m}, 0) AS DOUBLE), 6) AS delta_{m}"
    for m in ("total_comments", "avg_reactions_per_comment", "positivity_ratio", "median_engagement")) + """
FROM o a JOIN po USING (rn) LEFT JOIN o p ON p.rn = po.prn
""")


SQL["row_payload"] = W("""
SELECT post_id, cid, user_name, comment_text, sentiment, emotion, total_reactions, engagement_score, reply_count,
       strftime(created_time, '%Y-%m-%d %H:%M:%S') AS created_time, language, permalink_url
FROM enriched
""")

_WIN = """
, b AS (SELECT post_id, max(created_time) AS tmax FROM enriched GROUP BY post_id),
wd AS (SELECT e.* FROM enriched e JOIN b USING (post_id)
       WHERE e.created_time >= b.tmax - INTERVAL {n} HOUR AND e.created_time <= b.tmax)
"""

SQL["window_payload"] = W(_WIN.format(n=24) + """
SELECT post_id, cid, user_name, comment_text, sentiment, emotion, total_reactions, engagement_score, permalink_url
FROM wd
""")

SQL["window_kpis"] = BASE_SQL["kpis"].replace("\n, hr AS", _WIN.format(n=72) + ", hr AS").replace(
    "FROM enriched", "FROM wd").replace("wd AS (SELECT e.* FROM wd e", "wd AS (SELECT e.* FROM enriched e").replace(
    "b AS (SELECT post_id, max(created_time) AS tmax FROM wd", "b AS (SELECT post_id, max(created_time) AS tmax FROM enriched")



def _window_kpis(hours: int) -> str:
    return BASE_SQL["kpis"].replace("\n, hr AS", _WIN.format(n=hours) + ", hr AS").replace(
        "FROM enriched", "FROM wd").replace("wd AS (SELECT e.* FROM wd e", "wd AS (SELECT e.* FROM enriched e").replace(
        "b AS (SELECT post_id, max(created_time) AS tmax FROM wd", "b AS (SELECT post_id, max(created_time) AS tmax FROM enriched")


# --- fixed values: the range presets in hours; the last one holds every comment with a time ---
_PRESET_HOURS = {"3h": 3, "6h": 6, "12h": 12, "24h": 24, "3d": 72, "7d": 168, "30d": 720, "all": 10_000_000}

SQL["preset_kpis"] = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS \"range\", t.* FROM ({_window_kpis(hours)}) t" for name, hours in _PRESET_HOURS.items())

_UNIQUES = """
, w AS (SELECT post_id, d, date_trunc('day', max(created_time)) + INTERVAL 1 DAY AS e FROM enriched, (VALUES (1), (3), (7), (30)) v(d) GROUP BY ALL)
SELECT w.post_id, CAST(d AS VARCHAR) || 'd' AS "window", {columns}
FROM w JOIN enriched e ON e.post_id = w.post_id AND e.created_time < w.e AND e.created_time >= w.e - d * INTERVAL 1 DAY
GROUP BY w.post_id, d
"""

SQL["unique_windows"] = W(_UNIQUES.format(columns=f"""CASE WHEN count(user_id) = 0 THEN count(DISTINCT user_name) ELSE count(DISTINCT user_id) END AS unique_users,
  count(DISTINCT {LANG}) AS language_diversity"""))

# the estimates themselves depend on the sketch; that they keep to their error doesn't
SQL["unique_windows_sketched"] = W(_UNIQUES.format(columns="true AS within_error"))

SQL["filtered_comments"] = W("""
SELECT e.post_id, e.cid, e.engagement_score FROM enriched e JOIN thr t USING (post_id)
WHERE coalesce(contains(lower(e.comment_text), 'an'), false) AND e.sentiment = 'positive'
  AND e.engagement_score >= t.high_engagement
""")

SQL["unhandled_comments"] = W("""
SELECT post_id, cid, reply_count FROM enriched WHERE NOT (reply_count >= 3)
""")

SQL["reaction_backfill"] = W("""
SELECT post_id, comment_id, like_count, love_count, haha_count, wow_count, sad_count, angry_count, care_count
FROM comments_v
""")


def _link_expr() -> str:
    parts = []
    for pat, groups in X.LINK_IDS:
        qp = _q(pat)
        val = (f"regexp_extract(url, {qp}, 1)" if groups == 1 else
               f"regexp_extract(url, {qp}, 1) || '_' || regexp_extract(url, {qp}, 2)")
        parts.append(f"CASE WHEN regexp_matches(url, {qp}) THEN {val} END")
    parts.append(f"CASE WHEN regexp_matches(url, {_q(X.RAW_ID)}) THEN url END")
    return "coalesce(" + ", ".join(parts) + ")"


_LANDED = """
landed AS (
  SELECT page_id AS n, url AS message, 'post_' || CAST(page_id // 10 AS VARCHAR) AS post_id,
    CASE WHEN page_id % 41 = 7 AND page_id % 10 > 0 THEN page_id - 1 WHEN page_id % 10 < 9 THEN page_id + 1 END AS nx,
    CASE WHEN page_id % 53 = 3 THEN 'unreadable' WHEN page_id % 59 = 4 THEN 'empty' WHEN page_id % 61 = 6 THEN 'no data' END AS reason,
    page_id % 43 = 2 AS twice
  FROM pages WHERE page_id % 37 <> 5),
good AS (SELECT * FROM landed WHERE reason IS NULL)
"""

SQL["page_comments"] = "WITH " + _LANDED + """
SELECT post_id, 'c' || CAST(n AS VARCHAR) AS comment_id, coalesce(message, '') AS comment_text FROM good
"""

SQL["page_quarantine"] = "WITH " + _LANDED + """
SELECT post_id, lpad(CAST(n AS VARCHAR), 12, '0') || '-1' AS place, reason FROM landed WHERE reason IS NOT NULL
UNION ALL
SELECT post_id, lpad(CAST(n AS VARCHAR), 12, '0') || '-2', coalesce(reason, 'repeated') FROM landed WHERE twice
"""

# every chain has ten places at most, so walking it page by page ends
SQL["page_chains"] = "WITH RECURSIVE " + _LANDED + """,
walk AS (
  SELECT n AS start, n AS here, 1 AS step FROM good
  UNION ALL
  SELECT w.start, g2.n, w.step + 1 FROM walk w JOIN good g ON g.n = w.here JOIN good g2 ON g2.n = g.nx WHERE w.step < 25),
ends AS (
  SELECT start, max(step) AS steps, min('u' || CAST(here AS VARCHAR)) AS least FROM walk GROUP BY start),
stop AS (
  SELECT e.start, e.steps, e.least, g.nx AS missing FROM ends e JOIN walk w ON w.start = e.start AND w.step = e.steps JOIN good g ON g.n = w.here)
SELECT g.post_id, 'u' || CAST(s.start AS VARCHAR) AS head, CAST(s.steps AS BIGINT) AS pages, CAST(s.steps AS BIGINT) AS comments,
  CASE WHEN s.missing IS NULL THEN 'complete' ELSE 'broken' END AS status, 'u' || CAST(s.missing AS VARCHAR) AS missing
FROM stop s JOIN good g ON g.n = s.start
WHERE s.steps < 25 AND NOT EXISTS (SELECT 1 FROM good p WHERE p.nx = s.start AND p.post_id = g.post_id)
UNION ALL
SELECT g.post_id, s.least, count(*), count(*), 'cyclic', NULL FROM stop s JOIN good g ON g.n = s.start WHERE s.steps = 25 GROUP BY g.post_id, s.least
"""

SQL["snapshot_store"] = SQL["kpi_snapshots"]

# The test urls carry no id; nine in ten are given one of the shapes.
SQL["link_ids"] = f"""
WITH l AS (SELECT page_id, '10' || CAST(page_id AS VARCHAR) AS n, url AS old FROM pages),
u AS (SELECT page_id, CASE page_id % 10
    WHEN 0 THEN 'https://www.facebook.com/reel/' || n WHEN 1 THEN 'https://www.facebook.com/some.page/videos/' || n || '/'
    WHEN 2 THEN 'https://FACEBOOK.com/watch/?v=' || n WHEN 3 THEN 'https://m.example.com/x?a=1&v=' || n
    WHEN 4 THEN 'https://www.facebook.com/photo.php?set=a&fbid=' || n WHEN 5 THEN 'https://www.facebook.com/permalink.php?story_fbid=' || n || '&id=7'
    WHEN 6 THEN 'https://www.facebook.com/some.page/posts/' || n WHEN 7 THEN 'https://www.facebook.com/groups/77/permalink/' || n
    WHEN 8 THEN chr(160) || n || '_5' || chr(12288) ELSE old END AS url FROM l),
s AS (SELECT page_id, url, regexp_replace(url, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM u)
SELECT page_id, url, CASE WHEN length(t) = 0 THEN NULL ELSE {_link_expr().replace('url', 't')} END AS object_id
FROM s
"""

# Texts, times and users are left out of every 9th, 10th and 8th comment.
SQL["data_quality"] = W("""
, h AS (SELECT post_id, CAST(substr(cid, 5) AS BIGINT) AS n, comment_text, created_time, user_id FROM enriched),
d AS (SELECT post_id, CASE WHEN n % 9 <> 0 THEN comment_text END AS comment_text,
             CASE WHEN n % 10 <> 0 THEN created_time END AS created_time, CASE WHEN n % 8 <> 0 THEN user_id END AS user_id FROM h)
SELECT post_id, count(*) AS rows,
  round(100.0 * count(comment_text) / count(*), 6) AS text_coverage_pct,
  round(100.0 * count(created_time) / count(*), 6) AS ts_coverage_pct,
  round(100.0 * count(user_id) / count(*), 6) AS user_coverage_pct,
  strftime(max(created_time), '%Y-%m-%d %H:%M:%S') AS newest_comment,
  round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(created_time))) / 3.6e9, 6) AS age_hours
FROM d GROUP BY post_id
""")

SQL["modal_labels"] = W("""
, s AS (SELECT post_id, sentiment AS v, count(*) AS n FROM enriched WHERE sentiment IS NOT NULL GROUP BY ALL),
e AS (SELECT post_id, emotion AS v, count(*) AS n FROM enriched WHERE emotion IS NOT NULL GROUP BY ALL),
ms AS (SELECT post_id, v FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, v ASC) AS r FROM s) WHERE r = 1),
me AS (SELECT post_id, v FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, v ASC) AS r FROM e) WHERE r = 1)
SELECT p.post_id, ms.v AS modal_sentiment, me.v AS modal_emotion
FROM (SELECT DISTINCT post_id FROM enriched) p LEFT JOIN ms USING (post_id) LEFT JOIN me USING (post_id)
""")

# SIM1-SIM3 + TOP13: the greedy loop itself, as a recursive walk over each post's
# items in row order carrying the list of leaders so far.
_GREEDY = f"""
, it AS (SELECT post_id, cid, user_name, comment_text, engagement_score,
                coalesce(epoch_us(created_time), 9223372036854775807) AS ord,
                trim(regexp_replace(lower(comment_text), '{SPACE}+', ' ', 'g')) AS s
         FROM enriched WHERE comment_text IS NOT NULL AND length(comment_text) >= 12),
itr AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ord, cid) AS rn FROM it),
sh AS (SELECT post_id, cid, ord,
         CASE WHEN length(s) = 0 THEN [] WHEN length(s) <= 3 THEN [s]
              ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) END AS sh
       FROM it),
pr AS (SELECT a.post_id, a.cid AS cid_a, b.cid AS cid_b, len(list_intersect(a.sh, b.sh)) AS o,
              len(a.sh) + len(b.sh) AS t
       FROM sh a JOIN sh b ON a.post_id = b.post_id AND (a.ord < b.ord OR (a.ord = b.ord AND a.cid < b.cid))
       WHERE len(a.sh) > 0 AND len(b.sh) > 0),
pairs AS (SELECT post_id, cid_a, cid_b FROM pr WHERE o * 20 >= (t - o) * 11),
nb AS (SELECT post_id, cid_b, list(cid_a) AS nbrs FROM pairs GROUP BY ALL),
walk AS (
  WITH RECURSIVE w(post_id, rn, leaders) AS (
    SELECT post_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT post_id FROM itr)
    UNION ALL
    SELECT w.post_id, w.rn + 1,
      CASE WHEN len(list_intersect(coalesce(nb.nbrs, CAST([] AS VARCHAR[])), w.leaders)) = 0
           THEN list_append(w.leaders, i.cid) ELSE w.leaders END
    FROM w JOIN itr i ON i.post_id = w.post_id AND i.rn = w.rn + 1
    LEFT JOIN nb ON nb.post_id = i.post_id AND nb.cid_b = i.cid)
  SELECT * FROM w),
fin AS (SELECT post_id, arg_max(leaders, rn) AS leaders FROM walk GROUP BY post_id),
ld AS (SELECT post_id, unnest(leaders) AS leader FROM fin),
mem AS (SELECT p.post_id, p.cid_b AS cid, arg_min(p.cid_a, ia.rn) AS leader
        FROM pairs p JOIN ld ON ld.post_id = p.post_id AND ld.leader = p.cid_a
        JOIN itr ia ON ia.post_id = p.post_id AND ia.cid = p.cid_a
        WHERE NOT EXISTS (SELECT 1 FROM ld l2 WHERE l2.post_id = p.post_id AND l2.leader = p.cid_b)
        GROUP BY p.post_id, p.cid_b),
asg AS (SELECT post_id, cid, leader FROM mem UNION ALL SELECT post_id, leader, leader FROM ld),
gm AS (SELECT a.post_id, a.leader, a.cid, i.user_name, i.comment_text, i.engagement_score, i.ord,
              CAST(length(i.comment_text) AS BIGINT) AS text_len,
              count(*) OVER (PARTITION BY a.post_id, a.leader) AS cnt,
              row_number() OVER (PARTITION BY a.post_id, a.leader
                                 ORDER BY i.engagement_score DESC, length(i.comment_text), i.ord, i.cid) AS mr
       FROM asg a JOIN itr i ON i.post_id = a.post_id AND i.cid = a.cid),
grp AS (SELECT g.post_id, g.leader, g.cnt AS count, g.cid AS rep_cid, g.comment_text AS rep_text,
               g.engagement_score AS rep_eng, li.ord AS lord
        FROM gm g JOIN itr li ON li.post_id = g.post_id AND li.cid = g.leader
        WHERE g.mr = 1 AND g.cnt >= 2),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY post_id ORDER BY count DESC, rep_eng DESC, lord, leader)
                     AS BIGINT) AS rank FROM grp)
"""

SQL["similar_groups"] = W(_GREEDY + """
SELECT post_id, rank, leader, CAST(count AS BIGINT) AS count, rep_cid, rep_text, rep_eng FROM rk WHERE rank <= 10
""")

SQL["similar_group_members"] = W(_GREEDY + """
SELECT g.post_id, g.leader, g.cid, g.user_name AS "user", g.comment_text AS text, g.engagement_score AS eng,
       g.text_len, g.ord
FROM gm g JOIN rk ON rk.post_id = g.post_id AND rk.leader = g.leader
""")

SQL["comment_text_stats"] = W(f"""
, b AS (SELECT *, trim(regexp_replace(lower(coalesce(comment_text, '')), '{SPACE}+', ' ', 'g')) AS s,
          regexp_extract_all(regexp_replace(lower(comment_text), {URL}, '', 'g'), '([#@]?[\\p{{L}}\\p{{N}}_]+)', 1) AS rt,
          list_filter(regexp_split_to_array(coalesce(comment_text, ''), '{SPACE}+'), lambda x: length(x) > 0) AS ws
        FROM enriched)
SELECT post_id, cid, word_count, emoji_count, is_q AS is_question, is_cta, is_toxic,
  CAST(coalesce(len(list_filter(rt, lambda t: t LIKE '#%' OR t LIKE '@%' OR
        (NOT list_contains({STOP}, t) AND NOT regexp_full_match(t, '\\p{{Nd}}+') AND length(t) >= 3))), 0) AS BIGINT)
    AS n_tokens,
  CAST(CASE WHEN length(s) = 0 THEN 0 WHEN length(s) <= 3 THEN 1
       ELSE len(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) END AS BIGINT)
    AS n_shingles,
  CAST(len(list_filter(ws, lambda w: w LIKE '#%')) AS BIGINT) AS n_hashtags,
  round(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) / greatest(1, len(ws)), 6) AS mean_word_len
FROM b
""")

# FN13: highlight lines built from the KPI row and the top keyword.
SQL["story_highlights"] = (
    "WITH k AS (" + BASE_SQL["kpis"] + "),\ntk AS (" + SQL["top_keyword"] + "),\n" + """
l AS (SELECT k.post_id, list_filter([
    '🎯 Advocacy ' || CAST(round_even(k.advocacy, 1) AS VARCHAR) || '%',
    '🛡️ Safety ' || CAST(round_even(k.safety_score, 1) AS VARCHAR),
    CASE WHEN k.best_hour IS NOT NULL THEN printf('⏰ Best hour %02d:00 UTC', k.best_hour) END,
    '⚡ ' || CAST(round_even(k.velocity_cph, 2) AS VARCHAR) || ' comments/hour',
    '💬 Top emotion ' || k.top_emotion,
    CASE WHEN length(tk.top_keyword) > 0 THEN '#️⃣ ' || tk.top_keyword END], lambda x: x IS NOT NULL) AS lines
  FROM k JOIN tk USING (post_id))
SELECT post_id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, unnest(lines) AS text FROM l
""")
