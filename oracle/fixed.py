"""What the oracle SQL takes as given: word lists, patterns and the comment view.

Spelled out here so that the oracle shares nothing with the engine it checks.
"""

# --- fixed values: stop words ---
STOPWORDS = """
a an and the of to in for on at by with about between into over from as is are was were be been being than then that this these
those there here it its it's their theirs our ours your yours i me my mine we us you he him his she her they them who whom which
what why how not no nor so such too very can will just do does did have has had up down out more most other some any each few own
same s t don should now আমি আমরা তুমি আপনি তারা সে এই সেই ওই কোন কি বা আর এবং তবে কিন্তু তাই শুধু যেন যেই যে যদি যখন যদিও যা যার
যারাই যারা যেখানে ছিল ছিলাম হবে করেছি করব করি করা করে করছেন করছেনা তো না নয় হয় হচ্ছে আছে ছিলেন হতে পারে পর্যন্ত খুব অনেক আরো আরও
আবার তাহলে এখানে সেখানে তাদের সঙ্গে জন্য কারণ ফলে উপর নিচ আগে পরে মধ্যে আমার তোমার তার তোমাদের আমাদের আরেকটা কিছু কিছুটা কেউ কোনটা
কোনগুলো দিয়ে গেছে যায় হয়েই হল হলো হওয়া হওয়ার নই নাও নেন নেওয়া হয়েছে হয়নি কেন কিভাবে কেনো কেনও ইত্যাদি
""".split()

# --- fixed values: call-to-action and toxic words (substrings), question words ---
CTA = "buy|order|subscribe|follow|share|signup|call|dm"
TOXIC = "stupid|idiot|hate|kill|trash|shame|fraud|scam|liar|fake"
QUESTION = r"(?i)\?|(^|[^\p{L}\p{N}_])(why|what|when|how|where|which|kivabe|keno)($|[^\p{L}\p{N}_])"

# --- fixed values: white space, links, words, emoji runs ---
SPACE = r"[\x{9}\x{A}\x{B}\x{C}\x{D}\x{1C}\x{1D}\x{1E}\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINK = f"(?i)(https?://|www\\.)[^{SPACE[1:]}+"
WORD = r"[#@]?[\p{L}\p{N}_]+"
EMOJI = (r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]+")

# --- fixed values: link shapes with an id, in order, and their number of groups ---
LINK_IDS = (
    (r"(?i)facebook\.com/reel/(\d+)", 1),
    (r"(?i)facebook\.com/.*/videos/(\d+)", 1),
    (r"(?i)facebook\.com/watch/\?v=(\d+)", 1),
    (r"(?i)[?&]v=(\d+)", 1),
    (r"(?i)facebook\.com/photo\.php\?[^#]*\bfbid=(\d+)", 1),
    (r"(?i)facebook\.com/(?:permalink|story)\.php\?[^#]*\bstory_fbid=(\d+)", 1),
    (r"(?i)facebook\.com/.*/posts/(\d+)", 1),
    (r"(?i)facebook\.com/groups/(\d+)/permalink/(\d+)", 2),
    (r"(?i)facebook\.com/groups/(\d+)/posts/(\d+)", 2),
)
RAW_ID = r"^\d+(?:_\d+)?$"

COMMENTS_V = """
nd AS (SELECT count(*) AS n FROM documents),
rx AS (
  SELECT e.event_id % (SELECT n FROM nd) AS doc_id, e.event_id % 7 AS rtype,
         CAST(floor(e.value / 25) AS BIGINT) AS v
  FROM events e),
rxp AS (
  SELECT doc_id,
    sum(CASE WHEN rtype = 0 THEN v END) AS like_count,
    sum(CASE WHEN rtype = 1 THEN v END) AS love_count,
    sum(CASE WHEN rtype = 2 THEN v END) AS haha_count,
    sum(CASE WHEN rtype = 3 THEN v END) AS wow_count,
    sum(CASE WHEN rtype = 4 THEN v END) AS sad_count,
    sum(CASE WHEN rtype = 5 THEN v END) AS angry_count,
    sum(CASE WHEN rtype = 6 THEN v END) AS care_count
  FROM rx GROUP BY doc_id),
comments_v AS (
  SELECT 'post_' || CAST(d.doc_id % 4 AS VARCHAR) AS post_id,
    'cmt_' || CAST(d.doc_id AS VARCHAR) AS comment_id,
    'user_' || CAST(e.user_id AS VARCHAR) AS user_id,
    'user_' || CAST(e.user_id AS VARCHAR) AS user_name,
    d.text
      || CASE WHEN d.doc_id % 7 = 0 THEN ' why is that?' ELSE '' END
      || CASE WHEN d.doc_id % 11 = 0 THEN ' #topic' || CAST(d.doc_id % 5 AS VARCHAR) ELSE '' END
      || CASE WHEN d.doc_id % 13 = 0 THEN ' 😅😅 ok 🙌' ELSE '' END
      || CASE WHEN d.doc_id % 17 = 0 THEN '\u00a0#news\u3000later www.a.example/b\u00a0after' ELSE '' END AS comment_text,
    CAST(e.ts AS TIMESTAMP) AS created_time,
    CAST(coalesce(r.like_count, 0) AS BIGINT) AS like_count,
    CAST(coalesce(r.love_count, 0) AS BIGINT) AS love_count,
    CAST(coalesce(r.haha_count, 0) AS BIGINT) AS haha_count,
    CAST(coalesce(r.wow_count, 0) AS BIGINT) AS wow_count,
    CAST(coalesce(r.sad_count, 0) AS BIGINT) AS sad_count,
    CAST(coalesce(r.angry_count, 0) AS BIGINT) AS angry_count,
    CAST(coalesce(r.care_count, 0) AS BIGINT) AS care_count,
    CAST(floor(e.value / 100) AS BIGINT) AS reply_count,
    d.lang AS language,
    CAST(NULL AS VARCHAR) AS permalink_url,
    CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
    e.event_type || '_' || CAST(d.doc_id % 3 AS VARCHAR) AS emotion
  FROM documents d
  JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN rxp r ON r.doc_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""
