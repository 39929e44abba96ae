"""Fixed word lists and patterns.

FIXED VALUES: these must equal the values the reference application uses, so
its results can be matched; they are stated here as plain text, in their
natural order.
"""

# --- fixed values: Bangla stop words (tokenizer) ---
BN_STOPWORDS_TEXT = """আমি আমরা তুমি আপনি তারা সে এই সেই ওই কোন কি বা আর এবং তবে কিন্তু তাই শুধু যেন যেই যে যদি যখন তবে যদিও যা যার যারাই যারা যেখানে যেখানে ছিল ছিলাম হবে করেছি করব করি করা করে করছেন করছেনা তো না নয় হবে না হয় হচ্ছে আছে ছিলেন হতে হতে পারে পর্যন্ত খুব অনেক আরো আরও আবার যেন তাহলে এখানে সেখানে তাদের সঙ্গে জন্য কারণ যার ফলে উপর নিচ আগে পরে মধ্যে আমার তোমার তার তাদের তোমাদের আমাদের আরেকটা কিছু কিছুটা কেউ কোনটা কোনগুলো তাহলে তবে তাই দিয়ে দিয়ে গেছে যায় হয়েই হল হলো হওয়া হওয়ার ছিলেন নই ছিলাম নাও নেন নেওয়া নেওয়া হয়েছে হয়নি কেন কিভাবে কেনো কেনও ইত্যাদি"""

# --- fixed values: English stop words (tokenizer) ---
EN_STOPWORDS_TEXT = """a an and the of to in for on at by with about between into over from as is are was were be been being than then that this these those there here it its it's their theirs our ours your yours i me my mine we us you he him his she her they them who whom which what why how not no nor so such too very can will just do does did have has had up down out more most other some any each few own same than s t don should now"""

# --- fixed values: call-to-action words (substring match) ---
CTA_WORDS = ("buy", "order", "subscribe", "follow", "share", "signup", "call", "dm")

# --- fixed values: toxic lexicon (substring match) ---
TOXIC_WORDS = ("stupid", "idiot", "hate", "kill", "trash", "shame", "fraud", "scam", "liar", "fake")

# --- fixed values: question words (whole word, case-insensitive) ---
QUESTION_WORDS = ("why", "what", "when", "how", "where", "which", "kivabe", "keno")

# --- fixed values: emoji code point ranges (a run of these counts once) ---
EMOJI_RANGES = (
    (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF),
    (0x1F700, 0x1F77F), (0x1F780, 0x1F7FF), (0x1F800, 0x1F8FF),
    (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x2600, 0x26FF), (0x2700, 0x27BF),
)

# --- fixed values: URL shapes for object ids, tried in this order ---
# (regex, number of id groups; two groups are joined with "_")
LINK_ID_PATTERNS = (
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
RAW_ID_PATTERN = r"^\d+(?:_\d+)?$"

# --- fixed values: similarity defaults ---
SHINGLE_K = 3
SIMILARITY_THRESHOLD = 0.55
SIMILARITY_MIN_CHARS = 12

# --- fixed values: language code names ---
LANGUAGE_NAMES = {"bn": "bangla", "en": "english"}

BN_STOPWORDS = tuple(dict.fromkeys(BN_STOPWORDS_TEXT.split()))
EN_STOPWORDS = tuple(dict.fromkeys(EN_STOPWORDS_TEXT.split()))
STOPWORDS = tuple(dict.fromkeys(EN_STOPWORDS + BN_STOPWORDS))
