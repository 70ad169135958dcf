"""Constants shared by the Spark jobs and their DuckDB oracles."""

from html.entities import html5

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference service's values for results
# (prompts, cache keys, truncation points, enums) to be the same.
# ---------------------------------------------------------------------------

PROMPT_TEMPLATE = (
    "You are an email intelligence system.\n\n"
    "Your task: generate a structured, accurate, and strictly grounded summary of the provided email.\n\n"
    "CRITICAL RULES:\n"
    "- Use ONLY information present in the email.\n"
    "- If any field cannot be directly supported by the email text → return null or [].\n"
    "- Do NOT infer, assume, or use external knowledge.\n"
    "- Copy all values (dates, names, amounts, IDs) EXACTLY as written.\n"
    "- Do NOT reuse or copy any example content.\n"
    "- Output MUST be valid JSON only.\n"
    "- Ignore duplicated or repeated text if present.\n\n"
    "GROUNDING RULE:\n"
    "- Every field must be traceable to the email text.\n"
    "- \"source_quote\" must be an exact substring copied from the email body (no rephrasing).\n\n"
    "SUBJECT RULE:\n"
    "- Extract the subject exactly as written after \"Subject:\" with no modification.\n\n"
    "URGENCY RULE:\n"
    "- Set urgency HIGH only if explicitly time-sensitive.\n"
    "- Otherwise use MEDIUM or LOW.\n\n"
    "---\n\n"
    "INPUT:\n"
    "{{email_text}}\n\n"
    "The input format is:\n"
    "Subject: [subject]\n\n"
    "Body:\n"
    "[email body]\n\n"
    "---\n\n"
    "OUTPUT FORMAT:\n\n"
    "{\n"
    "  \"category\": \"<Work|Personal|Newsletter|Finance|HR|Other>\",\n"
    "  \"subject\": \"<exact subject text>\",\n\n"
    "  \"summary\": \"<1-2 line concise summary strictly grounded in the email>\",\n\n"
    "  \"detailedSummary\": \"<4-5 line detailed summary strictly grounded in the email>\",\n\n"
    "  \"priority\": \"<Urgent|Important|Normal|Low>\",\n\n"
    "}"
)
PROMPT_PLACEHOLDER = "{{email_text}}"
DEFAULT_SUBJECT = "No Subject"
SYSTEM_PROMPT = "You are a professional email assistant. Return ONLY valid JSON."
CACHE_NAMESPACE = "generate"
DEFAULT_MODEL = "qwen2.5:3b"
CACHE_KEY_CHARS = 2000

TRUNCATE_LIMIT = 4500
TRUNCATE_HEAD = 1000
TRUNCATE_TAIL = 2000
TRUNCATE_MARKER = "\n\n[ ... middle truncated for token limit ... ]\n\n"

MAX_TEXT_CHARS = 500000
FALLBACK_BODY_CHARS = 8000
SIGNIFICANT_HTML_CHARS = 50
REAL_SUMMARY_MIN_CHARS = 20
REAL_SUMMARY_BANNED = ("fallback", "excerpt")

CATEGORIES = ("Work", "Personal", "Newsletter", "Finance", "HR", "Other")
PRIORITIES = ("Urgent", "Important", "Normal", "Low")
RATING_MIN, RATING_MAX = 1, 5

EVAL_WEIGHTS = {"answer_relevance": 0.4, "faithfulness": 0.4, "context_richness": 0.2}
EVAL_PASS = 0.7
EVAL_DEFAULT_CONFIDENCE = 0.5
EVAL_MAX_CORRECTIONS = 1

CONSOLIDATE_EVERY_N = 50

CACHE_TTL_SECONDS = 86400
CACHE_MAX_ENTRIES = 10000

RATE_LIMIT = 100
RATE_WINDOW_SECONDS = 60

BREAKER_THRESHOLD = 5
BREAKER_TIMEOUT_SECONDS = 60

MODEL_RETRIES = 2
MODEL_BACKOFF_SECONDS = 0.5

EMPTY_LINK_TEXT = "Link"

# ---------------------------------------------------------------------------
# Our own definitions (not from the reference): regular expressions shared by
# the Spark jobs and the DuckDB oracles.  They use only syntax that Java regex
# and RE2 read the same way.
# ---------------------------------------------------------------------------

# Python's str.split() / str.strip() whitespace set, as code points and as a
# regex class written with ranges only (markedly faster in Java regex than a
# class mixing \s with single code points).
WS_CODEPOINTS = (0x09, 0x0a, 0x0b, 0x0c, 0x0d, 0x1c, 0x1d, 0x1e, 0x1f, 0x20, 0x85, 0xa0, 0x1680,
                 *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)
WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_RUN = WS + "+"
STRIP_RE = r"\A" + WS + "+|" + WS + r"+\z"

# Names that tell a header block from text.
KNOWN_HEADERS = ("subject", "from", "to", "cc", "date", "mime-version", "content-[a-z-]+",
                 "message-id")

SENTENCE_RE = r"([^.!?]+[.!?]?)"
TOKEN_RE = r"(\p{L}+)"

# Entities decoded by the DuckDB oracles, '&amp;' last; the jobs decode all (ENTITY_MAP).
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&rsquo;", "\u2019"),
    ("&lsquo;", "\u2018"),
    ("&rdquo;", "\u201d"),
    ("&ldquo;", "\u201c"),
    ("&mdash;", "\u2014"),
    ("&ndash;", "\u2013"),
    ("&hellip;", "\u2026"),
    ("&bull;", "\u2022"),
    ("&euro;", "\u20ac"),
    ("&pound;", "£"),
    ("&reg;", "®"),
    ("&trade;", "\u2122"),
    ("&eacute;", "é"),
    ("&egrave;", "è"),
    ("&agrave;", "à"),
    ("&ccedil;", "ç"),
    ("&uuml;", "ü"),
    ("&ouml;", "ö"),
    ("&auml;", "ä"),
    ("&ntilde;", "ñ"),
    ("&#8217;", "\u2019"),
    ("&#8211;", "\u2013"),
    ("&#8212;", "\u2014"),
    ("&#160;", " "),
    ("&amp;", "&"),
)
# Names and code points with a text of their own: those above, the bytes of windows-1252 that
# HTML reads for the code points 128-159, and all names of HTML.
ENTITY_MAP = {ent[1:-1]: ch for ent, ch in reversed(ENTITIES)}
for _n in range(0x80, 0xa0):
    _ch = bytes([_n]).decode("cp1252", "ignore")
    if _ch:
        ENTITY_MAP[f"#{_n}"] = _ch
for _name, _ch in html5.items():
    if _name.endswith(";"):
        ENTITY_MAP.setdefault(_name[:-1], _ch)

COMMENT_RE = r"(?s)<!--.*?-->"
SCRIPT_RE = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE_RE = r"(?is)<style\b[^>]*>.*?</style\s*>"
ANY_TAG_RE = r"<[a-zA-Z/!?][^>]*>"
# groups: href in double quotes, in single quotes, bare; link text
ANCHOR_RE = (r"""(?is)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>""" + WS + r"*(.*?)" + WS
             + r"*</a\s*>")
EMPTY_ANCHOR_RE = r"\[" + WS + r"*\]\("

# Key-detail kinds (Q6): dates, amounts, ids and references, e-mail addresses.
KEY_DETAIL_PATTERNS = (
    ("date", r"(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})"),
    ("amount", r"([$\x{20ac}\x{a3}]\d[\d,]*(?:\.\d+)?)"),
    ("reference", r"(?:^|[^\p{L}\p{N}_])([A-Z]{2,}-\d+)(?:[^\p{L}\p{N}_]|\z)"),
    ("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"),
)
# For Java: the same matches, but the boundaries are looked at and not consumed, so
# that the next of two neighbouring references is found too.
KEY_DETAIL_JAVA = {"reference": r"(?<![\p{L}\p{N}_])([A-Z]{2,}-\d+)(?![\p{L}\p{N}_])"}
# A character every match of the kind contains (any one of them).
KEY_DETAIL_REQUIRES = {"date": ("-", "/"), "amount": ("$", "\u20ac", "\u00a3"),
                       "reference": ("-",), "email": ("@",)}


def py_pattern(p: str) -> str:
    """The same pattern for Python's ``regex`` module (``\\x{h}`` -> ``\\Uhhhhhhhh``)."""
    import re
    return re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: "\\U%08x" % int(m.group(1), 16), p)
