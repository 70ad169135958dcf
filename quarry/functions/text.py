"""Text jobs as Catalyst Column expressions (T2-T8, K1 canon, K3, Q6).

Every function takes and returns a ``Column`` built from built-in functions
only, so the work stays inside whole-stage codegen and the DuckDB oracle can
state the same computation in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.trim(_c(col), F.lit(K.WS_CHARS))


def collapse_ws(col) -> Column:
    """T5 (first form): ``" ".join(text.split())``."""
    return F.trim(F.regexp_replace(_c(col), K.WS_RUN, " "))


def normalise_lines(col) -> Column:
    """T5 (second form): >=3 line breaks -> 2, runs of blanks/tabs -> 1, strip."""
    c = F.regexp_replace(_c(col), r"\n" + K.WS + r"*\n" + K.WS + r"*\n", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return py_strip(c)


def content_key(id_col, text_col) -> Column:
    """K1: given non-empty id, else md5 of the whitespace-collapsed text."""
    return F.coalesce(F.nullif(_c(id_col), F.lit("")), F.md5(collapse_ws(text_col)))


def _entities() -> Column:
    """Literal map of name (or ``#`` and a decimal code point) to text; the commonest stand first."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in K.ENTITY_MAP.items())), F.lit("\x02"), F.lit("\x01"))


def _code_point(ref: Column) -> Column:
    """Decimal code point, as a string, of ``#8220`` or ``#x201C`` (eight digits at most are looked at:
    more are above U+10FFFF in any case)."""
    hexa = F.lower(ref.substr(2, 1)) == F.lit("x")
    digits = F.ltrim(ref.substr(F.lit(2), F.length(ref)), F.lit("xX0"))
    first = F.left(digits, F.lit(8))
    return F.coalesce(F.when(digits == F.lit(""), F.lit("0")).when(hexa, F.conv(first, 16, 10)).otherwise(first), F.lit("0"))


def _character(code_point: Column) -> Column:
    """The character of a code point; U+FFFD for 0, surrogates and what lies above U+10FFFF."""
    n = code_point.cast("bigint")
    bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    code = F.when(bad, F.lit(0xFFFD).cast("bigint")).otherwise(n)
    # the mark in front keeps the decoder from taking U+FEFF as one
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")


def decode_entities(col) -> Column:
    """Character references (decimal, hex, all HTML names) with their semicolon, each decoded once;
    unknown names stay as they are."""
    def value(ref):
        numeric = F.transform(F.array(_code_point(ref)), lambda n: F.coalesce(
            F.try_element_at(_entities(), F.concat(F.lit("#"), n)), _character(n)))
        return F.when(F.startswith(ref, F.lit("#")), F.get(numeric, F.lit(0))).otherwise(F.try_element_at(_entities(), ref))

    def decoded(part):
        ref = F.regexp_extract(part, r"\A(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 1)
        return F.get(F.transform(F.array(ref), lambda r: F.coalesce(
            F.when(r != F.lit(""), F.concat(value(r), part.substr(F.length(r) + 2, F.length(part)))),
            F.concat(F.lit("&"), part))), F.lit(0))
    parts = F.split(_c(col), "&", -1)
    return F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(decoded(part))), "")


def drop_invisible(col) -> Column:
    """Comments, scripts and styles with their content."""
    c = F.regexp_replace(_c(col), K.COMMENT_RE, "")
    c = F.regexp_replace(c, K.SCRIPT_RE, "")
    return F.regexp_replace(c, K.STYLE_RE, "")


def visible_text(col) -> Column:
    """Text nodes concatenated without separator (``get_text()``)."""
    c = F.regexp_replace(drop_invisible(col), K.ANY_TAG_RE, "")
    return decode_entities(c)


def html_text_lines(col) -> Column:
    """Text nodes, each stripped, blank ones dropped, joined by newlines
    (``get_text(separator='\\n', strip=True)`` on a parsed page)."""
    c = F.regexp_replace(drop_invisible(col), K.ANY_TAG_RE, "\n")
    c = decode_entities(c)
    lines = F.transform(F.split(c, "\n"), lambda x: py_strip(x))
    return F.array_join(F.filter(lines, lambda x: x != F.lit("")), "\n")


def fallback_body(col, max_chars: int = K.FALLBACK_BODY_CHARS) -> Column:
    """Body after the first blank line (when it is not at position 0),
    tags stripped, whitespace collapsed, first ``max_chars`` characters."""
    raw = _c(col)
    pos = F.locate("\n\n", raw)  # 1-based, 0 when absent
    body = F.when(pos > 1, py_strip(raw.substr(pos + 2, F.length(raw)))).otherwise(raw)
    txt = F.regexp_replace(drop_invisible(body), K.ANY_TAG_RE, " ")
    txt = collapse_ws(decode_entities(txt))
    return F.left(txt, F.lit(max_chars))


def html_to_clean_text(col) -> Column:
    """HTML -> clean markdown-ish text.

    (1) comments, (2) script/style with content, (3) anchors -> [text](href),
    (4) line breaks, bullets and emphasis marks, (5) remaining tags,
    (6) entities, (7) blank-line and blank-run collapse, strip.  Blank input
    is returned unchanged.
    """
    src = _c(col)
    c = drop_invisible(src)
    c = F.regexp_replace(c, K.ANCHOR_RE, "[$4]($1$2$3)")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</?p\b[^>]*>", "\n\n")
    c = F.regexp_replace(c, r"(?i)</?div\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?i)<li\b[^>]*>", "\n* ")
    c = F.regexp_replace(c, r"(?i)</li\s*>", "\n")
    c = F.regexp_replace(c, r"(?i)</?(?:ul|ol)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?i)</?(?:strong|b)\b[^>]*>", "**")
    c = F.regexp_replace(c, r"(?i)</?(?:em|i|u)\b[^>]*>", "_")
    c = F.regexp_replace(c, K.ANY_TAG_RE, "")
    c = F.regexp_replace(c, K.EMPTY_ANCHOR_RE, "[" + K.EMPTY_LINK_TEXT + "](")
    c = decode_entities(c)
    c = normalise_lines(c)
    return F.when(py_strip(src) == F.lit(""), src).otherwise(c)


def link_edges(col):
    """T4 edge table parts: arrays of hrefs (entities decoded) and link texts (inner
    tags removed, entities decoded), same order; href in double, single or no quotes."""
    html = drop_invisible(_c(col))

    def group(i):
        return F.regexp_extract_all(html, F.lit(K.ANCHOR_RE), F.lit(i))
    quoted = F.zip_with(group(1), group(2), lambda a, b: F.concat(a, b))
    hrefs = F.zip_with(quoted, group(3), lambda a, b: decode_entities(F.concat(a, b)))
    texts = F.transform(group(4), lambda t: py_strip(decode_entities(F.regexp_replace(t, K.ANY_TAG_RE, ""))))
    return hrefs, texts


def is_significant_html(col, min_chars: int = K.SIGNIFICANT_HTML_CHARS) -> Column:
    """Visible text, stripped, at least ``min_chars`` characters."""
    return F.length(py_strip(visible_text(col))) >= F.lit(min_chars)


def distinct_lines(col) -> Column:
    """K3: drop repeated lines, keep the first occurrence and the order."""
    return F.array_join(F.array_distinct(F.split(_c(col), "\n")), "\n")


def build_prompt(subject_col, body_col, rules_col=None,
                 template: str = K.PROMPT_TEMPLATE) -> Column:
    """Subject + body into the template, learned rules prefixed when non-empty."""
    subject = F.coalesce(_c(subject_col), F.lit(K.DEFAULT_SUBJECT))
    full = F.concat(F.lit("Subject: "), subject, F.lit("\n\nBody:\n\n"),
                    F.coalesce(_c(body_col), F.lit("")))
    prompt = F.replace(F.lit(template), F.lit(K.PROMPT_PLACEHOLDER), full)
    if rules_col is None:
        return prompt
    rules = F.coalesce(_c(rules_col), F.lit(""))
    return F.when(rules != F.lit(""), F.concat(rules, F.lit("\n\n"), prompt)).otherwise(prompt)


def truncate_middle(col, limit: int = K.TRUNCATE_LIMIT, head: int = K.TRUNCATE_HEAD,
                    tail: int = K.TRUNCATE_TAIL, marker: str = K.TRUNCATE_MARKER) -> Column:
    """Longer than ``limit`` -> first ``head`` + marker + last ``tail``."""
    p = _c(col)
    return F.when(F.length(p) > F.lit(limit),
                  F.concat(F.left(p, F.lit(head)), F.lit(marker), F.right(p, F.lit(tail)))
                  ).otherwise(p)


def json_string(col) -> Column:
    """A string as a JSON string literal (quotes and escapes), like ``json.dumps``."""
    j = F.to_json(F.array(_c(col)))
    return j.substr(F.lit(2), F.length(j) - 2)


def key_details(col):
    """Q6: one array of distinct matches per detail kind.

    Each pattern needs a character that most texts lack ('@', '-' or '/', a
    currency sign); rows without it skip that regex (same result, less work).
    """
    c = _c(col)
    out = {}
    for kind, rx in K.KEY_DETAIL_PATTERNS:
        need = K.KEY_DETAIL_REQUIRES[kind]
        has = None
        for ch in need:
            t = F.instr(c, ch) > 0
            has = t if has is None else (has | t)
        found = F.regexp_extract_all(c, F.lit(K.KEY_DETAIL_JAVA.get(kind, rx)), F.lit(1))
        out[kind] = F.when(has, F.array_distinct(found)) \
            .otherwise(F.array().cast("array<string>"))
    return out
