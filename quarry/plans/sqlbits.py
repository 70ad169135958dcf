"""SQL fragments for the DuckDB oracles, from the same constants as the jobs."""

from __future__ import annotations

from quarry.functions import constants as K


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS_CHARS_SQL = "(" + " || ".join(f"chr({c})" for c in K.WS_CODEPOINTS) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS_SQL})"


def canon(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(K.WS_RUN)}, ' ', 'g'))"


def rx(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def decode_entities(x: str) -> str:
    for ent, ch in K.ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def drop_invisible(x: str) -> str:
    return rx(rx(rx(x, K.COMMENT_RE), K.SCRIPT_RE), K.STYLE_RE)


def visible_text(x: str) -> str:
    return decode_entities(rx(drop_invisible(x), K.ANY_TAG_RE))


def html_text_lines(x: str) -> str:
    c = decode_entities(rx(drop_invisible(x), K.ANY_TAG_RE, "\n"))
    return (f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), "
            f"lambda l: {strip('l')}), lambda l: l <> ''), chr(10))")


def fallback_body(x: str, max_chars: int = K.FALLBACK_BODY_CHARS) -> str:
    pos = f"strpos({x}, chr(10) || chr(10))"
    body = f"(CASE WHEN {pos} > 1 THEN {strip(f'substr({x}, {pos} + 2)')} ELSE {x} END)"
    t = canon(decode_entities(rx(drop_invisible(body), K.ANY_TAG_RE, " ")))
    return f"left({t}, {max_chars})"


def normalise_lines(x: str) -> str:
    c = rx(x, r"\n" + K.WS + r"*\n" + K.WS + r"*\n", "\n\n")
    c = rx(c, r"[ \t]+", " ")
    return strip(c)


def html_to_clean_text(x: str) -> str:
    c = drop_invisible(x)
    c = rx(c, K.ANCHOR_RE, r"[\4](\1\2\3)")
    c = rx(c, r"(?i)<br\s*/?>", "\n")
    c = rx(c, r"(?i)</?p\b[^>]*>", "\n\n")
    c = rx(c, r"(?i)</?div\b[^>]*>", "\n")
    c = rx(c, r"(?i)<li\b[^>]*>", "\n* ")
    c = rx(c, r"(?i)</li\s*>", "\n")
    c = rx(c, r"(?i)</?(?:ul|ol)\b[^>]*>", "\n")
    c = rx(c, r"(?i)</?(?:strong|b)\b[^>]*>", "**")
    c = rx(c, r"(?i)</?(?:em|i|u)\b[^>]*>", "_")
    c = rx(c, K.ANY_TAG_RE)
    c = rx(c, K.EMPTY_ANCHOR_RE, "[" + K.EMPTY_LINK_TEXT + "](")
    c = normalise_lines(decode_entities(c))
    return f"(CASE WHEN {strip(x)} = '' THEN {x} ELSE {c} END)"


def build_prompt(subject: str, body: str, rules: str | None = None) -> str:
    full = (f"('Subject: ' || coalesce({subject}, {q(K.DEFAULT_SUBJECT)}) || chr(10) || chr(10) "
            f"|| 'Body:' || chr(10) || chr(10) || coalesce({body}, ''))")
    p = f"replace({q(K.PROMPT_TEMPLATE)}, {q(K.PROMPT_PLACEHOLDER)}, {full})"
    if rules is None:
        return p
    r = f"coalesce({rules}, '')"
    return f"(CASE WHEN {r} <> '' THEN {r} || chr(10) || chr(10) || {p} ELSE {p} END)"


def truncate_middle(p: str) -> str:
    return (f"(CASE WHEN length({p}) > {K.TRUNCATE_LIMIT} THEN left({p}, {K.TRUNCATE_HEAD}) || "
            f"{q(K.TRUNCATE_MARKER)} || right({p}, {K.TRUNCATE_TAIL}) ELSE {p} END)")


HEADER_START_RE = r"(?i)\A(?:" + "|".join(K.KNOWN_HEADERS) + r")[ \t]*:"


def plain_extract(raw: str) -> str:
    """T1 restricted to the shapes of the uploaded-record fixture: a plain
    message with a header block, or a text without one."""
    pos = f"strpos({raw}, chr(10) || chr(10))"
    body = f"(CASE WHEN {pos} > 0 THEN substr({raw}, {pos} + 2) ELSE '' END)"
    t = f"(CASE WHEN regexp_matches({raw}, {q(HEADER_START_RE)}) THEN {strip(body)} ELSE {strip(raw)} END)"
    return f"(CASE WHEN {t} = '' THEN {fallback_body(raw)} ELSE {t} END)"
