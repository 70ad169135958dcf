"""Encoded and nested MIME messages as Spark expressions: parts in order, of any depth, without a join or a shuffle.

A message is split at the lines that could end or begin a part (``--`` and a boundary that the message names), and
each chunk's header block is read.  One ``aggregate`` over the chunks keeps the stack of open multiparts: a
boundary of the stack closes what lies above it and begins a part, which is a leaf or opens a multipart itself; its
closing line ends that multipart; any other chunk continues the leaf it stands in.  A message inside a message
(``message/rfc822``) counts as the part that it holds.

Leaves are decoded by ``unbase64`` and, for quoted-printable, ``unhex``; then by charset: UTF-8 and single-byte
charsets (tables made from the codecs) natively, the bytes of multi-byte ones by a small Arrow helper.  Unknown
charsets count as UTF-8; bytes that are no character of the charset are left out.  In base64, characters of no meaning
and a stray last one are dropped and missing padding is added.  Parts without a transfer encoding are text already.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADERS_RE = r"\A((?:[!-9;-~]*:[^\n]*\n|[ \t][^\n]*\n)*+)"
FORWARD_RE = r"(?i)\A(?:(?:(?!content-type:)[^\n]+\n)*+content-type:[ \t]*message/rfc822[^\n]*\n(?:[^\n]+\n)*+\n)++"
NAMED_RE = r"(?i)boundary[ \t]*=[ \t]*(?:\"[^\"\\\n]+\"|[^\";\s\\]+)"
WORD_RE = r"=\?[^?\s]+\?[bBqQ]\?[^?\n]*\?="
BYTE_RE = "=[0-9A-Fa-f]{2}"
UTF8 = ("utf-8", "utf8", "us-ascii-utf8", "")
HIGH = bytes(range(128, 256))
_SINGLE_NAMES = ["us-ascii", "ascii", "latin1", "latin-1", "koi8-r", "koi8-u", "macintosh",
                 *(f"iso-8859-{i}" for i in range(1, 17) if i != 12), *(f"{w}{i}" for w in ("windows-", "cp") for i in range(1250, 1259))]


def _single_byte() -> dict[str, tuple[str, str]]:
    """Charset -> (characters 128-255 of ISO-8859-1, what they are in it); characters of no meaning come last, without a partner."""
    out = {}
    for name in _SINGLE_NAMES:
        pairs = [(chr(b), bytes([b]).decode(name, "ignore")) for b in HIGH]
        pairs.sort(key=lambda p: not p[1])
        out[name] = ("".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return out


SINGLE = _single_byte()


def _single() -> Column:
    return F.create_map(*[c for name, (a, b) in SINGLE.items()
                          for c in (F.lit(name), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])


def is_native(charset: Column) -> Column:
    return charset.isin(*UTF8) | charset.isin(*SINGLE)


def from_charset(data: Column, charset: Column) -> Column:
    """Bytes as text, for the charsets of ``is_native``; others count as UTF-8."""
    table = F.try_element_at(_single(), charset)
    utf8 = data.cast("string")
    return F.when(charset.isin(*SINGLE), F.call_function("translate", F.decode(data, "ISO-8859-1"), table["a"], table["b"])) \
        .when(F.is_valid_utf8(utf8), utf8).otherwise(F.replace(F.make_valid_utf8(utf8), F.lit("\ufffd"), F.lit("")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def from_base64(body: Column) -> Column:
    def padded(kept: Column) -> Column:
        n = F.length(kept)
        return F.concat(F.left(kept, n - F.when(n % 4 == 1, 1).otherwise(0)), F.element_at(F.array(*map(F.lit, ("", "", "==", "="))), n % 4 + 1))
    return F.unbase64(_let(F.regexp_replace(F.substring_index(body, "=", 1), r"[^A-Za-z0-9+/]++", ""), padded))


def quoted_printable_runs(body: Column) -> Column:
    """The body cut into runs of ``=XX`` and the text between them; soft line ends go, also with blanks after the equals sign."""
    plain = F.regexp_replace(body, r"=[ \t]*+(?:\n|\z)", "")
    return F.regexp_extract_all(plain, F.lit(rf"(?:{BYTE_RE})++|[^=]++|="), F.lit(0))


def from_quoted_printable(body: Column) -> Column:
    """Every ``=XX`` a byte, a run of them at once; an equals sign without two hex digits stays."""
    return F.unhex(F.array_join(F.transform(quoted_printable_runs(body), lambda run: F.when(
        F.regexp_like(run, F.lit(rf"\A{BYTE_RE}")), F.replace(run, F.lit("="), F.lit(""))).otherwise(F.hex(run))), ""))


def decode_words(value: Column) -> Column:
    """RFC 2047: encoded words of a header value become text; blanks between two of them go."""
    v = F.regexp_replace(F.regexp_replace(value, "\u0001", ""), rf"({WORD_RE})[ \t\n]+(?={WORD_RE})", "$1")
    tokens = F.split(F.regexp_replace(v, f"({WORD_RE})", "\u0001$1\u0001"), "\u0001")

    def one(t: Column) -> Column:
        part = F.split(t, r"\?", 5)
        text = F.get(part, F.lit(3))
        charset = F.lower(F.regexp_replace(F.get(part, F.lit(1)), r"\*.*", ""))
        data = F.when(F.lower(F.get(part, F.lit(2))) == "b", from_base64(text)) \
            .otherwise(from_quoted_printable(F.replace(text, F.lit("_"), F.lit("=20"))))
        return F.when(F.regexp_like(t, F.lit(rf"\A{WORD_RE}\z")), from_charset(data, charset)).otherwise(t)
    return F.array_join(F.transform(tokens, one), "")


def header(raw: Column, name: str) -> Column:
    """The first header of that name of a raw message (line ends \\n), unfolded and decoded; empty where there is none."""
    block = unfolded(F.regexp_extract(F.concat(raw, F.lit("\n")), HEADERS_RE, 1))
    return decode_words(F.rtrim(F.regexp_extract(block, rf"(?im)^{name}:[ \t]*([^\n]*)", 1)))


def unfolded(block: Column) -> Column:
    return F.regexp_replace(block, r"\n[ \t]+", " ")


def _value(block: Column, pattern: str) -> Column:
    return F.lower(F.regexp_extract(block, pattern, 1))


def leaves(df: DataFrame, raw: Column, out: str = "_leaves") -> DataFrame:
    """``df`` with ``out``: array of struct(ctype, cte, charset, body) of the leaf parts of each message (line ends \\n), in
    order.  Null messages have null."""
    c = F.col
    named = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(NAMED_RE), F.lit(0)),
                                         lambda b: F.regexp_replace(b, r"(?i)\Aboundary[ \t]*=[ \t]*|\"", "")))
    x = df.withColumn("_raw_", F.concat(F.lit("\n"), raw)).withColumn("_named_", named)
    lines = F.concat(F.lit(r"\n--(?=(?:\Q"), F.array_join("_named_", r"\E|\Q"), F.lit(r"\E)(?:--)?[ \t]*(?:\n|\z))"))
    chunks = F.when(F.size("_named_") > 0, F.split(c("_raw_"), lines)).otherwise(F.array("_raw_"))

    def cut(chunk: Column) -> Column:                              # marker line, and what follows it
        at = F.locate("\n", chunk)
        return F.struct(chunk.alias("all"), F.rtrim(F.when(at > 0, F.left(chunk, at - 1)).otherwise(chunk)).alias("marker"),
                        F.regexp_replace(F.when(at > 0, F.substring(chunk, at + 1, F.length(chunk))).otherwise(F.lit("")),
                                         FORWARD_RE, "").alias("s"))

    def headed(p: Column) -> Column:
        block = F.regexp_extract(F.concat(p["s"], F.lit("\n")), HEADERS_RE, 1)
        return F.struct(p["all"], p["marker"], unfolded(block).alias("h"),
                        F.regexp_replace(F.substring(p["s"], F.length(block) + 1, F.length(p["s"])), r"\A\n", "").alias("body"))

    def described(p: Column) -> Column:
        h = p["h"]
        ctype = _value(h, r"(?im)^content-type:[ \t]*([^;\s]+)")
        boundary = F.regexp_extract(h, r"(?im)^content-type:[^\n]*?boundary[ \t]*=[ \t]*(?:\"([^\"\\\n]+)\"|([^\";\s\\]+))", 0)
        return F.struct(
            p["all"], p["marker"], F.regexp_replace(p["marker"], r"--\z", "").alias("base"),
            F.when(ctype.startswith("multipart/"), F.regexp_replace(boundary, r"(?is)\A.*?boundary[ \t]*=[ \t]*|\"", "")).otherwise("").alias("opens"),
            F.struct(F.when(ctype.contains("/"), ctype).otherwise("text/plain").alias("ctype"),
                     _value(h, r"(?im)^content-transfer-encoding:[ \t]*\"?([^;\s\"]+)").alias("cte"),
                     _value(h, r"(?im)^content-type:[^\n]*?charset[ \t]*=[ \t]*[\"']?([^\"';\s]+)").alias("charset"),
                     p["body"].alias("body")).alias("leaf"))
    x = x.withColumn("_chunks_", F.transform(F.transform(F.transform(chunks, cut), headed), described))

    none = F.array().cast("array<struct<ctype:string,cte:string,charset:string,body:string>>")
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit(False).alias("inside"), none.alias("leaves"))

    def step(acc: Column, p: Column) -> Column:
        stack, found = acc["stack"], acc["leaves"]
        at = F.array_position(stack, p["marker"]).cast("int")
        end = F.array_position(stack, p["base"]).cast("int")
        last = F.get(found, F.size(found) - 1)
        longer = F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.array(F.struct(
            last["ctype"].alias("ctype"), last["cte"].alias("cte"), last["charset"].alias("charset"),
            F.concat(last["body"], F.lit("\n--"), p["all"]).alias("body"))))
        begins, opens = at > 0, p["opens"] != ""
        return F.struct(
            F.when(begins & opens, F.concat(F.slice(stack, F.lit(1), at), F.array(p["opens"]))).when(begins, F.slice(stack, F.lit(1), at))
            .when(end > 1, F.slice(stack, F.lit(1), end - 1)).otherwise(stack).alias("stack"),
            F.when(begins, ~opens).when(end > 1, F.lit(False)).otherwise(acc["inside"]).alias("inside"),
            F.when(begins & ~opens, F.concat(found, F.array(p["leaf"]))).when(begins | (end > 1) | ~acc["inside"], found)
            .otherwise(longer).alias("leaves"))
    return x.withColumn(out, F.aggregate("_chunks_", start, step, lambda acc: acc["leaves"])).drop("_raw_", "_named_", "_chunks_")


def _other_charsets(cells: pd.Series) -> pd.Series:
    def text(data, charset):
        try:
            return bytes(data).decode(charset, "ignore")
        except (LookupError, ValueError):
            return bytes(data).decode("utf-8", "ignore")
    return cells.map(lambda cell: None if cell is None else [None if x["data"] is None else text(x["data"], x["charset"]) for x in cell])


# Non-deterministic, so that a filter above the extraction is not pushed below it, which would run it twice.
_other_udf = F.pandas_udf(_other_charsets, T.ArrayType(T.StringType())).asNondeterministic()


def decoded(df: DataFrame, col: str = "_leaves") -> DataFrame:
    """``df`` with ``col`` as array of struct(ctype, text)."""
    wanted = F.transform(col, lambda p: F.struct(
        p["ctype"].alias("ctype"), p["charset"].alias("charset"), p["body"].alias("body"),
        F.when(~p["ctype"].isin("text/plain", "text/html"), F.lit(None).cast("binary"))
        .when(p["cte"] == "base64", from_base64(p["body"]))
        .when(p["cte"] == "quoted-printable", from_quoted_printable(p["body"])).alias("data")))
    x = df.withColumn(col, wanted)
    other = F.when(F.exists(col, lambda p: p["data"].isNotNull() & ~is_native(p["charset"])), F.transform(col, lambda p: F.struct(
        F.when(~is_native(p["charset"]), p["data"]).alias("data"), p["charset"].alias("charset"))))
    x = x.withColumn("_other_", _other_udf(other))
    text = F.transform(col, lambda p, i: F.struct(p["ctype"].alias("ctype"), F.regexp_replace(
        F.coalesce(F.get("_other_", i), from_charset(p["data"], p["charset"]), p["body"]), "\r\n?", "\n").alias("text")))
    return x.withColumn(col, text).drop("_other_")
