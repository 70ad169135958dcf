"""Raw message -> text, as a job over a table of raw messages.

Plain, HTML and one-level multipart messages in 7bit/8bit are handled with
Catalyst string expressions (header/body split, content-type routing, boundary
split with ``transform``).  Messages with base64 / quoted-printable parts or nested
multiparts go through ``mime_tree``, expressions too; only bytes of multi-byte charsets go to
an Arrow-batched helper, to which all other rows pass a null.

Decisions (see README):
* line ends are made ``\\n`` first; the lines before the first blank line are a
  header block if all are ``name: value`` or continuations and one of them has a
  known name; otherwise the whole text is ``text/plain``;
* a boundary counts only as a line of its own;
* non-ASCII characters are kept (the intent of the reference, not its bug);
* separators are real newlines;
* an empty result falls back to T2 (body after the first blank line, tags
  stripped, whitespace collapsed, 8,000 characters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text as tx
from quarry.sources import mime_tree

HEADER_LINE_RE = r"\A[!-9;-~]+[ \t]*:"
HEADER_OR_MORE_RE = r"\A(?:[ \t]|[!-9;-~]+[ \t]*:)"
KNOWN_HEADER_RE = r"(?i)\A(?:" + "|".join(K.KNOWN_HEADERS) + r")[ \t]*:"
CTYPE_RE = r"(?im)^content-type:[ \t]*([^;\s]+)"
BOUNDARY_RE = r'(?i)boundary[ \t]*=[ \t]*"?([^";\s]+)"?'
ENCODED_RE = r"(?im)^content-transfer-encoding:[ \t]*(?:base64|quoted-printable)"
NESTED_RE = r"(?im)^content-type:[ \t]*(?:multipart/|message/rfc822)"


def _leaf(ctype: Column, body: Column) -> Column:
    return (F.when(ctype == F.lit("text/plain"), body)
            .when(ctype == F.lit("text/html"), tx.html_text_lines(body))
            .otherwise(F.lit("")))


def _part_text(p: Column) -> Column:
    """One MIME part: any header block (lines before the first blank line)."""
    p = F.regexp_replace(p, r"\n\z", "")
    return F.struct(p.alias("p"), F.locate("\n\n", p).alias("pos"),
                    (~p.startswith("\n") & F.regexp_like(p, F.lit(r"\A[^\s:]+[ \t]*:")))
                    .alias("has"))


def _part_leaf(s: Column) -> Column:
    p, pos, has = s["p"], s["pos"], s["has"]
    hdr = F.when(has, F.when(pos > 0, p.substr(F.lit(1), pos - 1)).otherwise(p)).otherwise(F.lit(""))
    body = F.when(has, F.when(pos > 0, p.substr(pos + 2, F.length(p))).otherwise(F.lit(""))) \
        .when(p.startswith("\n"), p.substr(F.lit(2), F.length(p))).otherwise(p)
    ctype = F.lower(F.regexp_extract(hdr, CTYPE_RE, 1))
    return _leaf(F.when(ctype == F.lit(""), F.lit("text/plain")).otherwise(ctype), body)


def extract_text(df: DataFrame, raw_col: str = "raw", out_col: str = "extracted", parts_col: str | None = None) -> DataFrame:
    """Add ``out_col`` with the extracted text of ``raw_col``, and ``parts_col``, if named, with the number of leaf parts.

    The work is staged in projections that reference earlier columns, so each
    regular expression runs once per row (Catalyst does not collapse a
    projection whose expensive column is used twice above it).
    """
    cols = df.columns
    c = F.col
    x = df.withColumn("_raw", F.regexp_replace(F.coalesce(c(raw_col), F.lit("")), "\r\n?", "\n"))
    x = x.withColumn("_pos", F.locate("\n\n", c("_raw")))
    # the header block ends at the first blank line; texts that do not begin like one are not cut into lines
    block = F.when(F.regexp_like(c("_raw"), F.lit(HEADER_LINE_RE)), F.split(
        F.when(c("_pos") > 0, c("_raw").substr(F.lit(1), c("_pos") - 1)).otherwise(F.regexp_replace(c("_raw"), r"\n\z", "")), "\n"))
    x = x.withColumn("_block", block).withColumn("_has", F.coalesce(
        F.forall("_block", lambda v: F.regexp_like(v, F.lit(HEADER_OR_MORE_RE)))
        & F.exists("_block", lambda v: F.regexp_like(v, F.lit(KNOWN_HEADER_RE))), F.lit(False)))
    x = x.withColumn("_hdr", F.when(c("_has"), F.when(c("_pos") > 0, c("_raw").substr(
        F.lit(1), c("_pos") - 1)).otherwise(c("_raw"))).otherwise(F.lit(""))) \
         .withColumn("_body", F.when(c("_has"), F.when(c("_pos") > 0, c("_raw").substr(
             c("_pos") + 2, F.length(c("_raw")))).otherwise(F.lit(""))).otherwise(c("_raw")))
    ct = F.lower(F.regexp_extract(c("_hdr"), CTYPE_RE, 1))
    x = x.withColumn("_ctype", F.when(ct == F.lit(""), F.lit("text/plain")).otherwise(ct)) \
         .withColumn("_boundary", F.regexp_extract(c("_hdr"), BOUNDARY_RE, 1))
    x = x.withColumn("_multi", c("_ctype").startswith("multipart/") & (c("_boundary") != F.lit("")))
    # part headers live in the body only for multiparts: plain bodies are not scanned
    x = x.withColumn("_route", c("_has") & (
        F.regexp_like(c("_hdr"), F.lit(ENCODED_RE))
        | (c("_multi") & (F.regexp_like(c("_body"), F.lit(ENCODED_RE))
                          | F.regexp_like(c("_body"), F.lit(NESTED_RE))))))
    # a boundary is a line of its own; what follows the closing one is no part
    mark = F.concat(F.lit(r"(?m)^\Q--"), c("_boundary"), F.lit(r"\E"))
    opened = F.get(F.split(c("_body"), F.concat(mark, F.lit(r"--[ \t]*$"))), 0)
    chunks = F.split(opened, F.concat(mark, F.lit(r"[ \t]*(?:\n|\z)")))
    inner = F.slice(chunks, F.lit(2), F.size(chunks))
    x = x.withColumn("_parts", F.when(c("_multi") & ~c("_route"), F.transform(inner, _part_text)))
    multi = F.array_join(F.filter(F.transform(c("_parts"), _part_leaf),
                                  lambda t: tx.py_strip(t) != F.lit("")), "\n\n")
    x = x.withColumn("_text", tx.py_strip(
        F.when(c("_route"), F.lit("")).when(c("_multi"), multi)
        .otherwise(_leaf(c("_ctype"), c("_body")))))
    x = mime_tree.decoded(mime_tree.leaves(x, F.when(c("_route"), c("_raw"))))
    tree = F.array_join(F.filter(F.transform("_leaves", lambda p: _leaf(p["ctype"], p["text"])),
                                 lambda t: tx.py_strip(t) != F.lit("")), "\n\n")
    x = x.withColumn("_text", F.when(c("_route"), tx.py_strip(tree)).otherwise(c("_text")))
    out = (F.when(c("_raw") == F.lit(""), F.lit(""))
           .when(c("_text") == F.lit(""), tx.fallback_body(c("_raw")))
           .otherwise(c("_text")))
    # never null: keys derived from it are then non-nullable, so no
    # ``isnotnull`` filter is inferred (and pushed down) from joins on them
    n_parts = F.when(c("_route"), F.size("_leaves")).when(c("_multi"), F.size("_parts")).otherwise(1).cast("bigint")
    return x.select(*[c(k) for k in cols], F.coalesce(out, F.lit("")).alias(out_col), *([n_parts.alias(parts_col)] if parts_col else []))
