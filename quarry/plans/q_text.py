"""Text-job queries: T1-T8."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.plans import fixtures as fx
from quarry.plans import sqlbits as sb
from quarry.plans.registry import register
from quarry.sources import mime_tree
from quarry.sources.mime import extract_text
from quarry.sources.tables import table

# --------------------------------------------------------------------- T1

_T1_PLAIN_BODY = "substr(raw, strpos(raw, chr(10) || chr(10)) + 2)"
_T1_SQL = "WITH " + fx.MIME_SQL + f""",
src AS (SELECT m.doc_id, m.raw, d.text, p.html
        FROM mime m JOIN documents d USING (doc_id)
        LEFT JOIN pages p ON d.doc_id % (SELECT count(*) FROM pages) = p.page_id),
parts AS (
  SELECT doc_id, raw,
    CASE WHEN doc_id % 3 = 0 THEN {_T1_PLAIN_BODY}
         WHEN doc_id % 3 = 1 THEN {sb.html_text_lines('html')}
         ELSE array_to_string(list_filter([text, {sb.html_text_lines('html')}],
                                          lambda x: {sb.strip('x')} <> ''), chr(10) || chr(10))
    END AS t
  FROM src),
stripped AS (SELECT doc_id, raw, {sb.strip('t')} AS t FROM parts)
SELECT doc_id, CASE WHEN raw = '' THEN '' WHEN t = '' THEN {sb.fallback_body('raw')} ELSE t END AS text
FROM stripped"""


@register("t1_mime_extract", _T1_SQL)
def t1_mime_extract(spark, sf):
    m = fx.mime_messages(spark, sf)
    return extract_text(m, "raw", "text").select("doc_id", "text")


_T1_TREE_SQL = f"""WITH src AS (
  SELECT doc_id, 'Doc ' || doc_id AS head, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text, coalesce(html, '') AS html
  FROM documents d LEFT JOIN pages p ON d.doc_id % (SELECT count(*) FROM pages) = p.page_id),
parts AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 4 ELSE 1 END::BIGINT AS n_parts,
    CASE WHEN doc_id % 4 = 3 THEN head || ' caf\u00e9' || chr(10) || regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')
         WHEN doc_id % 4 = 2 THEN array_to_string(list_filter(
           [head || chr(10) || text, {sb.html_text_lines('html')}, 'forwarded ' || doc_id], lambda x: {sb.strip('x')} <> ''), chr(10) || chr(10))
         ELSE head || chr(10) || text END AS t
  FROM src)
SELECT doc_id, 'D\u00fcsseldorf ' || doc_id || 'caf\u00e9 ' || doc_id || ' end' AS subject, n_parts, {sb.strip('t')} AS text FROM parts"""


@register("t1_mime_tree", _T1_TREE_SQL)
def t1_mime_tree(spark, sf):
    """Encoded and nested messages made from every document: subject, number of leaf parts, text."""
    m = fx.mime_tree_messages(spark, sf)
    m = m.select("doc_id", "raw", mime_tree.header(F.col("raw"), "subject").alias("subject"))
    return extract_text(m, "raw", "text", "n_parts").select("doc_id", "subject", "n_parts", "text")


# --------------------------------------------------------------------- T2


@register("t2_fallback_body", f"""
SELECT page_id, {sb.fallback_body('html')} AS body FROM pages""")
def t2_fallback_body(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.fallback_body("html").alias("body"))


# --------------------------------------------------------------------- T3


@register("t3_html_clean", f"""
SELECT page_id, {sb.html_to_clean_text('html')} AS clean_text FROM pages""", headline=True)
def t3_html_clean(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.html_to_clean_text("html").alias("clean_text"))


# --------------------------------------------------------------------- T4

_ANCHOR = sb.q(tx.K.ANCHOR_RE)


@register("t4_link_edges", f"""
WITH h AS (SELECT page_id, {sb.drop_invisible('html')} AS html FROM pages),
l AS (SELECT page_id, regexp_extract_all(html, {_ANCHOR}, 1) AS h1, regexp_extract_all(html, {_ANCHOR}, 2) AS h2,
             regexp_extract_all(html, {_ANCHOR}, 3) AS h3, regexp_extract_all(html, {_ANCHOR}, 4) AS texts FROM h),
e AS (SELECT page_id, pos, coalesce(h1[pos], '') || coalesce(h2[pos], '') || coalesce(h3[pos], '') AS raw_href,
             {sb.rx('texts[pos]', tx.K.ANY_TAG_RE, '')} AS raw_text
      FROM (SELECT *, generate_subscripts(texts, 1) AS pos FROM l)),
t AS (SELECT page_id, pos, {sb.decode_entities('raw_href')} AS href, {sb.strip(sb.decode_entities('raw_text'))} AS txt FROM e)
SELECT page_id, CAST(pos AS INTEGER) AS pos, href, CASE WHEN txt = '' THEN 'Link' ELSE txt END AS link_text FROM t""")
def t4_link_edges(spark, sf):
    p = table(spark, sf, "pages")
    hrefs, texts = tx.link_edges("html")
    e = p.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("t")))
                 .alias("pos0", "l"))
    txt = F.col("l.t")
    return e.select("page_id", (F.col("pos0") + 1).cast("int").alias("pos"),
                    F.col("l.href").alias("href"),
                    F.when(tx.py_strip(txt) == F.lit(""), F.lit(tx.K.EMPTY_LINK_TEXT))
                    .otherwise(txt).alias("link_text"))


# --------------------------------------------------------------------- T5


@register("t5_whitespace", f"""
SELECT doc_id, {sb.canon('text')} AS collapsed, {sb.normalise_lines('text')} AS normalised
FROM documents""")
def t5_whitespace(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.collapse_ws("text").alias("collapsed"),
                    tx.normalise_lines("text").alias("normalised"))


# --------------------------------------------------------------------- T6


@register("t6_significant_html", f"""
SELECT page_id, CAST(length({sb.strip(sb.visible_text('html'))}) AS INTEGER) AS n_visible,
       length({sb.strip(sb.visible_text('html'))}) >= 50 AS significant
FROM pages""")
def t6_significant_html(spark, sf):
    p = table(spark, sf, "pages").withColumn("_v", tx.py_strip(tx.visible_text("html")))
    return p.select("page_id", F.length("_v").alias("n_visible"),
                    (F.length("_v") >= F.lit(tx.K.SIGNIFICANT_HTML_CHARS)).alias("significant"))


# ----------------------------------------------------------------- T7, T8


@register("t7_prompt", "WITH " + fx.SUBJECTS_SQL + f"""
SELECT doc_id, {sb.build_prompt('subject', 'text')} AS prompt FROM subj""")
def t7_prompt(spark, sf):
    s = fx.subjects(spark, sf)
    return s.select("doc_id", tx.build_prompt("subject", "text").alias("prompt"))


@register("t8_truncate", "WITH " + fx.SUBJECTS_SQL + f""",
p AS (SELECT doc_id, {sb.build_prompt('subject', 'text')} AS prompt FROM subj)
SELECT doc_id, {sb.truncate_middle('prompt')} AS prompt_trimmed,
       length(prompt) > 4500 AS was_truncated
FROM p""")
def t8_truncate(spark, sf):
    s = fx.subjects(spark, sf).select(
        "doc_id", tx.build_prompt("subject", "text").alias("prompt"))
    return s.select("doc_id", tx.truncate_middle("prompt").alias("prompt_trimmed"),
                    (F.length("prompt") > F.lit(tx.K.TRUNCATE_LIMIT)).alias("was_truncated"))
