"""Intake queries: S1-S4, S7, S8, K1-K4."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text as tx
from quarry.operators import ingest as ig
from quarry.operators import store as st
from quarry.plans import fixtures as fx
from quarry.plans.registry import register
from quarry.plans.sqlbits import canon, plain_extract, strip
from quarry.session import shared_path
from quarry.sources import json_records as js
from quarry.sources.tables import TABLES, table

# ---------------------------------------------------------------- shared SQL

NORM_SQL = "WITH " + fx.UPLOADED_SQL + """,
norm AS (
  SELECT id, coalesce(nullif(text, ''), raw, '') AS text, raw, subject, user_id, lang, seq,
         (raw IS NOT NULL AND raw <> '') AS has_raw
  FROM uploaded)"""

KEYED_SQL = NORM_SQL + f""",
extracted AS (
  SELECT *, {plain_extract('raw_in')} AS text_lines
  FROM (SELECT *, coalesce(nullif(raw, ''), text, '') AS raw_in FROM norm)),
keyed AS (
  SELECT coalesce(nullif(id, ''), md5({canon('text_lines')})) AS id, {canon('text_lines')} AS text,
         seq, text_lines, user_id
  FROM extracted),
checked AS (
  SELECT *, CASE WHEN id IS NULL OR id = '' THEN 'missing_id'
                 WHEN text IS NULL OR {strip('text')} = '' THEN 'empty_text'
                 WHEN length(text) > {K.MAX_TEXT_CHARS} THEN 'text_too_long' END AS reason
  FROM keyed),
accepted AS (SELECT id, text, seq, user_id FROM checked WHERE reason IS NULL)"""


def _cut_sql(op: str) -> str:
    return f"seq {op} (SELECT count(*) FROM documents) / 2"


# ------------------------------------------------------------- Spark helpers

def keyed(spark, sf):
    return ig.keyed_documents(ig.normalise_records(fx.uploaded_records(spark, sf)))


def keyed_all(spark, sf, records=None):
    """Keyed documents with their S7 ``reason`` (null = accepted); consumers
    pass ``valid="reason"`` instead of filtering first (see first_per_key)."""
    recs = records if records is not None else fx.uploaded_records(spark, sf)
    return ig.keyed_documents(ig.normalise_records(recs))


def _half(spark, sf, upper: bool):
    recs = fx.uploaded_records(spark, sf)
    cut = table(spark, sf, "documents").agg(F.count(F.lit(1)) / 2).scalar()
    return recs.filter(F.col("seq") >= cut if upper else F.col("seq") < cut)


# ----------------------------------------------------------------- S1 source

@register("s1_json_source", "WITH " + fx.UPLOADED_SQL + """
SELECT id, text, raw, subject, user_id, lang, seq FROM uploaded""")
def s1_json_source(spark, sf):
    path = shared_path(spark, "s1_upload")
    js.write_record_files(fx.uploaded_records(spark, sf), path, n_files=8)
    recs = js.read_record_files(spark, path)
    return recs.filter(F.col("_reason").isNull()).select(
        "id", "text", "raw", "subject", "user_id",
        F.col("metadata")["lang"].alias("lang"), "seq")


@register("s2_normalise", NORM_SQL + """
SELECT seq, id, text, has_raw, subject AS meta_subject, user_id AS meta_user_id, lang AS meta_lang,
       CAST(3 + CASE WHEN has_raw THEN 1 ELSE 0 END AS BIGINT) AS n_meta_keys
FROM norm""")
def s2_normalise(spark, sf):
    n = ig.normalise_records(fx.uploaded_records(spark, sf))
    m = F.col("metadata")
    return n.select("seq", "id", "text", "has_raw",
                    m["subject"].alias("meta_subject"), m["user_id"].alias("meta_user_id"),
                    m["lang"].alias("meta_lang"), F.size(m).cast("bigint").alias("n_meta_keys"))


@register("s3_scan_limit", KEYED_SQL + """,
firsts AS (SELECT id, arg_min(text, seq) AS text, arg_min(user_id, seq) AS user_id
           FROM accepted GROUP BY id)
SELECT id, text, coalesce(nullif(user_id, ''), 'unknown') AS user_id
FROM firsts ORDER BY id LIMIT 100""")
def s3_scan_limit(spark, sf):
    recs = fx.uploaded_records(spark, sf)
    norm = ig.normalise_records(recs)
    docs = ig.keyed_documents(norm)
    stored = ig.first_per_key(docs.drop("text_lines"), valid="reason")
    return st.scan(stored, limit=100).select("id", "text", "user_id")


@register("s4_insert_if_absent", KEYED_SQL + f""",
store AS (SELECT DISTINCT id FROM accepted WHERE {_cut_sql('<')}),
incoming AS (SELECT * FROM accepted WHERE {_cut_sql('>=')})
SELECT id, min(seq) AS seq, count(*) AS copies
FROM incoming WHERE id NOT IN (SELECT id FROM store)
GROUP BY id""")
def s4_insert_if_absent(spark, sf):
    store = ig.first_per_key(keyed_all(spark, sf, _half(spark, sf, upper=False))
                             .select("id", "seq", "reason"), valid="reason")
    incoming = keyed_all(spark, sf, _half(spark, sf, upper=True)).select("id", "seq", "reason")
    return ig.insert_if_absent(incoming, store, valid="reason").select("id", "seq", "copies")


@register("s7_validate", KEYED_SQL + """
SELECT coalesce(reason, 'ok') AS reason, count(*) AS n_rows FROM checked GROUP BY 1""")
def s7_validate(spark, sf):
    v = keyed(spark, sf)
    return v.groupBy(F.coalesce(F.col("reason"), F.lit("ok")).alias("reason")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))


@register("s7_quarantine", KEYED_SQL + """
SELECT seq, id, reason, text FROM checked WHERE reason IS NOT NULL""")
def s7_quarantine(spark, sf):
    """The rejected rows, written as a table of their own and read back."""
    path = shared_path(spark, "quarantine")
    st.append(ig.quarantined(keyed(spark, sf)).select("seq", "id", "reason", "text"), path)
    return spark.read.parquet(path)


@register("s8_store_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def s8_store_counts(spark, sf):
    return st.table_counts({t: table(spark, sf, t) for t in TABLES})


# ------------------------------------------------------------------ K1 - K4

@register("k1_content_key", KEYED_SQL + """
SELECT seq, id, text FROM keyed""")
def k1_content_key(spark, sf):
    return keyed(spark, sf).select("seq", "id", "text")



@register("k2_dedup", KEYED_SQL + """
SELECT id, min(seq) AS first_seq, count(*) AS copies FROM accepted GROUP BY id""", headline=True)
def k2_dedup(spark, sf):
    firsts = ig.first_per_key(keyed_all(spark, sf).select("id", "seq", "reason"), valid="reason")
    return firsts.select("id", F.col("seq").alias("first_seq"), "copies")


@register("k2_accounting", KEYED_SQL + f""",
store AS (SELECT DISTINCT id FROM accepted WHERE {_cut_sql('<')}),
incoming AS (SELECT * FROM accepted WHERE {_cut_sql('>=')})
SELECT count(*) AS received,
       count(DISTINCT CASE WHEN id NOT IN (SELECT id FROM store) THEN id END) AS inserted,
       count(*) - count(DISTINCT CASE WHEN id NOT IN (SELECT id FROM store) THEN id END) AS duplicates
FROM incoming""")
def k2_accounting(spark, sf):
    store = ig.first_per_key(keyed_all(spark, sf, _half(spark, sf, upper=False))
                             .select("id", "seq", "reason"), valid="reason")
    incoming = keyed_all(spark, sf, _half(spark, sf, upper=True)).select("id", "seq", "reason")
    return ig.dedup_accounting(incoming, store, valid="reason")


@register("k3_repeated_lines", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
firsts AS (SELECT doc_id, line, min(pos) AS pos FROM lines GROUP BY doc_id, line)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text_dedup,
       CAST(count(*) AS BIGINT) AS n_lines
FROM firsts GROUP BY doc_id""")
def k3_repeated_lines(spark, sf):
    d = table(spark, sf, "documents")
    lines = F.array_distinct(F.split(F.col("text"), "\n"))
    return d.select("doc_id", tx.distinct_lines("text").alias("text_dedup"),
                    F.size(lines).cast("bigint").alias("n_lines"))


@register("k4_unique_audit", KEYED_SQL + """
SELECT id, count(*) AS n_rows FROM accepted GROUP BY id HAVING count(*) > 1""")
def k4_unique_audit(spark, sf):
    return ig.duplicate_keys(keyed_all(spark, sf).select("id", "reason"), valid="reason")
