"""Derived inputs: the driver tables reshaped into the service's record shapes.

Each fixture exists twice, once as a Spark DataFrame and once as a DuckDB CTE
(``*_SQL``), built from the same ``concat``/``CASE`` rules so that a query and
its oracle see identical input.  All of them read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

# --- uploaded records (S1/S2/S7/K1/K2/S4) -----------------------------------
# id null on even doc_id; text null on doc_id % 6 = 3 (raw is used instead),
# blank on doc_id % 50 = 7 (quarantined);
# raw = a plain MIME message around the text on doc_id % 3 = 0.


def uploaded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.when(F.col("doc_id") % 2 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("id"),
        F.when(F.col("doc_id") % 6 == 3, F.lit(None).cast("string"))
         .when(F.col("doc_id") % 50 == 7, F.lit(" \t "))
         .otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 3 == 0,
               F.concat(F.lit("Subject: Doc "), F.col("doc_id").cast("string"),
                        F.lit("\nContent-Type: text/plain\n\n"), F.col("text"))).alias("raw"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("subject"),
        F.col("source").alias("user_id"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        F.col("doc_id").alias("seq"),
    )


UPLOADED_SQL = """uploaded AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'd' || CAST(doc_id AS VARCHAR) END AS id,
         CASE WHEN doc_id % 6 = 3 THEN NULL WHEN doc_id % 50 = 7 THEN ' ' || chr(9) || ' '
              ELSE text END AS text,
         CASE WHEN doc_id % 3 = 0 THEN 'Subject: Doc ' || CAST(doc_id AS VARCHAR) || chr(10)
              || 'Content-Type: text/plain' || chr(10) || chr(10) || text END AS raw,
         'Doc ' || CAST(doc_id AS VARCHAR) AS subject,
         source AS user_id, lang, doc_id AS seq
  FROM documents)"""


# --- MIME messages (T1) -------------------------------------------------------
# doc_id % 3 = 0: plain; 1: HTML (a page body); 2: two-part plain + HTML.


def mime_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("html"))
    n_pages = p.agg(F.count(F.lit(1))).scalar()
    d = d.withColumn("page_key", F.col("doc_id") % n_pages)
    j = d.join(p, d.page_key == p.page_id, "left")
    plain = F.concat(F.lit("Subject: Doc "), F.col("doc_id").cast("string"),
                     F.lit("\nContent-Type: text/plain\n\n"), F.col("text"))
    html = F.concat(F.lit("Content-Type: text/html\n\n"), F.col("html"))
    multi = F.concat(F.lit("Subject: Doc "), F.col("doc_id").cast("string"),
                     F.lit("\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=\"b1\"\n\n"
                           "preamble\n--b1\nContent-Type: text/plain\n\n"), F.col("text"),
                     F.lit("\n--b1\nContent-Type: text/html\n\n"), F.col("html"),
                     F.lit("\n--b1--\n"))
    raw = F.when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, html) \
        .otherwise(multi)
    return j.select("doc_id", raw.alias("raw"))


MIME_SQL = """mime AS (
  SELECT d.doc_id,
    CASE WHEN d.doc_id % 3 = 0 THEN
           'Subject: Doc ' || CAST(d.doc_id AS VARCHAR) || chr(10) || 'Content-Type: text/plain' || chr(10) || chr(10) || d.text
         WHEN d.doc_id % 3 = 1 THEN 'Content-Type: text/html' || chr(10) || chr(10) || p.html
         ELSE 'Subject: Doc ' || CAST(d.doc_id AS VARCHAR) || chr(10) || 'MIME-Version: 1.0' || chr(10)
           || 'Content-Type: multipart/alternative; boundary="b1"' || chr(10) || chr(10)
           || 'preamble' || chr(10) || '--b1' || chr(10) || 'Content-Type: text/plain' || chr(10) || chr(10)
           || d.text || chr(10) || '--b1' || chr(10) || 'Content-Type: text/html' || chr(10) || chr(10)
           || p.html || chr(10) || '--b1--' || chr(10)
    END AS raw
  FROM documents d LEFT JOIN pages p ON d.doc_id % (SELECT count(*) FROM pages) = p.page_id)"""


# --- encoded and nested MIME messages (T1) -------------------------------------
# doc_id % 4: 0 base64, 1 quoted-printable, 2 three levels of multiparts and a forwarded message, 3 base64 in ISO-8859-1.


def mime_tree_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    n_pages = p.agg(F.count(F.lit(1))).scalar()
    j = d.withColumn("page_key", F.col("doc_id") % n_pages).join(p, F.col("page_key") == p.page_id, "left")
    no = F.col("doc_id").cast("string")

    def b64(data):
        return F.regexp_replace(F.base64(data), "([^\r\n]{76})", "$1\n")

    def qp(data):
        return F.regexp_replace(F.regexp_replace(F.hex(data), "(..)", "=$1"), "((?:=..){25})", "$1=\n")
    body = F.concat(F.lit("Doc "), no, F.lit("\n"), F.col("text"))
    latin = F.concat(F.lit("Doc "), no, F.lit(" caf\u00e9\n"), F.regexp_replace("text", r"[^\x00-\x7F]", ""))
    subject = F.concat(F.lit("Subject: =?utf-8?B?"), F.base64(F.concat(F.lit("D\u00fcsseldorf "), no).cast("binary")),
                       F.lit("?=\n =?iso-8859-1?q?caf=E9_"), no, F.lit("?= end\nMIME-Version: 1.0\n"))
    plain = F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: ")
    nested = F.concat(
        F.lit('Content-Type: multipart/mixed;\n boundary="b1"\n\npreamble\n--b1\nContent-Type: multipart/related; boundary="b 2"\n\n--b 2\n'
              'Content-Type: multipart/alternative; boundary=b3\n\n--b3\n'), plain, F.lit("quoted-printable\n\n"), qp(body.cast("binary")),
        F.lit("\n--b3\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), b64(F.coalesce("html", F.lit("")).cast("binary")),
        F.lit("\n--b3--\n\n--b 2\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\niVBORw0KGgo=\n--b 2--\n--b1\n"
              "Content-Type: message/rfc822\n\nSubject: inner\nContent-Type: text/plain\n\nforwarded "), no, F.lit("\n--b1--\nepilogue\n"))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.concat(plain, F.lit("base64\n\n"), b64(body.cast("binary")))) \
        .when(kind == 1, F.concat(plain, F.lit("quoted-printable\n\n"), qp(body.cast("binary")))).when(kind == 2, nested) \
        .otherwise(F.concat(F.lit("Content-Type: text/plain; charset=ISO-8859-1\nContent-Transfer-Encoding: base64\n\n"),
                            b64(F.encode(latin, "ISO-8859-1"))))
    return j.select("doc_id", F.concat(subject, raw).alias("raw"))


# --- model replies (T9/T10/T11/Q5) -------------------------------------------
# The reply carries letters-and-spaces only, so no JSON escaping is needed.
# doc_id % 4: 0 fenced json, 1 prose around the object, 2 invalid (unquoted), 3 bare.
# category from a list that includes one value outside the enum.

REPLY_CATEGORIES = ("Work", "Personal", "Newsletter", "Finance", "HR", "Other", "Spam")
REPLY_PRIORITIES = ("Urgent", "Important", "Normal", "Low", "Critical")


def _pick(values, idx_col):
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx_col % len(values) + 1).cast("int"))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.trim(F.regexp_replace(F.col("text"), r"[^\p{L} ]", ""))
    obj = F.concat(
        F.lit('{"category": "'), _pick(REPLY_CATEGORIES, F.col("doc_id")),
        F.lit('", "subject": "Doc '), F.col("doc_id").cast("string"),
        F.lit('", "summary": "'), F.when(F.col("doc_id") % 9 == 4, F.lit("")).otherwise(words),
        F.lit('", "detailedSummary": "'), words, F.lit(" "), words,
        F.lit('", "priority": "'), _pick(REPLY_PRIORITIES, F.col("doc_id")), F.lit('"}'))
    reply = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
             .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Here is the result: "), obj,
                                                      F.lit(" Thanks.")))
             .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("{category: Work, summary: "),
                                                      words, F.lit("}")))
             .otherwise(obj))
    body = F.when(F.col("doc_id") % 10 == 5, F.lit("")).otherwise(F.col("text"))
    subject = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    return d.select(F.col("doc_id"), reply.alias("reply"), body.alias("body"),
                    subject.alias("meta_subject"))


def _sql_pick(values, idx):
    arr = "[" + ", ".join("'" + v + "'" for v in values) + "]"
    return f"{arr}[({idx} % {len(values)}) + 1]"


REPLIES_SQL = f"""replies AS (
  SELECT doc_id, reply, body, meta_subject FROM (
    SELECT doc_id,
      CASE WHEN doc_id % 10 = 5 THEN '' ELSE text END AS body,
      CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || CAST(doc_id AS VARCHAR) END AS meta_subject,
      words,
      '{{"category": "' || {_sql_pick(REPLY_CATEGORIES, 'doc_id')} || '", "subject": "Doc ' || CAST(doc_id AS VARCHAR)
        || '", "summary": "' || CASE WHEN doc_id % 9 = 4 THEN '' ELSE words END
        || '", "detailedSummary": "' || words || ' ' || words
        || '", "priority": "' || {_sql_pick(REPLY_PRIORITIES, 'doc_id')} || '"}}' AS obj
    FROM (SELECT doc_id, text,
            trim(regexp_replace(text, '[^\\p{{L}} ]', '', 'g')) AS words
          FROM documents)
  ) q,
  LATERAL (SELECT CASE WHEN doc_id % 4 = 0 THEN '```json' || chr(10) || obj || chr(10) || '```'
                       WHEN doc_id % 4 = 1 THEN 'Here is the result: ' || obj || ' Thanks.'
                       WHEN doc_id % 4 = 2 THEN '{{category: Work, summary: ' || words || '}}'
                       ELSE obj END AS reply))"""


# --- subjects with rule words (I3/Q5) -----------------------------------------

SUBJECT_WORDS = ("invoice", "payroll", "newsletter", "urgent", "meeting", "birthday")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    subj = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(" "),
                    _pick(SUBJECT_WORDS, F.col("doc_id")))
    return d.select("doc_id", subj.alias("subject"), F.col("text"))


SUBJECTS_SQL = f"""subj AS (
  SELECT doc_id, 'Doc ' || CAST(doc_id AS VARCHAR) || ' ' || {_sql_pick(SUBJECT_WORDS, 'doc_id')} AS subject, text
  FROM documents)"""


# --- feedback and sessions (S6/F1-F5/Q2) --------------------------------------
# labels as ratings: rating = 1 + 4*quality, wrong_type = toxic = 1;
# tone_off on doc_id % 7 = 0, wrong_priority on doc_id % 5 = 1;
# missing_items picked by doc_id % 5 (index 0 = none).

MISSING_ITEMS = ("", "deadline", "amount", "owner", "deadline,amount")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    items = _pick(MISSING_ITEMS, F.col("doc_id"))
    return lab.select(
        F.col("doc_id").cast("string").alias("session_id"),
        (F.lit(1) + F.lit(4) * F.col("quality")).cast("int").alias("rating"),
        F.lit(None).cast("string").alias("correction"),
        F.when(items == F.lit(""), F.array().cast("array<string>"))
         .otherwise(F.split(items, ",")).alias("missing_items"),
        (F.col("doc_id") % 7 == 0).alias("tone_off"),
        (F.col("doc_id") % 5 == 1).alias("wrong_priority"),
        (F.col("toxic") == 1).alias("wrong_type"),
        F.lit(None).cast("string").alias("note"),
        F.col("doc_id").alias("seq"),
    )


FEEDBACK_SQL = f"""feedback AS (
  SELECT CAST(doc_id AS VARCHAR) AS session_id,
         CAST(1 + 4 * quality AS INTEGER) AS rating,
         CASE WHEN {_sql_pick(MISSING_ITEMS, 'doc_id')} = '' THEN []::VARCHAR[]
              ELSE string_split({_sql_pick(MISSING_ITEMS, 'doc_id')}, ',') END AS missing_items,
         doc_id % 7 = 0 AS tone_off, doc_id % 5 = 1 AS wrong_priority, toxic = 1 AS wrong_type,
         doc_id AS seq
  FROM labels)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh session is missing, so that feedback has orphans."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 11 != 3)
    return d.select(F.col("doc_id").cast("string").alias("session_id"),
                    F.col("source").alias("email_type"),
                    F.col("text").alias("original_summary"))


SESSIONS_SQL = """sessions AS (
  SELECT CAST(doc_id AS VARCHAR) AS session_id, source AS email_type,
         text AS original_summary
  FROM documents WHERE doc_id % 11 <> 3)"""


# --- key details (Q6) ---------------------------------------------------------

KEY_DETAIL_SUFFIX = " Ref AB-12 CD-34 EF-56 due 2024-05-01 $1,200.50 contact ops@example.com"


def key_detail_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text"), F.lit(KEY_DETAIL_SUFFIX))) \
        .otherwise(F.col("text"))
    return d.select("doc_id", t.alias("text"))


KEY_DETAIL_SQL = f"""kd AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || '{KEY_DETAIL_SUFFIX}' ELSE text END AS text
  FROM documents)"""


# --- cache table (C2/C3) ------------------------------------------------------
# Entries: key = user_id, ts = event time, value = props ('{}' for errors).
# Lookups: the keys of 'click' events, at a fixed "now".

CACHE_NOW = "2024-01-31 00:00:00"


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").alias("ts"),
        F.when(F.col("event_type") == F.lit("error"), F.lit("{}")).otherwise(F.col("props"))
         .alias("value"),
        F.col("event_id").alias("seq"))


CACHE_SQL = """cache_entries AS (
  SELECT CAST(user_id AS VARCHAR) AS key, ts,
         CASE WHEN event_type = 'error' THEN '{}' ELSE props END AS value, event_id AS seq
  FROM events)"""


def cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.filter(F.col("event_type") == F.lit("click")) \
        .select(F.col("user_id").cast("string").alias("key")).distinct()


LOOKUPS_SQL = """lookups AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'click')"""
