"""Summary / inference queries: I1-I6, Q1 on the batch output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text as tx
from quarry.operators import infer as inf
from quarry.operators import ingest as ig
from quarry.operators import quality as ql
from quarry.operators import store as st
from quarry.operators import summarize as sm
from quarry.plans import fixtures as fx
from quarry.plans import q_intake as qi
from quarry.plans import sqlbits as sb
from quarry.plans.registry import register
from quarry.session import shared_path
from quarry.sources.tables import table

RUN_ID = "batch-1"


def i2_sql(src: str, key: str, text: str) -> str:
    """DuckDB CTEs computing I2 over ``src(key, text)``; result CTE ``i2``."""
    sent = sb.q(K.SENTENCE_RE)
    tok = sb.q(K.TOKEN_RE)
    return f"""s0 AS (SELECT {key} AS k, unnest(regexp_extract_all({text}, {sent}, 1)) AS sent,
              generate_subscripts(regexp_extract_all({text}, {sent}, 1), 1) AS pos FROM {src}),
s1 AS (SELECT k, {sb.strip('sent')} AS sent, pos FROM s0),
s2 AS (SELECT k, sent, min(pos) AS pos FROM s1 WHERE sent <> '' GROUP BY k, sent),
t0 AS (SELECT k, pos, unnest(regexp_extract_all(lower(sent), {tok}, 1)) AS tok FROM s2),
tf AS (SELECT k, tok, count(*) AS tf FROM t0 GROUP BY k, tok),
sc AS (SELECT t0.k, t0.pos, sum(tf.tf) AS tf_sum, count(*) AS n
       FROM t0 JOIN tf ON t0.k = tf.k AND t0.tok = tf.tok GROUP BY t0.k, t0.pos),
scored AS (SELECT s2.k, s2.pos, s2.sent, CAST(coalesce(sc.tf_sum * 1000 // sc.n, 0) AS BIGINT) AS score
           FROM s2 LEFT JOIN sc ON s2.k = sc.k AND s2.pos = sc.pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, pos) AS rk FROM scored),
i2 AS (SELECT k, string_agg(sent, ' ' ORDER BY pos) FILTER (WHERE rk <= 2) AS summary,
              string_agg(sent, ' ' ORDER BY pos) FILTER (WHERE rk <= 5) AS detailed_summary,
              count(*) AS n_sentences
       FROM ranked GROUP BY k)"""


# -------------------------------------------------------------------- I2


@register("i2_extractive_summary", "WITH " + i2_sql("documents", "doc_id", "text") + """
SELECT d.doc_id, i2.summary, i2.detailed_summary, i2.n_sentences
FROM documents d LEFT JOIN i2 ON d.doc_id = i2.k""", headline=True)
def i2_extractive_summary(spark, sf):
    d = table(spark, sf, "documents")
    return sm.extractive_summary(d, "doc_id", "text")


# -------------------------------------------------------------------- I3

_CAT_SQL, _PRI_SQL = sm.label_sql("subject", "text")


@register("i3_labels", "WITH " + fx.SUBJECTS_SQL + f"""
SELECT doc_id, {_CAT_SQL} AS category, {_PRI_SQL} AS priority FROM subj""")
def i3_labels(spark, sf):
    return sm.label(fx.subjects(spark, sf)).select("doc_id", "category", "priority")


# -------------------------------------------------------------------- I1


@register("i1_model_call")
def i1_model_call(spark, sf):
    """Rows-only: the model-call hook with a deterministic stand-in backend."""
    s = fx.subjects(spark, sf).select(
        "doc_id", tx.truncate_middle(tx.build_prompt("subject", "text")).alias("prompt"))
    out = inf.call_model(s, inf.FirstSentenceBackend, "prompt")
    return out.select("doc_id", "reply", "attempts", "error", "latency_ms")


# -------------------------------------------------------------------- I4


@register("i4_embedding")
def i4_embedding(spark, sf):
    """Rows-only: hashed, normalised term vectors of subject + I2 summary."""
    d = table(spark, sf, "documents")
    s = sm.extractive_summary(d, "doc_id", "text")
    subj = fx.subjects(spark, sf).select("doc_id", "subject")
    return inf.embed(s.join(subj, "doc_id"), "summary", "subject") \
        .select("doc_id", "embedding")


# --------------------------------------------------------------- I5, I6

def stored_emails(spark, sf) -> DataFrame:
    """The intake store: first accepted arrival per content key (S4 on an empty store)."""
    docs = ig.keyed_documents(ig.normalise_records(fx.uploaded_records(spark, sf)))
    return ig.first_per_key(docs.drop("text_lines"), valid="reason")


def write_store(spark, sf) -> DataFrame:
    """Upload path (S1-S4): ingest into a versioned store in the shared folder
    and return the stored table, read back from Parquet.  The batch job reads
    the store, as the service's batch endpoint reads its collection."""
    docs = ig.keyed_documents(ig.normalise_records(fx.uploaded_records(spark, sf)))
    tbl = st.InsertOnlyTable(spark, shared_path(spark, "emails"), key="id")
    tbl.insert_if_absent(docs.drop("text_lines"), part=0, valid="reason")
    return tbl.read()


def summarise(emails: DataFrame, run_id: str = RUN_ID) -> DataFrame:
    """I5 core (native backend): clean -> I2 + I3 -> T10 -> T11 -> Q1.

    ``emails`` as returned by S3 (``id, text, user_id, metadata``).
    """
    subject = F.col("metadata")["subject"]
    clean = tx.py_strip(tx.html_to_clean_text("text"))
    base = emails.select("id", clean.alias("text"), subject.alias("subject"))
    # labels are row-wise, so they ride along the summary's single shuffle
    x = sm.extractive_summary(sm.label(base, "subject", "text"), "id", "text", carry=True)
    parsed = F.struct(F.col("category"), F.lit(None).cast("string").alias("subject"),
                      F.col("summary"), F.col("detailed_summary").alias("detailedSummary"),
                      F.col("priority"))
    result = inf.route_result(parsed, F.col("text"), F.col("id"))
    out = x.select(*inf.project_result(result, F.col("id"), F.col("subject"), run_id))
    return out.withColumn("has_real_summary", ql.is_real_summary("summary"))


def run_batch_summarise(spark, emails: DataFrame, table_path: str, version: int,
                        run_id: str = RUN_ID) -> DataFrame:
    """Summarise, upsert the results by email id (S5, new version
    directory), and return one status row per email: success = stored and a
    real summary (Q1)."""
    results = summarise(emails, run_id)
    tbl = st.VersionedTable(spark, table_path, key="email_id")
    tbl.upsert(results.withColumn("updated_at", F.current_timestamp()), version)
    # status from what was stored (the results are not computed a second time)
    written = tbl.read().filter(F.col("updated_version") == F.lit(version))
    return written.select("email_id", "session_id", F.lit(True).alias("stored"),
                          "has_real_summary", "category", "priority", "summary",
                          F.col("has_real_summary").alias("success"))


_I5_SQL = qi.KEYED_SQL + f""",
firsts AS (SELECT id, arg_min(text, seq) AS text, min(seq) AS seq FROM accepted GROUP BY id),
emails AS (SELECT f.id, {sb.strip(sb.html_to_clean_text('f.text'))} AS text,
                  'Doc ' || CAST(f.seq AS VARCHAR) AS subject
           FROM firsts f),
{i2_sql('emails', 'id', 'text')},
lab AS (SELECT id, {sm.label_sql('subject', 'text')[0]} AS category,
               {sm.label_sql('subject', 'text')[1]} AS priority FROM emails),
res AS (SELECT e.id AS email_id, e.subject, e.text, l.category, l.priority, i2.summary,
               i2.detailed_summary
        FROM emails e JOIN lab l USING (id) LEFT JOIN i2 ON i2.k = e.id),
routed AS (SELECT email_id, subject,
             CASE WHEN summary IS NULL OR summary = '' OR {sb.strip('text')} = '' THEN NULL ELSE category END AS category,
             CASE WHEN summary IS NULL OR summary = '' OR {sb.strip('text')} = '' THEN NULL ELSE summary END AS summary,
             CASE WHEN summary IS NULL OR summary = '' OR {sb.strip('text')} = '' THEN NULL ELSE priority END AS priority
           FROM res)
SELECT email_id, sha256('{RUN_ID}:' || email_id) AS session_id, true AS stored,
       coalesce(summary IS NOT NULL AND length(summary) > 20
                AND NOT contains(lower(summary), 'fallback')
                AND NOT contains(lower(summary), 'excerpt'), false) AS has_real_summary,
       category, priority, summary,
       coalesce(summary IS NOT NULL AND length(summary) > 20
                AND NOT contains(lower(summary), 'fallback')
                AND NOT contains(lower(summary), 'excerpt'), false) AS success
FROM routed"""


@register("i5_batch_summarise", _I5_SQL, headline=True)
def i5_batch_summarise(spark, sf):
    emails = st.scan(write_store(spark, sf))
    return run_batch_summarise(spark, emails, shared_path(spark, "summaries"), version=1)


@register("i6_batch_report", "WITH " + _I5_SQL.split("WITH ", 1)[1].rsplit("SELECT email_id, sha256", 1)[0]
          + """SELECT CAST(count(*) AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE summary IS NOT NULL AND length(summary) > 20
             AND NOT contains(lower(summary), 'fallback') AND NOT contains(lower(summary), 'excerpt'))
            AS BIGINT) AS n_success,
       CASE WHEN count(*) = 0 THEN 'No emails found' END AS message
FROM routed""")
def i6_batch_report(spark, sf):
    status = i5_batch_summarise(spark, sf)
    return batch_report(status)


def batch_report(status: DataFrame) -> DataFrame:
    """Processed, successes, and the 'nothing found' message."""
    return status.agg(F.count(F.lit(1)).alias("processed"),
                      F.count(F.when(F.col("success"), F.lit(1))).alias("n_success")) \
        .withColumn("message", F.when(F.col("processed") == 0, F.lit("No emails found")))
