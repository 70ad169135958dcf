"""Feedback queries: F1-F5, and the table sinks S5 (upsert) and S6 (append)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import feedback as fb
from quarry.operators import store as st
from quarry.plans import fixtures as fx
from quarry.plans import sqlbits as sb
from quarry.plans.registry import register
from quarry.session import shared_path
from quarry.sources.tables import table

ENRICHED_SQL = "WITH " + fx.FEEDBACK_SQL + ",\n" + fx.SESSIONS_SQL + """,
enriched AS (SELECT f.*, s.email_type, s.original_summary, s.session_id IS NULL AS is_orphan
             FROM feedback f LEFT JOIN sessions s USING (session_id))"""


@register("f1_feedback_counters", ENRICHED_SQL + """
SELECT email_type, count(*) AS n_feedback, round(avg(rating), 4) AS avg_rating,
       count(*) FILTER (WHERE tone_off) AS n_tone_off,
       count(*) FILTER (WHERE wrong_priority) AS n_wrong_priority,
       count(*) FILTER (WHERE wrong_type) AS n_wrong_type
FROM enriched GROUP BY email_type""")
def f1_feedback_counters(spark, sf):
    e = fb.enrich(fx.feedback(spark, sf), fx.sessions(spark, sf))
    return fb.counters(e)


@register("f2_consolidation_trigger", "WITH " + fx.FEEDBACK_SQL + """
SELECT session_id, rank, (rank - 1) // 50 AS epoch, rank % 50 = 0 AS fires
FROM (SELECT session_id, row_number() OVER (ORDER BY seq) AS rank FROM feedback)""")
def f2_consolidation_trigger(spark, sf):
    p = fb.consolidation_points(fx.feedback(spark, sf), "seq")
    return p.select("session_id", "rank", "epoch", "fires")


_PHRASE_SQL = ("CASE issue " + " ".join(f"WHEN {sb.q(k)} THEN {sb.q(v)}" for k, v in fb.FLAG_PHRASES.items())
               + f" ELSE {sb.q(fb.MISSING_PHRASE.split('{item}')[0])} || substr(issue, 9) || "
               f"{sb.q(fb.MISSING_PHRASE.split('{item}')[1])} END")

RULES_SQL = fx.FEEDBACK_SQL + """,
issues AS (
  SELECT 'tone_off' AS issue, count(*) FILTER (WHERE tone_off) AS n FROM feedback
  UNION ALL SELECT 'wrong_priority', count(*) FILTER (WHERE wrong_priority) FROM feedback
  UNION ALL SELECT 'wrong_type', count(*) FILTER (WHERE wrong_type) FROM feedback
  UNION ALL SELECT 'missing:' || item, count(*) FROM (SELECT unnest(missing_items) AS item FROM feedback)
            WHERE item IS NOT NULL AND item <> '' GROUP BY item),
top AS (SELECT * FROM issues WHERE n >= 5),
rules AS (SELECT CASE WHEN count(*) > 0 THEN 'Learned rules from user feedback:' || chr(10) ||
                   string_agg('- ' || """ + _PHRASE_SQL + """ || ' (' || CAST(n AS VARCHAR) || ' reports)',
                              chr(10) ORDER BY n DESC, issue) ELSE '' END AS instructions
          FROM top)"""


@register("f3_consolidate", "WITH " + RULES_SQL + "\nSELECT instructions FROM rules")
def f3_consolidate(spark, sf):
    return fb.consolidate(fx.feedback(spark, sf))


@register("f4_feedback_enrich", ENRICHED_SQL + """
SELECT session_id, rating, email_type, original_summary, is_orphan FROM enriched""")
def f4_feedback_enrich(spark, sf):
    e = fb.enrich(fx.feedback(spark, sf), fx.sessions(spark, sf))
    return e.select("session_id", "rating", "email_type", "original_summary", "is_orphan")


@register("f5_rules_prompt", "WITH " + RULES_SQL + ",\n" + fx.SUBJECTS_SQL + f"""
SELECT doc_id, {sb.build_prompt('subject', 'text', "(SELECT instructions FROM rules)")} AS prompt
FROM subj""")
def f5_rules_prompt(spark, sf):
    rules = fb.current_rules(fb.consolidate(fx.feedback(spark, sf)))
    s = fx.subjects(spark, sf)
    return s.select("doc_id", tx.build_prompt("subject", "text", rules).alias("prompt"))


# ----------------------------------------------------------------- sinks


@register("s5_upsert", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn = 1""")
def s5_upsert(spark, sf):
    """Even turns are the stored version 1, odd turns arrive as version 2;
    the newest turn per conversation wins."""
    c = table(spark, sf, "conversations")
    tbl = st.VersionedTable(spark, shared_path(spark, "conversations"), key="conv_id")
    tbl.write_version(st.latest_per_key(c.filter(F.col("turn") % 2 == 0), "conv_id", "turn"), 1)
    tbl.upsert(c.filter(F.col("turn") % 2 == 1), version=2, order="turn")
    return tbl.read().select("conv_id", "turn", "role", "text")


@register("s6_feedback_append", "WITH " + fx.FEEDBACK_SQL + """
SELECT session_id, rating, tone_off, wrong_priority, wrong_type,
       CAST(len(missing_items) AS INTEGER) AS n_missing FROM feedback""")
def s6_feedback_append(spark, sf):
    """Two appends (split on seq parity) into one feedback table, read back."""
    f = fx.feedback(spark, sf)
    path = shared_path(spark, "feedback")
    st.append(f.filter(F.col("seq") % 2 == 0), path)
    st.append(f.filter(F.col("seq") % 2 == 1), path)
    back = st.read_or_empty(spark, path, fb.FEEDBACK_SCHEMA)
    return back.select("session_id", "rating", "tone_off", "wrong_priority", "wrong_type",
                       F.size("missing_items").alias("n_missing"))
