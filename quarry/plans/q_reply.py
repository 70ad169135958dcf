"""Reply queries: T9 parsing, T10 fallback routing, T11 projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import infer as inf
from quarry.plans import fixtures as fx
from quarry.plans import sqlbits as sb
from quarry.plans.registry import register

RUN_ID = "batch-1"

PARSED_SQL = "WITH " + fx.REPLIES_SQL + f""",
o AS (SELECT doc_id, body, meta_subject,
             regexp_extract({sb.strip(sb.rx(sb.rx('reply', inf.FENCE_OPEN_RE), inf.FENCE_CLOSE_RE))},
                            {sb.q(inf.OBJECT_RE)}, 1) AS obj
      FROM replies),
j AS (SELECT doc_id, body, meta_subject,
             CASE WHEN obj <> '' AND json_valid(obj) AND json_type(obj) = 'OBJECT' THEN obj END AS js
      FROM o),
parsed AS (SELECT doc_id, body, meta_subject,
                  js->>'$.category' AS category, js->>'$.subject' AS subject,
                  js->>'$.summary' AS summary, js->>'$.detailedSummary' AS detailedSummary,
                  js->>'$.priority' AS priority
           FROM j)"""

_NO_SUM = "(summary IS NULL OR summary = '')"
_BLANK = f"({sb.strip('body')} = '')"

ROUTED_SQL = PARSED_SQL + f""",
routed AS (SELECT doc_id, meta_subject,
  CASE WHEN {_NO_SUM} THEN 'UNKNOWN' WHEN {_BLANK} THEN 'NOTIF' END AS type,
  CASE WHEN {_NO_SUM} OR {_BLANK} THEN NULL ELSE summary END AS summary,
  CASE WHEN {_NO_SUM} OR {_BLANK} THEN NULL ELSE category END AS category,
  CASE WHEN {_NO_SUM} OR {_BLANK} THEN NULL ELSE detailedSummary END AS detailedSummary,
  CASE WHEN {_NO_SUM} OR {_BLANK} THEN NULL ELSE priority END AS priority,
  CASE WHEN {_NO_SUM} OR {_BLANK} THEN 0.0 END AS confidence,
  CASE WHEN {_NO_SUM} THEN true END AS flag_fallback_disabled,
  CASE WHEN NOT {_NO_SUM} AND {_BLANK} THEN true END AS flag_empty_body,
  CASE WHEN {_NO_SUM} THEN CAST(doc_id AS VARCHAR) END AS flag_email_id
FROM parsed)"""


def parsed_replies(spark, sf):
    r = fx.model_replies(spark, sf)
    return r.withColumn("parsed", inf.parse_reply("reply"))


def routed_replies(spark, sf):
    p = parsed_replies(spark, sf)
    return p.withColumn("result", inf.route_result(
        F.col("parsed"), F.col("body"), F.col("doc_id").cast("string")))


@register("t9_parse_reply", PARSED_SQL + """
SELECT doc_id, category, subject, summary, detailedSummary, priority FROM parsed""")
def t9_parse_reply(spark, sf):
    p = parsed_replies(spark, sf)
    return p.select("doc_id", *[F.col("parsed")[f].alias(f) for f in
                                ("category", "subject", "summary", "detailedSummary", "priority")])


@register("t10_fallback_route", ROUTED_SQL + """
SELECT doc_id, type, summary, category, confidence, flag_fallback_disabled, flag_empty_body,
       flag_email_id FROM routed""")
def t10_fallback_route(spark, sf):
    r = routed_replies(spark, sf)
    res = F.col("result")
    return r.select("doc_id", res["type"].alias("type"), res["summary"].alias("summary"),
                    res["category"].alias("category"), res["confidence"].alias("confidence"),
                    res["flag_fallback_disabled"].alias("flag_fallback_disabled"),
                    res["flag_empty_body"].alias("flag_empty_body"),
                    res["flag_email_id"].alias("flag_email_id"))


@register("t11_project", ROUTED_SQL + f"""
SELECT sha256('{RUN_ID}:' || CAST(doc_id AS VARCHAR)) AS session_id,
       CAST(doc_id AS VARCHAR) AS email_id, category, meta_subject AS subject, summary,
       detailedSummary, priority
FROM routed""")
def t11_project(spark, sf):
    r = routed_replies(spark, sf)
    return r.select(*inf.project_result(F.col("result"), F.col("doc_id").cast("string"),
                                        F.col("meta_subject"), RUN_ID))
