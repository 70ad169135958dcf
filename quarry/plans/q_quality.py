"""Quality queries: Q1-Q6."""

from __future__ import annotations
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.operators import quality as ql
from quarry.operators import summarize as sm
from quarry.plans import fixtures as fx
from quarry.plans import sqlbits as sb
from quarry.plans.q_reply import PARSED_SQL, ROUTED_SQL, parsed_replies, routed_replies
from quarry.plans.q_summary import i2_sql
from quarry.plans.registry import register
from quarry.sources.tables import table


def _real_sql(s: str) -> str:
    return (f"coalesce({s} IS NOT NULL AND length({s}) > {K.REAL_SUMMARY_MIN_CHARS} "
            f"AND NOT contains(lower({s}), 'fallback') AND NOT contains(lower({s}), 'excerpt'), false)")


# -------------------------------------------------------------------- Q1

@register("q1_real_summary", ROUTED_SQL + f"""
SELECT doc_id, summary, {_real_sql('summary')} AS has_real_summary FROM routed""")
def q1_real_summary(spark, sf):
    r = routed_replies(spark, sf)
    s = F.col("result")["summary"]
    return r.select("doc_id", s.alias("summary"), ql.is_real_summary(s).alias("has_real_summary"))


# ---------------------------------------------------------------- Q2, Q3
# relevance = a confidence derived from labels: 0.25 + 0.5*quality - 0.1*toxic.

_CONF_SQL = "(0.25 + 0.5 * quality - 0.1 * toxic)"
_Q2_SQL = f"""WITH c AS (SELECT l.doc_id, CAST({_CONF_SQL} AS DOUBLE) AS answer_relevance
           FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT doc_id, answer_relevance, 1.0::DOUBLE AS faithfulness, 1.0::DOUBLE AS context_richness,
             round(answer_relevance * 0.4 + 1.0 * 0.4 + 1.0 * 0.2, 3) AS overall
      FROM c)"""


def _scored(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id")
    conf = (F.lit(0.25) + F.lit(0.5) * F.col("quality") - F.lit(0.1) * F.col("toxic"))
    x = lab.join(docs, "doc_id").select("doc_id", conf.cast("double").alias("confidence"))
    return ql.quality_score(x, "confidence")


@register("q2_quality_score", _Q2_SQL + """
SELECT doc_id, answer_relevance, faithfulness, context_richness, overall, overall >= 0.7 AS passed
FROM s""")
def q2_quality_score(spark, sf):
    return _scored(spark, sf).select("doc_id", "answer_relevance", "faithfulness",
                                     "context_richness", "overall", "passed")


@register("q3_rework", _Q2_SQL + """
SELECT doc_id, overall, 1 AS corrections FROM s WHERE overall < 0.7""")
def q3_rework(spark, sf):
    return ql.rework(_scored(spark, sf)).select("doc_id", "overall", "corrections")


# -------------------------------------------------------------------- Q4

@register("q4_grounding", "WITH " + i2_sql("documents", "doc_id", "text") + """,
quotes AS (SELECT k AS doc_id, sent FROM ranked WHERE rk <= 5)
SELECT q.doc_id, count(*) AS n_quotes,
       CAST(sum(CASE WHEN strpos(d.text, q.sent) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_grounded,
       round(sum(CASE WHEN strpos(d.text, q.sent) > 0 THEN 1 ELSE 0 END) / count(*), 6) AS grounded_share
FROM quotes q JOIN documents d USING (doc_id) GROUP BY q.doc_id""")
def q4_grounding(spark, sf):
    d = table(spark, sf, "documents")
    ranked = sm.score_sentences(sm.sentences(d.select("doc_id", "text").repartition("doc_id"),
                                             "doc_id", "text"), "doc_id")
    quotes = ranked.filter(F.col("rank") <= 5).select("doc_id", F.col("sentence").alias("quote"))
    return ql.grounding(quotes, d, "doc_id", "quote", "text")


@register("q4_passages", """
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0
WHERE b.text <> ''""")
def q4_passages(spark, sf):
    b = table(spark, sf, "benchmark")
    d = table(spark, sf, "documents")
    return ql.passage_matches(b, d, "item_id", "doc_id", "text", "text")


# -------------------------------------------------------------------- Q5

_CATS = ", ".join(sb.q(c) for c in K.CATEGORIES)
_PRIS = ", ".join(sb.q(c) for c in K.PRIORITIES)


@register("q5_domain_check", PARSED_SQL + f""",
{fx.FEEDBACK_SQL}
SELECT 'category' AS field, count(category) AS n_checked,
       count(*) FILTER (WHERE category IS NOT NULL AND category NOT IN ({_CATS})) AS n_violations
FROM parsed
UNION ALL
SELECT 'priority', count(priority),
       count(*) FILTER (WHERE priority IS NOT NULL AND priority NOT IN ({_PRIS})) FROM parsed
UNION ALL
SELECT 'rating', count(rating),
       count(*) FILTER (WHERE rating IS NOT NULL AND (rating < 1 OR rating > 5)) FROM feedback""")
def q5_domain_check(spark, sf):
    p = parsed_replies(spark, sf).select(F.col("parsed.category").alias("category"),
                                         F.col("parsed.priority").alias("priority"))
    fb = fx.feedback(spark, sf)
    return ql.domain_violations(p, {"category": K.CATEGORIES, "priority": K.PRIORITIES}) \
        .unionByName(ql.domain_violations(fb, {"rating": ("range", K.RATING_MIN, K.RATING_MAX)}))


# -------------------------------------------------------------------- Q6

# RE2 has no look-around: separators other than "-" are doubled, so that neighbouring references have one each
_Q6_PARTS = [f"SELECT doc_id, {sb.q(kind)} AS kind, unnest(regexp_extract_all("
             + (r"regexp_replace(text, '([^\p{L}\p{N}_-])', '\1\1', 'g')" if kind == "reference" else "text")
             + f", {sb.q(rx)}, 1)) AS value FROM kd" for kind, rx in K.KEY_DETAIL_PATTERNS]


@register("q6_key_details", "WITH " + fx.KEY_DETAIL_SQL + """
SELECT DISTINCT doc_id, kind, value FROM (
""" + "\nUNION ALL\n".join(_Q6_PARTS) + ")")
def q6_key_details(spark, sf):
    return ql.key_details_long(fx.key_detail_docs(spark, sf), "doc_id", "text")



