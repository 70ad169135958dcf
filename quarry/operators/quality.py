"""Quality jobs: real-summary predicate (Q1), weighted score (Q2), rework
routing (Q3), grounding (Q4), domain checks (Q5), key details (Q6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text as tx


def is_real_summary(col) -> Column:
    """Q1: not null, longer than 20 chars, no 'fallback' / 'excerpt' (any case)."""
    s = tx._c(col)
    low = F.lower(s)
    cond = s.isNotNull() & (F.length(s) > F.lit(K.REAL_SUMMARY_MIN_CHARS))
    for word in K.REAL_SUMMARY_BANNED:
        cond = cond & ~low.contains(word)
    return F.coalesce(cond, F.lit(False))


def quality_score(df: DataFrame, relevance: str | None = "confidence",
                  faithfulness: str | None = None, richness: str | None = None,
                  weights: dict = K.EVAL_WEIGHTS, threshold: float = K.EVAL_PASS) -> DataFrame:
    """Q2: ``overall = round(w_r*relevance + w_f*faithfulness + w_c*richness, 3)``,
    ``passed = overall >= threshold``.  Missing inputs take the reference's
    defaults (relevance 0.5, the other two 1.0)."""
    ar = F.coalesce(F.col(relevance), F.lit(K.EVAL_DEFAULT_CONFIDENCE)) if relevance \
        else F.lit(K.EVAL_DEFAULT_CONFIDENCE)
    fa = F.coalesce(F.col(faithfulness), F.lit(1.0)) if faithfulness else F.lit(1.0)
    cr = F.coalesce(F.col(richness), F.lit(1.0)) if richness else F.lit(1.0)
    x = df.withColumn("answer_relevance", ar.cast("double")) \
        .withColumn("faithfulness", fa.cast("double")) \
        .withColumn("context_richness", cr.cast("double"))
    overall = F.round(F.col("answer_relevance") * weights["answer_relevance"]
                      + F.col("faithfulness") * weights["faithfulness"]
                      + F.col("context_richness") * weights["context_richness"], 3)
    return x.withColumn("overall", overall) \
        .withColumn("passed", F.col("overall") >= F.lit(threshold))


def rework(scored: DataFrame, corrections: str = "corrections",
           max_corrections: int = K.EVAL_MAX_CORRECTIONS) -> DataFrame:
    """Q3: rows failing the gate that still have correction budget, counter +1."""
    c = F.coalesce(F.col(corrections), F.lit(0)) if corrections in scored.columns else F.lit(0)
    return scored.withColumn("_c", c).filter(~F.col("passed") & (F.col("_c") < max_corrections)) \
        .withColumn(corrections, (F.col("_c") + 1).cast("int")).drop("_c")


def grounding(quotes: DataFrame, bodies: DataFrame, key: str = "id",
              quote: str = "quote", body: str = "text") -> DataFrame:
    """Q4: each quote of a document must be an exact substring of its body.

    An equi-join on the document key, then ``instr``; per document:
    ``n_quotes, n_grounded, grounded_share``.
    """
    j = quotes.select(key, quote).join(bodies.select(key, body), key)
    g = j.withColumn("_ok", (F.instr(F.col(body), F.col(quote)) > 0).cast("int"))
    return g.groupBy(key).agg(F.count(F.lit(1)).alias("n_quotes"),
                              F.sum("_ok").cast("bigint").alias("n_grounded")) \
        .withColumn("grounded_share", F.round(F.col("n_grounded") / F.col("n_quotes"), 6))


def _tokens(col) -> Column:
    return F.split(tx.py_strip(col), K.WS_RUN)


def passage_matches(passages: DataFrame, docs: DataFrame, pid: str = "item_id",
                    did: str = "doc_id", ptext: str = "text", dtext: str = "text",
                    block_rows: int = 1000) -> DataFrame:
    """Q4 (passages): every (passage, document) where the passage occurs verbatim.

    Exact without comparing all pairs: if passage ``w1 .. wn`` (whitespace
    tokens) occurs in a document, each interior token ``w2 .. w(n-1)`` is a
    whole token of that document.  Each passage is keyed by its *rarest*
    interior token (document frequency counted only for passage tokens: the
    documents' distinct tokens are semi-joined with the small passage
    vocabulary and counted with a partial aggregate), candidates are the
    documents holding that token, and each candidate is verified with
    ``instr``.  Passages of one or two tokens have no interior token: they are
    compared with every document in blocks of about ``block_rows`` passages, an
    equi-join on the block's number (one block: one small row beside the texts).
    """
    p = passages.select(F.col(pid).alias("_pid"), F.col(ptext).alias("_ptext")) \
        .withColumn("_pt", _tokens(F.col("_ptext")))
    p = p.withColumn("_interior", F.when(F.size("_pt") >= 3,
                                         F.slice("_pt", F.lit(2), F.size("_pt") - 2))).drop("_pt")
    d = docs.select(F.col(did).alias("_did"), F.col(dtext).alias("_dtext"))
    ptoks = p.filter(F.col("_interior").isNotNull()).select(
        "_pid", F.explode(F.array_distinct("_interior")).alias("_tok"))
    vocab = ptoks.select("_tok").distinct()
    doc_toks = d.select("_did", F.explode(F.array_distinct(_tokens(F.col("_dtext")))).alias("_tok"))
    dfreq = doc_toks.join(vocab, "_tok", "left_semi").groupBy("_tok") \
        .agg(F.count(F.lit(1)).alias("_df"))
    best = ptoks.join(dfreq, "_tok", "left").fillna(0, ["_df"]).groupBy("_pid").agg(
        F.min_by("_tok", F.struct("_df", "_tok")).alias("_tok"))
    cand = doc_toks.join(best, "_tok").select("_pid", "_did").distinct()
    verified = cand.join(p.select("_pid", "_ptext"), "_pid").join(d, "_did") \
        .filter(F.instr(F.col("_dtext"), F.col("_ptext")) > 0).select("_pid", "_did")
    short = p.filter(F.col("_interior").isNull() & (F.col("_ptext") != F.lit("")))
    n_short = short.count()
    if n_short:
        n_blocks = -(-n_short // block_rows)
        blocks = short.groupBy(F.pmod(F.xxhash64("_pid", "_ptext"), F.lit(n_blocks)).alias("_blk")).agg(
            F.collect_list(F.struct("_pid", "_ptext")).alias("_ps"))
        asked = d.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
        hits = asked.join(blocks, "_blk").select("_did", F.explode(F.filter(
            "_ps", lambda p: F.instr(F.col("_dtext"), p["_ptext"]) > 0)).alias("_p"))
        verified = verified.unionByName(hits.select(F.col("_p._pid").alias("_pid"), "_did"))
    return verified.select(F.col("_pid").alias(pid), F.col("_did").alias(did))


def domain_violations(df: DataFrame, checks: dict[str, tuple]) -> DataFrame:
    """Q5: per checked field, rows checked (non-null) and rows outside the domain.

    ``checks``: field -> tuple of allowed values, or ("range", lo, hi).  One
    aggregate counts all fields, so the input is read and computed once.
    """
    counts = []
    for field, allowed in checks.items():
        c = F.col(field)
        if allowed and allowed[0] == "range":
            bad = (c < allowed[1]) | (c > allowed[2])
        else:
            bad = ~c.isin(*allowed)
        counts.append(F.struct(F.lit(field).alias("field"), F.count(c).alias("n_checked"),
                               F.count(F.when(c.isNotNull() & bad, F.lit(1))).alias("n_violations")))
    return df.agg(F.array(*counts).alias("_counts")).select(F.inline("_counts"))


def key_details_long(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Q6 long form: (key, kind, value), distinct values per document and kind."""
    kinds = tx.key_details(text)
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("values")) for k, v in kinds.items()])
    x = df.select(key, F.explode(arr).alias("_k"))
    return x.select(key, F.col("_k.kind").alias("kind"),
                    F.explode(F.col("_k.values")).alias("value"))
