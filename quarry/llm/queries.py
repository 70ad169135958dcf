"""Registered queries of the pipeline operators: ``QUERIES[name] = (job, DuckDB SQL or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import (bloom_lm, bpe_fst, crf_quality, fill_in_middle, harmonic_packing, license_scan, line_dedup, mixing, multiprobe_lsh,
                        periodic_runs, resync_tokens, sigtree_join, substring_dedup)
from quarry.llm.vocabularies import BYTE_RANKS, PATTERN, PIECES, WORDS
from quarry.sources.tables import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


QUERIES["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: near-equal lines of four words or more, edit similarity 0.8."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=4, similarity=0.8)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, three-word shingles, Jaccard 0.9 or more."""
    return sigtree_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, p=90, q=100)


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, windows of 35 words."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), k=35)
    return out.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start).alias("n_removed"),
                      F.sha2("kept_text", 256).alias("kept_sha256"), "spans")


@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; learns from the rows whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return bloom_lm.score(docs, ~held_out).withColumn("held_out", ~F.col("train")).drop("train")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` with the sentence-piece vocabulary."""
    out = resync_tokens.count_tokens(table(spark, sf_dir, "documents"), PIECES)
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; the CRF learns from a bounded sample of ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = crf_quality.fit(docs, table(spark, sf_dir, "labels"))
    return crf_quality.label(docs, crf).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                               "base_failed", "kept", "content_share")


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` encoded, and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_fst.encode(docs, BYTE_RANKS, PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
c AS (SELECT *, 3.0::DOUBLE * source_size AS lim,
        sum(3.0::DOUBLE * source_size) OVER o AS lims, sum(w) OVER o AS ws,
        sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
      FROM r WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, lim < (total - coalesce(lims, 0)) / (all_w - coalesce(ws, 0)) * w AS above FROM c),
l AS (SELECT (max(total) - sum(CASE WHEN above THEN lim ELSE 0 END)) / sum(CASE WHEN above THEN 0 ELSE w END) AS rate FROM a),
t AS (SELECT source, source_size, w, least(lim, rate * w) AS target FROM a, l),
p AS (SELECT doc_id, size, source_size, target, w, round(target)::BIGINT AS fin,
        coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, fin - st)) + greatest(0, least(size, fin - st - source_size))
   + greatest(0, least(size, fin - st - 2 * source_size)))::BIGINT AS taken,
  CASE WHEN size > 0 AND fin > st THEN 0.0 + CASE WHEN st / target * w > 0 THEN 2 * (st / target * w) /
    (w0 + sqrt(w0 * w0 + 2 * sl * (st / target * w))) ELSE 0.0 END END AS first_position
FROM p JOIN (VALUES (1.0::DOUBLE, 1.5::DOUBLE, -1.0::DOUBLE), (2.0, 2.0, 0.0), (3.0, 1.5, 3.0)) AS f(fw, w0, sl) ON fw = w
"""


@query("op2_mix_sources", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; sources weigh 1, 2, 3, repeating, as integrals of fading schedules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.by_position(mixing.plan(docs, mixing.FADE, most=3.0)).select(
        "doc_id", "size", "source_size", "target", "taken", "first_position")


@query("op1_ann_multiprobe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``; queries: vec_id divisible by 20, against all rows."""
    return multiprobe_lsh.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = license_scan.scan(docs.select("doc_id", F.col("text"))).drop("text")
    return found.select("doc_id", "n_sentences", F.size("matches").cast("bigint").alias("n_matches"),
                        F.concat_ws(",", "licenses").alias("licenses"), "matches")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
c AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS prefix,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` cut into lines, seed 7."""
    out = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The query's input: where crc32(doc_id) ends in 0, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", (F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").rlike("[^ \\t-\\r]")).alias("planted"), g.alias("g"))
    words = F.when(F.col("planted"), F.expr(r"regexp_extract_all(text, '[^ \\t-\\r]+', 0)"))
    rows = rows.withColumn("w", words).withColumn("a", F.expr("cast(g % size(w) as int)")) \
        .withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, get(w, a + (i - a) % p))), ' ')")
    return rows.select("doc_id", F.when(F.col("planted"), planted).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, a tenth of them made periodic; runs of 12 words or more."""
    out = periodic_runs.runs_of(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return out.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("best.length * 1000 div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_harmonic_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` as tokens and an end token, in sequences of 4,096."""
    return harmonic_packing.pack(table(spark, sf_dir, "documents"), WORDS).drop("ids")
