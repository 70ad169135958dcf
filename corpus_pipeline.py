"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the shared
folder and read again as the next stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe_fst, crf_quality, line_dedup, mixing, sigtree_join
from quarry.llm.vocabularies import BYTE_RANKS, PATTERN
from quarry.session import shared_path
from quarry.sources.tables import table

WORD = "[^ \\t-\\r]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose content lines hold half of the words; others go."""
    crf = crf_quality.fit(docs, table(spark, sf_dir, "labels"))
    return crf_quality.label(docs, crf).where("kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines, or equal ones of under four words, stays; a document that loses all its words goes."""
    had_words = docs.withColumn("_had", F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    out = line_dedup.dedup_lines(had_words, min_words=4, similarity=0.8, exact_words=1)
    out = out.where(~F.col("_had") | F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 0.8 similar stays."""
    return sigtree_join.one_of_each_group(docs, words=5, p=80, q=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3 along the fading curriculum, in training order."""
    return mixing.mixed(docs, mixing.FADE, most=3.0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, and a digest of what they decode to."""
    out = bpe_fst.encode(docs.select("doc_id", "lang", "source", "text"), BYTE_RANKS, PATTERN, decoded=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_jaccard_join", near_duplicates),
          ("mix_sources", mix), ("byte_bpe", tokenize)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
