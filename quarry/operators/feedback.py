"""Feedback and learning: counters (F1), consolidation trigger (F2),
consolidation into rules (F3), session enrichment (F4), rules lookup (F5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import constants as K
from quarry.operators.ordering import global_rank

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("correction", T.StringType()),
    T.StructField("missing_items", T.ArrayType(T.StringType())),
    T.StructField("tone_off", T.BooleanType()),
    T.StructField("wrong_priority", T.BooleanType()),
    T.StructField("wrong_type", T.BooleanType()),
    T.StructField("note", T.StringType()),
    T.StructField("seq", T.LongType()),
])

FLAGS = ("tone_off", "wrong_priority", "wrong_type")

# Our rule phrases (the reference leaves the consolidation text to a model).
FLAG_PHRASES = {
    "tone_off": "Keep the tone neutral and professional",
    "wrong_priority": "Re-check the priority against explicit time words",
    "wrong_type": "Re-check the category against the message content",
}
MISSING_PHRASE = "Always include the {item} when the email states it"


def enrich(feedback: DataFrame, sessions: DataFrame) -> DataFrame:
    """feedback left-joined to its session (email_type, original_summary);
    ``is_orphan`` marks feedback whose session is unknown."""
    s = sessions.select("session_id", "email_type", "original_summary",
                        F.lit(True).alias("_known"))
    return feedback.join(s, "session_id", "left") \
        .withColumn("is_orphan", F.col("_known").isNull()).drop("_known")


def orphans(feedback: DataFrame, sessions: DataFrame) -> DataFrame:
    return feedback.join(sessions.select("session_id"), "session_id", "left_anti")


def counters(enriched: DataFrame, by: str = "email_type") -> DataFrame:
    """total, mean rating and flag counts per ``by`` group."""
    aggs = [F.count(F.lit(1)).alias("n_feedback"),
            F.round(F.avg("rating"), 4).alias("avg_rating")]
    aggs += [F.count(F.when(F.col(f), F.lit(1))).alias(f"n_{f}") for f in FLAGS]
    return enriched.groupBy(by).agg(*aggs)


def should_consolidate(total: Column, done: Column, every_n: int = K.CONSOLIDATE_EVERY_N) -> Column:
    """F2 (batch form): ``total >= (done + 1) * n``."""
    return total >= (done + F.lit(1)) * F.lit(every_n)


def consolidation_points(feedback: DataFrame, order: str = "seq",
                         every_n: int = K.CONSOLIDATE_EVERY_N) -> DataFrame:
    """F2 per row: arrival rank, the epoch it belongs to, and whether the
    consolidation fires on it (every n-th row; ``done`` advances by one per
    consolidation)."""
    r = global_rank(feedback, order, out="rank")
    return r.withColumn("epoch", F.floor((F.col("rank") - 1) / every_n).cast("bigint")) \
        .withColumn("fires", (F.col("rank") % every_n) == 0)


def issue_counts(feedback: DataFrame) -> DataFrame:
    """(issue, n): one row per flag and per missing item."""
    flags = feedback.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("issue"), F.col(f).cast("int").alias("hit")) for f in FLAGS]))
        .alias("x")).select("x.issue", "x.hit")
    items = feedback.select(F.explode("missing_items").alias("item")) \
        .filter(F.col("item").isNotNull() & (F.col("item") != F.lit(""))) \
        .select(F.concat(F.lit("missing:"), F.col("item")).alias("issue"), F.lit(1).alias("hit"))
    return flags.unionByName(items).groupBy("issue").agg(F.sum("hit").cast("bigint").alias("n"))


def _phrase(issue: Column) -> Column:
    out = F.concat(F.lit(MISSING_PHRASE.split("{item}")[0]),
                   F.regexp_replace(issue, "^missing:", ""),
                   F.lit(MISSING_PHRASE.split("{item}")[1]))
    for f, text in FLAG_PHRASES.items():
        out = F.when(issue == F.lit(f), F.lit(text)).otherwise(out)
    return out


def consolidate(feedback: DataFrame, threshold: int = 5, max_rules: int | None = None) -> DataFrame:
    """one-row ``instructions`` table: all issues reported at least ``threshold``
    times, most reported first (ties by name); ``max_rules`` is a caller's choice."""
    counts = issue_counts(feedback).filter(F.col("n") >= threshold)
    top = counts if max_rules is None else counts.orderBy(F.desc("n"), F.asc("issue")).limit(max_rules)
    line = F.concat(F.lit("- "), _phrase(F.col("issue")), F.lit(" ("),
                    F.col("n").cast("string"), F.lit(" reports)"))
    rows = top.select(F.struct((-F.col("n")).alias("k"), F.col("issue"), line.alias("line"))
                      .alias("r"))
    agg = rows.agg(F.array_sort(F.collect_list("r")).alias("rs"))
    instr = F.array_join(F.transform("rs", lambda r: r["line"]), "\n")
    return agg.select(F.when(F.size("rs") > 0, F.concat(
        F.lit("Learned rules from user feedback:\n"), instr)).otherwise(F.lit(""))
        .alias("instructions"))


def current_rules(rules: DataFrame | None) -> Column:
    """the current instructions as a scalar ("" when there are none)."""
    if rules is None:
        return F.lit("")
    return F.coalesce(rules.agg(F.max("instructions")).scalar(), F.lit(""))

