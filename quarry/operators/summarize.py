"""Native summary backend: grounded extractive summary (I2) and rule labels.

I2 (our definition, integer scores so results are exact):
  sentences = ``regexp_extract_all(text, '([^.!?]+[.!?]?)')``, stripped,
  non-empty, first occurrence only (K3 rule); tokens = lower-cased letter runs;
  tf = occurrences of the token in the document; sentence score =
  ``sum(tf) * 1000 div n_tokens`` (0 without tokens); rank by score desc,
  position asc; summary = top 2, detailed summary = top 5, re-joined with one
  space in position order.

Scale: the documents are hash-partitioned by id **once**; the distinct sentences
and their grouping by document reuse that partitioning, and tokens are counted
inside a document's row, so neither they nor sentences shuffle again.  A document is
bounded by the 500,000-character text cap, so no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text as tx


def sentences(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, sentence): stripped, non-empty, first occurrence per document."""
    s = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(K.SENTENCE_RE),
                                                           F.lit(1))).alias("pos", "sentence"))
    s = s.withColumn("sentence", tx.py_strip("sentence")).filter(F.col("sentence") != F.lit(""))
    return s.groupBy(key, "sentence").agg(F.min("pos").alias("pos"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with_runs(values: Column, part: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of the runs of equal ``part`` in a sorted array: structs of their index from 0 and length."""
    starts = F.array_compact(F.transform(values, lambda x, i: F.when(~part(x).eqNullSafe(part(F.get(values, i - 1))), i)))
    return _let(starts, lambda at: _let(F.transform(at, lambda s, j: F.struct(
        s.alias("at"), (F.coalesce(F.get(at, j + 1), F.size(values)) - s).alias("n"))), use))


def _ranked(sents: DataFrame, key: str) -> DataFrame:
    """(key, _ranked): the scored sentences of a document, best first, as one array.

    Tokens never become rows.  A document's tokens are sorted with the position
    of their sentence, so a run of equal tokens is as long as its tf.  Sorted
    again by position, with one entry of weight 0 for each sentence, the run of
    a sentence holds the tf of its tokens: each entry is ``pos << 32 | tf``.
    """
    docs = sents.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "sentence"))).alias("_all"))

    def pos_of(entry: Column) -> Column:
        return F.shiftright(entry, 32)

    def tokens(found: Column) -> Column:
        return F.sort_array(F.flatten(F.transform(found, lambda s: F.transform(
            F.regexp_extract_all(F.lower(s["sentence"]), F.lit(K.TOKEN_RE), F.lit(1)),
            lambda t: F.struct(t.alias("tok"), s["pos"].cast("bigint").alias("pos"))))))

    def weights(toks: Column) -> Column:
        return _with_runs(toks, lambda x: x["tok"], lambda runs: F.flatten(F.transform(runs, lambda r: F.transform(
            F.slice(toks, r["at"] + 1, r["n"]), lambda x: F.shiftleft(x["pos"], 32) + r["n"]))))

    def score(entries: Column, run: Column) -> Column:
        n_tokens = run["n"] - 1
        tf_sum = F.aggregate(F.slice(entries, run["at"] + 1, run["n"]), F.lit(0).cast("bigint"),
                             lambda acc, e: acc + e.bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.when(n_tokens > 0, F.call_function("div", tf_sum * 1000, n_tokens.cast("bigint"))) \
            .otherwise(F.lit(0).cast("bigint"))

    def ranked(found: Column) -> Column:
        # documents with the same key share positions: of such sentences the last one in order stands for all
        ones = F.filter(found, lambda s, i: ~s["pos"].eqNullSafe(F.get(found, i + 1)["pos"]))
        entries = F.sort_array(F.concat(_let(tokens(found), weights),
                                        F.transform(ones, lambda s: F.shiftleft(s["pos"].cast("bigint"), 32))))
        return _let(ones, lambda one: _let(entries, lambda w: _with_runs(w, pos_of, lambda runs: F.sort_array(F.transform(
            one, lambda s, i: F.struct((-score(w, F.get(runs, i))).alias("worst"), s["pos"].alias("pos"),
                                       s["sentence"].alias("sentence")))))))

    return docs.select(key, _let(F.col("_all"), ranked).alias("_ranked"))


def score_sentences(sents: DataFrame, key: str = "id") -> DataFrame:
    """Add the integer score and the rank of each sentence in its document."""
    rows = _ranked(sents, key).select(key, F.posexplode("_ranked").alias("_i", "_s"))
    return rows.select(key, F.col("_s.pos").alias("pos"), F.col("_s.sentence").alias("sentence"),
                       (-F.col("_s.worst")).alias("score"), (F.col("_i") + 1).alias("rank"))


def _joined(ranked: Column, top: int) -> Column:
    keep = F.transform(F.slice(ranked, 1, top), lambda s: F.struct(s["pos"].alias("pos"), s["sentence"].alias("sentence")))
    return F.array_join(F.transform(F.sort_array(keep), lambda s: s["sentence"]), " ")


def extractive_summary(docs: DataFrame, key: str = "id", text: str = "text",
                       short: int = 2, long: int = 5, num_partitions: int | None = None,
                       carry: bool = False) -> DataFrame:
    """I2 per document: ``key, summary, detailed_summary, n_sentences``
    (plus every input column when ``carry``).

    Documents without any sentence get null summaries (T10 routes them).
    The documents are shuffled once, by key; the sentence work and
    the final join back to the documents all reuse that partitioning.
    """
    base = docs if carry else docs.select(key, text)
    base = base.repartition(num_partitions, key) if num_partitions else base.repartition(key)
    ranked = _ranked(sentences(base.select(key, text), key, text), key)
    out = ranked.select(
        key, _joined(F.col("_ranked"), short).alias("summary"),
        _joined(F.col("_ranked"), long).alias("detailed_summary"),
        F.size("_ranked").cast("bigint").alias("n_sentences"))
    return (base if carry else base.select(key)).join(out, key, "left")


# ---------------------------------------------------------------------------
# I3 labels.  Our rule tables (precedence order, first match wins), matched on
# whole words of the lower-cased "subject + body".
# ---------------------------------------------------------------------------

CATEGORY_RULES = (
    ("Finance", ("invoice", "payment", "receipt", "billing", "refund")),
    ("HR", ("payroll", "hiring", "vacation", "benefits", "onboarding")),
    ("Newsletter", ("newsletter", "unsubscribe", "digest")),
    ("Work", ("meeting", "project", "deadline", "report", "review")),
    ("Personal", ("birthday", "family", "party", "dinner")),
)
DEFAULT_CATEGORY = "Other"

PRIORITY_RULES = (
    ("Urgent", ("urgent", "asap", "immediately", "today")),
    ("Important", ("important", "invoice", "payroll", "deadline")),
    ("Low", ("newsletter", "digest", "unsubscribe")),
)
DEFAULT_PRIORITY = "Normal"


def word_pattern(words) -> str:
    """Whole-word alternation, with letter-class boundaries that Java regex and
    RE2 read alike (``\\b`` differs between them for non-ASCII letters)."""
    return r"(?:^|[^\p{L}])(?:" + "|".join(words) + r")(?:[^\p{L}]|\z)"


def _label(words_col: Column, rules, default: str) -> Column:
    out = None
    for label, words in rules:
        cond = F.arrays_overlap(words_col, F.array(*[F.lit(w) for w in words]))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def label(df: DataFrame, subject: str = "subject", text: str = "text") -> DataFrame:
    """``category`` and ``priority`` from the rule tables.

    A rule word matches when it is a whole run of letters of the lower-cased
    subject + body: the text is split into letter runs once and each rule is
    an ``arrays_overlap`` (same result as the word-boundary patterns of
    :func:`word_pattern`, which the SQL form uses, at one regex pass per row).
    """
    lt = F.lower(F.concat_ws(" ", F.col(subject), F.col(text)))
    x = df.withColumn("_words", F.split(lt, r"[^\p{L}]+"))
    return x.withColumn("category", _label(F.col("_words"), CATEGORY_RULES, DEFAULT_CATEGORY)) \
        .withColumn("priority", _label(F.col("_words"), PRIORITY_RULES, DEFAULT_PRIORITY)) \
        .drop("_words")


def label_sql(subject: str, text: str) -> tuple[str, str]:
    """The same labels as DuckDB CASE expressions."""
    from quarry.plans.sqlbits import q
    lt = f"lower(concat_ws(' ', {subject}, {text}))"

    def case(rules, default):
        arms = " ".join(f"WHEN regexp_matches({lt}, {q(word_pattern(w))}) THEN {q(lab)}"
                        for lab, w in rules)
        return f"(CASE {arms} ELSE {q(default)} END)"
    return case(CATEGORY_RULES, DEFAULT_CATEGORY), case(PRIORITY_RULES, DEFAULT_PRIORITY)
