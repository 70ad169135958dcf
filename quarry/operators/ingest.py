"""Intake: normalisation (S2), validation (S7), content keys (K1), first-wins
dedup with accounting (K2), unique-key audit (K4), insert-if-absent (S4).

Record shape (after S1): ``id, text, raw, subject, user_id, metadata, seq``.
``seq`` is the arrival order; the first arrival per key wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import constants as K
from quarry.functions import text as tx
from quarry.sources.mime import extract_text

META_TYPE = T.MapType(T.StringType(), T.StringType())


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def normalise_records(df: DataFrame) -> DataFrame:
    """Text falls back to raw; subject and user_id folded into metadata
    (overwriting same-named keys, only when non-empty); has_raw flag."""
    for name, typ in (("id", "string"), ("text", "string"), ("raw", "string"),
                      ("subject", "string"), ("user_id", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(typ))
    if "metadata" not in df.columns:
        df = df.withColumn("metadata", F.lit(None).cast(META_TYPE))
    extra = F.map_from_entries(F.filter(
        F.array(F.struct(F.lit("subject").alias("k"), F.col("subject").alias("v")),
                F.struct(F.lit("user_id").alias("k"), F.col("user_id").alias("v"))),
        lambda e: _nonempty(e["v"])))
    base = F.coalesce(F.col("metadata"), F.create_map().cast(META_TYPE))
    base = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extra), k))
    has_raw = _nonempty(F.col("raw"))
    meta = F.map_concat(base, extra)
    meta = F.when(has_raw, F.map_concat(F.map_filter(meta, lambda k, v: k != F.lit("has_raw")),
                                        F.create_map(F.lit("has_raw"), F.lit("true"))))\
        .otherwise(meta)
    return df.select(
        *[c for c in df.columns if c not in ("text", "metadata")],
        F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("raw"), F.lit("")).alias("text"),
        meta.alias("metadata"),
        has_raw.alias("has_raw"),
    )


def rejection_reason(id_col="id", text_col="text", max_chars: int = K.MAX_TEXT_CHARS) -> Column:
    """One reason per bad row, null for a good row."""
    i, t = F.col(id_col), F.col(text_col)
    return (F.when(i.isNull() | (i == F.lit("")), F.lit("missing_id"))
            .when(t.isNull() | (tx.py_strip(t) == F.lit("")), F.lit("empty_text"))
            .when(F.length(t) > F.lit(max_chars), F.lit("text_too_long")))


def validate(df: DataFrame, max_chars: int = K.MAX_TEXT_CHARS) -> DataFrame:
    return df.withColumn("reason", rejection_reason(max_chars=max_chars))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNull()).drop("reason")


def quarantined(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNotNull())


def keyed_documents(records: DataFrame, max_chars: int = K.MAX_TEXT_CHARS) -> DataFrame:
    """K1 on normalised records: raw wins when non-empty, text is extracted
    (T1), whitespace-collapsed, and hashed unless a non-empty id is given.

    Output: ``id, text, metadata, seq, reason`` plus ``text_lines`` (extracted
    text before the collapse, for line-level jobs such as K3).  ``reason`` is
    S7's verdict, computed from the extracted text with cheap tests (a trim;
    the collapse only for texts longer than the cap) because filters on it are
    pushed below the projections and re-evaluate its expression there.
    """
    src = records.withColumn(
        "_raw_in", F.coalesce(F.nullif(F.col("raw"), F.lit("")), F.col("text"), F.lit("")))
    ex = extract_text(src, "_raw_in", "text_lines")
    tl = F.col("text_lines")
    too_long = (F.length(tl) > F.lit(max_chars)) & \
        (F.length(tx.collapse_ws(tl)) > F.lit(max_chars))
    ex = ex.withColumn("reason", F.when(tx.py_strip(tl) == F.lit(""), F.lit("empty_text"))
                       .when(too_long, F.lit("text_too_long"))) \
        .withColumn("_canon", tx.collapse_ws(tl))
    return ex.select(
        F.coalesce(F.nullif(F.col("id"), F.lit("")), F.md5(F.col("_canon"))).alias("id"),
        F.col("_canon").alias("text"),
        F.col("metadata"),
        F.col("seq"),
        F.col("text_lines"),
        F.col("reason"),
    )


def first_per_key(df: DataFrame, key: str = "id", order: str = "seq",
                  valid: str | None = None) -> DataFrame:
    """K2 first-wins: the row with the smallest ``order`` per ``key``.

    ``min_by`` is a partial aggregate: each map task keeps one row per key
    before the shuffle, so a key holding a third of all rows costs one row per
    task, not one task holding the group.

    ``valid`` names a rejection-reason column (null = accepted, as produced
    by :func:`keyed_documents`): accepted rows win over rejected ones, keys
    with no accepted row are dropped after the aggregate, and ``copies``
    counts accepted rows.  Filtering after the aggregate (instead of before)
    keeps the optimizer from copying the whole extraction expression into a
    pushed-down filter.
    """
    others = [c for c in df.columns if c not in (key, valid)]
    if others == [order]:
        # only the order travels: plain min/count keep the aggregate hash-based
        ok = F.col(valid).isNull() if valid else F.lit(True)
        agg = df.groupBy(key).agg(F.min(F.when(ok, F.col(order))).alias(order),
                                  F.count(F.when(ok, F.lit(1))).alias("copies"))
        return agg.filter(F.col("copies") > 0)
    if valid is None:
        agg = df.groupBy(key).agg(
            F.min_by(F.struct(*others), F.col(order)).alias("_first"),
            F.count(F.lit(1)).alias("copies"))
        return agg.select(key, "_first.*", "copies")
    ok = F.col(valid).isNull()
    agg = df.groupBy(key).agg(
        F.min_by(F.struct(*others), F.struct((~ok).alias("_rej"), F.col(order).alias("_o")))
        .alias("_first"),
        F.count(F.when(ok, F.lit(1))).alias("copies"))
    return agg.filter(F.col("copies") > 0).select(key, "_first.*", "copies")


def dedup_accounting(incoming: DataFrame, store_keys: DataFrame | None = None,
                     key: str = "id", valid: str | None = None) -> DataFrame:
    """K2 counts: received, inserted, duplicates = received - inserted (one row)."""
    n = F.count(F.lit(1)) if valid is None else F.count(F.when(F.col(valid).isNull(), F.lit(1)))
    per_key = incoming.groupBy(key).agg(n.alias("n")).filter(F.col("n") > 0)
    if store_keys is not None:
        per_key = per_key.join(store_keys.select(key).withColumn("_old", F.lit(True)),
                               key, "left")
    else:
        per_key = per_key.withColumn("_old", F.lit(None).cast("boolean"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("received"),
        F.count(F.when(F.col("_old").isNull(), F.lit(1))).cast("bigint").alias("inserted"),
    ).withColumn("duplicates", F.col("received") - F.col("inserted"))


def duplicate_keys(df: DataFrame, key: str = "id", valid: str | None = None) -> DataFrame:
    """K4: keys held by more than one (accepted) row."""
    n = F.count(F.lit(1)) if valid is None else F.count(F.when(F.col(valid).isNull(), F.lit(1)))
    return df.groupBy(key).agg(n.alias("n_rows")).filter(F.col("n_rows") > 1)


def insert_if_absent(incoming: DataFrame, store: DataFrame, key: str = "id",
                     valid: str | None = None) -> DataFrame:
    """First (accepted) arrival per key among the incoming rows, minus keys
    already stored.

    The anti join shuffles only on the key; AQE turns it into a broadcast join
    at run time when the stored key set turns out small.
    """
    firsts = first_per_key(incoming, key, valid=valid)
    return firsts.join(store.select(key), key, "left_anti")
