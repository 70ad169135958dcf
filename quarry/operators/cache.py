"""Response cache as a keyed table: key (C1), TTL lookup (C2), put + retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import constants as K
from quarry.functions import text as tx
from quarry.operators.store import latest_per_key


def cache_key(prompt_col, model: str = K.DEFAULT_MODEL, namespace: str = K.CACHE_NAMESPACE,
              system: str = K.SYSTEM_PROMPT, key_chars: int | None = None) -> Column:
    """sha256 hex of the sorted-key JSON of (model, ns, system, user), in the
    layout of ``json.dumps(..., ensure_ascii=False, sort_keys=True)``; user is the
    whole untrimmed prompt, or its first ``key_chars`` characters if the caller says so."""
    p = tx._c(prompt_col)
    user = F.left(p, F.lit(key_chars)) if key_chars else p
    doc = F.concat(F.lit('{"model": '), tx.json_string(F.lit(model)),
                   F.lit(', "ns": '), tx.json_string(F.lit(namespace)),
                   F.lit(', "system": '), tx.json_string(F.lit(system)),
                   F.lit(', "user": '), tx.json_string(user), F.lit("}"))
    return F.sha2(doc, 256)


def put(entries: DataFrame, key: str = "key", ts: str = "ts", seq: str | None = "seq") -> DataFrame:
    """C3 put: newest value per key (ties by ``seq``), as a partial aggregate."""
    order = [ts, seq] if seq and seq in entries.columns else [ts]
    return latest_per_key(entries, key, order)


def retain(cache: DataFrame, max_entries: int = K.CACHE_MAX_ENTRIES, ts: str = "ts",
           key: str = "key") -> DataFrame:
    """C3 retention: keep the ``max_entries`` newest entries (<= 0: unbounded).

    A distributed rank (range buckets and their offsets) and a filter, whatever the
    cap: no task gathers the entries that stay."""
    if max_entries <= 0:
        return cache
    from quarry.operators.ordering import global_rank
    from quarry.operators.reqlog import epoch_micros
    neg = cache.withColumn("_neg_ts", -epoch_micros(F.col(ts), cache.schema[ts].dataType))
    return global_rank(neg, "_neg_ts", tie=key, out="_rank") \
        .filter(F.col("_rank") <= max_entries).drop("_neg_ts", "_rank")


def _non_empty_object(value: Column) -> Column:
    m = F.from_json(value, T.MapType(T.StringType(), T.StringType()))
    return F.coalesce(F.size(m) > 0, F.lit(False))


def lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = K.CACHE_TTL_SECONDS,
           key: str = "key", ts: str = "ts", value: str = "value") -> DataFrame:
    """Left join on key; hit iff an entry exists, it has not expired
    (``age > ttl`` expires, ``ttl <= 0`` never does) and its value is a
    non-empty JSON object.  Adds ``hit``, ``age_s`` and ``cached`` (value on hit)."""
    c = cache.select(F.col(key), F.col(ts).alias("_cts"), F.col(value).alias("_cval"))
    j = requests.join(c, key, "left")
    # ``now`` and ``ts`` of the same type (both NTZ or both with time zone)
    age = F.timestamp_diff("MICROSECOND", F.col("_cts"), now) / F.lit(1e6)
    fresh = F.lit(True) if ttl_seconds <= 0 else (age <= F.lit(float(ttl_seconds)))
    hit = F.col("_cts").isNotNull() & fresh & _non_empty_object(F.col("_cval"))
    return j.withColumn("age_s", age).withColumn("hit", F.coalesce(hit, F.lit(False))) \
        .withColumn("cached", F.when(F.col("hit"), F.col("_cval"))).drop("_cts", "_cval")
