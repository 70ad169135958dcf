"""Cache queries: C1-C3."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text as tx
from quarry.operators import cache as ch
from quarry.operators.reqlog import EPOCH_NTZ
from quarry.plans import fixtures as fx
from quarry.plans import sqlbits as sb
from quarry.plans.registry import register

RETAIN = 100  # exercises eviction on 150 keys (the service default is 10,000)


def _j(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def _key_doc(user: str) -> str:
    return (f"'{{\"model\": ' || {_j(sb.q(K.DEFAULT_MODEL))} || ', \"ns\": ' || {_j(sb.q(K.CACHE_NAMESPACE))}"
            f" || ', \"system\": ' || {_j(sb.q(K.SYSTEM_PROMPT))} || ', \"user\": ' || {_j(user)}"
            f" || '}}'")


@register("c1_cache_key", "WITH " + fx.SUBJECTS_SQL + f""",
p AS (SELECT doc_id, {sb.build_prompt('subject', 'text')} AS prompt FROM subj)
SELECT doc_id, sha256({_key_doc('prompt')}) AS cache_key FROM p""")
def c1_cache_key(spark, sf):
    s = fx.subjects(spark, sf).select("doc_id", tx.build_prompt("subject", "text").alias("prompt"))
    return s.select("doc_id", ch.cache_key("prompt").alias("cache_key"))


@register("c1_cache_key_prefix", "WITH " + fx.SUBJECTS_SQL + f""",
p AS (SELECT doc_id, {sb.build_prompt('subject', 'text')} AS prompt FROM subj)
SELECT doc_id, sha256({_key_doc(f'left(prompt, {K.CACHE_KEY_CHARS})')}) AS cache_key FROM p""")
def c1_cache_key_prefix(spark, sf):
    """The service's own short key, as a caller's choice."""
    s = fx.subjects(spark, sf).select("doc_id", tx.build_prompt("subject", "text").alias("prompt"))
    return s.select("doc_id", ch.cache_key("prompt", key_chars=K.CACHE_KEY_CHARS).alias("cache_key"))


_NEWEST_SQL = "WITH " + fx.CACHE_SQL + """,
newest AS (SELECT key, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn
  FROM cache_entries) WHERE rn = 1)"""

_NOW_SQL = f"TIMESTAMP '{fx.CACHE_NOW}'"


@register("c2_cache_lookup", _NEWEST_SQL + f""",
{fx.LOOKUPS_SQL}
SELECT l.key,
  (epoch_us({_NOW_SQL}) - epoch_us(n.ts)) / 1e6 AS age_s,
  coalesce(n.ts IS NOT NULL AND (epoch_us({_NOW_SQL}) - epoch_us(n.ts)) / 1e6 <= {K.CACHE_TTL_SECONDS}
           AND json_valid(n.value) AND json_type(n.value) = 'OBJECT'
           AND len(json_keys(n.value)) > 0, false) AS hit,
  CASE WHEN coalesce(n.ts IS NOT NULL AND (epoch_us({_NOW_SQL}) - epoch_us(n.ts)) / 1e6 <= {K.CACHE_TTL_SECONDS}
           AND json_valid(n.value) AND json_type(n.value) = 'OBJECT'
           AND len(json_keys(n.value)) > 0, false) THEN n.value END AS cached
FROM lookups l LEFT JOIN newest n USING (key)""")
def c2_cache_lookup(spark, sf):
    cache = ch.put(fx.cache_entries(spark, sf))
    now = F.lit(fx.CACHE_NOW).cast("timestamp_ntz")
    return ch.lookup(fx.cache_lookups(spark, sf), cache, now).select("key", "age_s", "hit", "cached")


@register("c3_cache_retention", _NEWEST_SQL + f"""
SELECT key, epoch_us(ts) AS ts_us, value FROM newest ORDER BY ts DESC, key LIMIT {RETAIN}""")
def c3_cache_retention(spark, sf):
    cache = ch.retain(ch.put(fx.cache_entries(spark, sf)), RETAIN)
    return cache.select("key", F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ), F.col("ts"))
                        .alias("ts_us"), "value")
