"""Order-dependent helpers that stay distributed.

``global_rank``: 1-based position of every row in a total order without a
single-partition window.  Range buckets come from approximate quantiles of the
order column (a bounded list on the driver), per-bucket counts become offsets
(a table of at most ``n_buckets`` rows, broadcast with that proven bound), and
``row_number`` runs inside each bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BUCKET_ROWS = 500_000


def global_rank(df: DataFrame, order: str, tie: str | None = None, n_buckets: int | None = None,
                rel_error: float = 0.001, out: str = "rank") -> DataFrame:
    """Add ``out`` = position in ascending ``(order, tie)`` (ties must be broken
    by ``tie`` for a deterministic result).  The number of buckets follows the rows."""
    if n_buckets is None:
        n_buckets = min(4096, max(64, -(-df.count() // BUCKET_ROWS)))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = sorted(set(b for b in df.approxQuantile(order, probs, rel_error) if b is not None))
    # bucket = number of boundaries strictly below the value (rows equal to a
    # boundary fall in the lower bucket, so equal keys never straddle buckets)
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + F.when(F.col(order) > F.lit(b), 1).otherwise(0)
    x = df.withColumn("_bucket", bucket)
    counts = x.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).select("_bucket", "_off")
    w = Window.partitionBy("_bucket").orderBy(*([order] + ([tie] if tie else [])))
    ranked = x.withColumn("_local", F.row_number().over(w))
    return ranked.join(F.broadcast(offsets), "_bucket") \
        .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint")) \
        .drop("_bucket", "_off", "_local")


# ---------------------------------------------------------------------------
# Per-key sequences over time, without putting a key's history in one task.
#
# Events carry (key, ts, eid) with ts in microseconds and eid unique; the
# order is (ts, eid).  Time is cut into buckets of a fixed width; every
# window below is partitioned by (key, bucket) or runs on a per-(key, bucket)
# summary (one row per non-empty bucket), so a key holding a third of all
# rows is spread over its buckets.  Frames are either running frames or
# written in reverse order so that they grow (O(n)), never the quadratic
# "current row .. unbounded following" frame.
# ---------------------------------------------------------------------------

_UP = Window.unboundedPreceding


def add_bucket(ev: DataFrame, ts: str, width: int, out: str = "_b") -> DataFrame:
    return ev.withColumn(out, F.floor(F.col(ts) / F.lit(width)).cast("bigint"))


def per_key_rank(ev: DataFrame, key: str, ts: str, eid: str, bucket: str = "_b",
                 out: str = "grank") -> DataFrame:
    """1-based position of each event in its key's (ts, eid) order."""
    summ = ev.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(
        Window.partitionBy(key).orderBy(bucket).rowsBetween(_UP, -1)), F.lit(0))
    cum = summ.select(key, bucket, before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, bucket).orderBy(ts, eid))
    return ev.withColumn("_local", local).join(cum, [key, bucket]) \
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint")) \
        .drop("_before", "_local")


def asof_next(ev: DataFrame, key: str, ts: str, eid: str, delta: int, strict: bool,
              bucket: str = "_b", out_ts: str = "next_ts", out_id: str = "next_id") -> DataFrame:
    """For every event, the first event of the same key at ``ts + delta`` or
    later (``strict``: later than ``ts + delta``).

    ``bucket`` must be ``floor(ts / delta)``: the probe ``ts + delta`` then
    falls in bucket b+1.  Inside (key, b+1) a reversed running ``last`` finds
    the first event after the probe; if there is none the answer is the first
    event of the first non-empty bucket >= b+2, from the bucket summary.
    """
    ev_kind, probe_kind = (0, 1) if strict else (1, 0)
    probes = ev.select(F.col(key), (F.col(bucket) + 1).alias("_pb"),
                       (F.col(ts) + F.lit(delta)).alias("_t"), F.lit(probe_kind).alias("_kind"),
                       F.col(eid).alias("_src"), F.lit(None).cast("bigint").alias("_ets"),
                       F.lit(None).cast("bigint").alias("_eid"))
    evs = ev.select(F.col(key), F.col(bucket).alias("_pb"), F.col(ts).alias("_t"),
                    F.lit(ev_kind).alias("_kind"), F.lit(None).cast("bigint").alias("_src"),
                    F.col(ts).alias("_ets"), F.col(eid).alias("_eid"))
    u = probes.unionByName(evs)
    w = Window.partitionBy(key, "_pb").orderBy(F.desc("_t"), F.desc("_kind"),
                                               F.desc("_eid")).rowsBetween(_UP, 0)
    hit = F.last(F.when(F.col("_kind") == ev_kind, F.struct("_ets", "_eid")),
                 ignorenulls=True).over(w)
    found = u.withColumn("_hit", hit).filter(F.col("_kind") == probe_kind) \
        .select(F.col("_src").alias(eid), "_hit")
    summ = ev.groupBy(key, bucket).agg(F.min(F.struct(F.col(ts).alias("_ets"),
                                                      F.col(eid).alias("_eid"))).alias("_first"))
    later = F.min("_first").over(Window.partitionBy(key).orderBy(F.desc(bucket))
                                 .rangeBetween(_UP, -2))
    fallback = summ.select(key, bucket, later.alias("_later"))
    res = ev.join(found, eid, "left").join(fallback, [key, bucket], "left")
    nxt = F.coalesce(F.col("_hit"), F.col("_later"))
    return res.withColumn(out_ts, nxt["_ets"]).withColumn(out_id, nxt["_eid"]) \
        .drop("_hit", "_later")


def chain_members(edges: DataFrame, roots: DataFrame, node: str = "node", nxt: str = "nxt",
                  max_levels: int = 62) -> DataFrame:
    """All nodes reachable from ``roots`` by following ``nxt`` pointers.

    Pointer doubling: level k maps a node to its 2^k-th successor (a self-join
    of level k-1), built until a level is empty; then the root set is widened
    from the top level down (binary lifting), which enumerates every node on
    each root's path.  O(log L) joins of the edge table, each checkpointed to
    the shared checkpoint folder, no per-key grouping anywhere.
    """
    from quarry.session import cut_lineage
    lvl = cut_lineage(edges.filter(F.col(nxt).isNotNull()).select(
        F.col(node).alias("_n"), F.col(nxt).alias("_x")))
    levels = [lvl]
    for _ in range(max_levels):
        a, b = levels[-1].alias("a"), levels[-1].alias("b")
        up = a.join(b, F.col("a._x") == F.col("b._n")).select(
            F.col("a._n").alias("_n"), F.col("b._x").alias("_x"))
        up = cut_lineage(up)
        if up.isEmpty():
            break
        levels.append(up)
    else:
        raise RuntimeError(f"chains are longer than 2**{max_levels}")
    # widening: every step reads the previous member set twice (union and
    # join), so each is materialised; otherwise the plan would double per level
    members = roots.select(F.col(node).alias("_n"))
    for lv in reversed(levels):
        step = members.join(lv, "_n").select(F.col("_x").alias("_n"))
        members = cut_lineage(members.unionByName(step))
    return members.select(F.col("_n").alias(node))
