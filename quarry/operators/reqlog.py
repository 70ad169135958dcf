"""Request-log jobs (batch): per-client rate-limit windows (R1), failure-run
state per service (R2), latency summaries (R3).

R1 and R2 are sequential definitions (each decision depends on the previous
ones).  They are rebuilt exactly from set operations: bucketed as-of lookups
give every event its successor candidate, pointer doubling marks the chain
that the sequential replay would follow, and bucket-local windows plus
bucket summaries give ranks.  No key's history is collected into one task,
so a client holding a third of all rows is spread over its time buckets.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import constants as K
from quarry.operators.ordering import (add_bucket, asof_next, chain_members, per_key_rank)
from quarry.session import cut_lineage

_UP = Window.unboundedPreceding
EPOCH_NTZ = _dt.datetime(1970, 1, 1)  # a naive datetime literal is TIMESTAMP_NTZ


def epoch_micros(col: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 00:00:00 UTC.  A ``TIMESTAMP_NTZ`` wall
    clock is read as UTC whatever the session time zone is."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ), col)
    return F.unix_micros(col.cast("timestamp"))


def request_log(events: DataFrame, client: str = "user_id", ts: str = "ts",
                eid: str = "event_id", failure: Column | None = None,
                latency: str | None = "value") -> DataFrame:
    """Normalise an event table into ``client, ts_us, event_id, failed, latency_ms``."""
    cols = [F.col(client).alias("client"),
            epoch_micros(F.col(ts), events.schema[ts].dataType).alias("ts_us"),
            F.col(eid).alias("event_id")]
    cols.append((failure if failure is not None else F.lit(False)).alias("failed"))
    if latency:
        cols.append(F.col(latency).cast("double").alias("latency_ms"))
    return events.select(*cols)


def _start_for(events: DataFrame, starts: DataFrame, key: str, bucket: str,
               ts: str, eid: str, out: str) -> DataFrame:
    """Attach to each event the latest marked event at or before it, knowing that
    marked events are at most one per bucket and none is more than one bucket
    back.  ``starts`` carries (key, bucket, struct) in column ``_s``."""
    same = starts.withColumnRenamed("_s", "_same")
    prev = starts.withColumn(bucket, F.col(bucket) + 1).withColumnRenamed("_s", "_prev")
    x = events.join(same, [key, bucket], "left").join(prev, [key, bucket], "left")
    s = F.col("_same")
    use_same = s.isNotNull() & ((s["ts"] < F.col(ts)) | ((s["ts"] == F.col(ts)) & (s["id"] <= F.col(eid))))
    return x.withColumn(out, F.when(use_same, s).otherwise(F.col("_prev"))).drop("_same", "_prev")


def rate_limit(log: DataFrame, window_seconds: int = K.RATE_WINDOW_SECONDS,
               limit: int = K.RATE_LIMIT) -> DataFrame:
    """R1 per request: ``client, event_id, ts_us, window_start_us, n_in_window, allowed``.

    A window opens at a client's first request and lasts ``window_seconds``;
    the next request at or after its end opens the next one; requests beyond
    ``limit`` in a window are rejected but still counted.
    """
    w = int(window_seconds * 1_000_000)
    # materialised once: the as-of, rank and summary branches all read it
    ev = cut_lineage(add_bucket(log.select("client", "ts_us", "event_id"), "ts_us", w))
    nx = asof_next(ev, "client", "ts_us", "event_id", w, strict=False)
    roots = ev.groupBy("client").agg(F.min(F.struct("ts_us", "event_id")).alias("_r")) \
        .select(F.col("_r.event_id").alias("node"))
    starts = chain_members(nx.select(F.col("event_id").alias("node"), F.col("next_id").alias("nxt")),
                           roots)
    ranked = per_key_rank(ev, "client", "ts_us", "event_id")
    st = ranked.join(starts.withColumnRenamed("node", "event_id"), "event_id") \
        .select("client", "_b", F.struct(F.col("ts_us").alias("ts"), F.col("event_id").alias("id"),
                                         F.col("grank").alias("grank")).alias("_s"))
    x = _start_for(ranked, st, "client", "_b", "ts_us", "event_id", "_start")
    n_in = (F.col("grank") - F.col("_start.grank") + 1).cast("bigint")
    return x.select("client", "event_id", "ts_us", F.col("_start.ts").alias("window_start_us"),
                    n_in.alias("n_in_window"), (n_in <= F.lit(limit)).alias("allowed"))


def rate_limit_windows(decisions: DataFrame) -> DataFrame:
    """R1 per window: requests, allowed, rejected."""
    return decisions.groupBy("client", "window_start_us").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count(F.when(F.col("allowed"), F.lit(1))).alias("n_allowed"),
        F.count(F.when(~F.col("allowed"), F.lit(1))).alias("n_rejected"))


def breaker(log: DataFrame, threshold: int = K.BREAKER_THRESHOLD,
            timeout_seconds: float = K.BREAKER_TIMEOUT_SECONDS) -> DataFrame:
    """R2 per call: ``client, event_id, ts_us, failed, outcome`` with outcome in
    ``accepted | opened | rejected``.

    Replay of the breaker: ``threshold`` consecutive failures open it; while
    open (``now - last_failure <= timeout``) calls are rejected and change
    nothing; the first call after the timeout is tried (half-open): a failure
    re-opens at once, a success closes and resets the count.
    """
    t = int(timeout_seconds * 1_000_000)
    ev = cut_lineage(add_bucket(log.select("client", "ts_us", "event_id", "failed"), "ts_us", t))
    r = per_key_rank(ev, "client", "ts_us", "event_id")
    # last success at or before each call (rank), bucket-local then carried
    succ_rank = F.when(~F.col("failed"), F.col("grank"))
    within = F.max(succ_rank).over(Window.partitionBy("client", "_b")
                                   .orderBy("ts_us", "event_id").rowsBetween(_UP, 0))
    carry = r.groupBy("client", "_b").agg(F.max(succ_rank).alias("_ls")).select(
        "client", "_b", F.max("_ls").over(Window.partitionBy("client").orderBy("_b")
                                          .rowsBetween(_UP, -1)).alias("_carry"))
    r = r.withColumn("_lsw", within).join(carry, ["client", "_b"], "left")
    last_succ = F.coalesce(F.col("_lsw"), F.col("_carry"), F.lit(0))
    r = r.withColumn("_run_end", F.col("failed") & ((F.col("grank") - last_succ) >= threshold)) \
        .drop("_lsw", "_carry")
    # first run-end strictly after each call: bucket-local (reverse running
    # frame excluding the row) else from the later buckets' summary
    c_struct = F.when(F.col("_run_end"), F.struct(F.col("ts_us").alias("ts"),
                                                  F.col("event_id").alias("id")))
    local_next = F.last(c_struct, ignorenulls=True).over(
        Window.partitionBy("client", "_b").orderBy(F.desc("ts_us"), F.desc("event_id"))
        .rowsBetween(_UP, -1))
    csum = r.groupBy("client", "_b").agg(F.min(c_struct).alias("_firstc")).select(
        "client", "_b", F.min("_firstc").over(Window.partitionBy("client").orderBy(F.desc("_b"))
                                              .rangeBetween(_UP, -1)).alias("_laterc"))
    r = r.withColumn("_nc_local", local_next).join(csum, ["client", "_b"], "left") \
        .withColumn("_next_c", F.coalesce(F.col("_nc_local"), F.col("_laterc"))["id"]) \
        .drop("_nc_local", "_laterc")
    # the call tried after a timeout that started at each call
    nx = asof_next(r, "client", "ts_us", "event_id", t, strict=True)
    k = nx.select(F.col("event_id").alias("_k"), F.col("failed").alias("_k_failed"),
                  F.col("_next_c").alias("_k_next_c"))
    edges = nx.filter(F.col("failed")).join(k, F.col("next_id") == F.col("_k"), "left").select(
        F.col("event_id").alias("node"),
        F.when(F.col("_k_failed"), F.col("_k")).otherwise(F.col("_k_next_c")).alias("nxt"))
    roots = r.filter(F.col("_run_end")).groupBy("client").agg(
        F.min(F.struct("ts_us", "event_id")).alias("_r")).select(F.col("_r.event_id").alias("node"))
    opens = chain_members(edges, roots)
    flagged = r.join(opens.withColumnRenamed("node", "event_id").withColumn("_open", F.lit(True)),
                     "event_id", "left")
    st = flagged.filter(F.col("_open")).select(
        "client", "_b", F.struct(F.col("ts_us").alias("ts"), F.col("event_id").alias("id")).alias("_s"))
    x = _start_for(flagged, st, "client", "_b", "ts_us", "event_id", "_o")
    is_open = F.coalesce(F.col("_open"), F.lit(False))
    rejected = ~is_open & F.col("_o").isNotNull() & (F.col("ts_us") <= F.col("_o.ts") + F.lit(t))
    outcome = F.when(is_open, F.lit("opened")).when(rejected, F.lit("rejected")) \
        .otherwise(F.lit("accepted"))
    return x.select("client", "event_id", "ts_us", "failed", outcome.alias("outcome"))


def breaker_summary(calls: DataFrame) -> DataFrame:
    """R2 per client: calls, failures, opens, rejected calls."""
    return calls.groupBy("client").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count(F.when(F.col("failed"), F.lit(1))).alias("n_failures"),
        F.count(F.when(F.col("outcome") == "opened", F.lit(1))).alias("n_opens"),
        F.count(F.when(F.col("outcome") == "rejected", F.lit(1))).alias("n_rejected"))


def failure_runs(log: DataFrame, min_length: int = 3, bucket_seconds: int = 86400) -> DataFrame:
    """R2 simple form (gaps and islands): maximal runs of consecutive failures
    of at least ``min_length`` calls: ``client, run_start_us, run_end_us, length``."""
    w = int(bucket_seconds * 1_000_000)
    ev = add_bucket(log.select("client", "ts_us", "event_id", "failed"), "ts_us", w)
    r = per_key_rank(ev, "client", "ts_us", "event_id")
    succ_rank = F.when(~F.col("failed"), F.col("grank"))
    within = F.max(succ_rank).over(Window.partitionBy("client", "_b")
                                   .orderBy("ts_us", "event_id").rowsBetween(_UP, 0))
    carry = r.groupBy("client", "_b").agg(F.max(succ_rank).alias("_ls")).select(
        "client", "_b", F.max("_ls").over(Window.partitionBy("client").orderBy("_b")
                                          .rowsBetween(_UP, -1)).alias("_carry"))
    r = r.withColumn("_lsw", within).join(carry, ["client", "_b"], "left")
    island = F.coalesce(F.col("_lsw"), F.col("_carry"), F.lit(0))
    runs = r.filter(F.col("failed")).groupBy("client", island.alias("_island")).agg(
        F.min("ts_us").alias("run_start_us"), F.max("ts_us").alias("run_end_us"),
        F.count(F.lit(1)).alias("length"))
    return runs.filter(F.col("length") >= min_length).drop("_island")


# ------------------------------------------------------------------- R3


def exact_percentiles(df: DataFrame, group: str, value: str, qs=(0.5, 0.95, 0.99),
                      names=("p50", "p95", "p99"), digits: int = 6) -> DataFrame:
    """Exact linear-interpolation percentiles (``quantile_cont``) per group,
    from a value histogram: counts per distinct value (a partial aggregate, so a
    hot group costs one row per distinct value and task), cumulative counts by a
    window over the distinct values, then the needed order statistics by an
    equi-join on the group with a range test on the cumulative count."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(
        F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group).orderBy(value)
    hist = hist.withColumn("_cum", F.sum("_c").over(w.rowsBetween(_UP, 0))) \
        .withColumn("_prev", F.col("_cum") - F.col("_c"))
    n = hist.groupBy(group).agg(F.max("_cum").alias("_n"))
    targets = n.select(group, "_n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("q"), ((F.col("_n") - 1) * F.lit(q)).alias("h"))
        for q, name in zip(qs, names)])).alias("_t")) \
        .select(group, F.col("_t.q").alias("q"), F.col("_t.h").alias("h")) \
        .withColumn("_lo_i", F.floor("h").cast("bigint")) \
        .withColumn("_hi_i", F.ceil("h").cast("bigint"))
    idx = targets.select(group, "q", F.explode(F.array(
        F.struct(F.lit("lo").alias("which"), F.col("_lo_i").alias("i")),
        F.struct(F.lit("hi").alias("which"), F.col("_hi_i").alias("i")))).alias("_x")) \
        .select(group, "q", "_x.which", "_x.i")
    stats = idx.join(hist, group).filter((F.col("_prev") <= F.col("i")) & (F.col("i") < F.col("_cum"))) \
        .groupBy(group, "q").pivot("which", ["lo", "hi"]).agg(F.first(value))
    res = targets.join(stats, [group, "q"]).withColumn(
        "v", F.round(F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo")), digits))
    wide = res.groupBy(group).pivot("q", list(names)).agg(F.first("v"))
    return wide


def latency_summary(log: DataFrame, group: str = "client") -> DataFrame:
    """R3 per group: calls, mean and exact p50/p95/p99 latency."""
    base = log.groupBy(group).agg(F.count(F.lit(1)).alias("n_calls"),
                                  F.round(F.avg("latency_ms"), 6).alias("avg_ms"))
    return base.join(exact_percentiles(log, group, "latency_ms"), group, "left")


def latency_windows(log: DataFrame, group: str = "client", width: str = "1 hour") -> DataFrame:
    """R3 tumbling windows: calls, mean and max latency per group and window."""
    ts = F.timestamp_micros("ts_us")
    return log.groupBy(F.window(ts, width).alias("w"), group).agg(
        F.count(F.lit(1)).alias("n_calls"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"),
        F.max("latency_ms").alias("max_ms")) \
        .select(F.unix_micros("w.start").alias("window_start_us"), group, "n_calls", "avg_ms",
                "max_ms")
