"""Structured Streaming forms of the intake and request-log jobs.

* intake (S1 -> S4): JSON Lines stream -> normalise -> key -> validate ->
  ``foreachBatch`` insert-if-absent into a versioned table; the version is
  the micro-batch id, so a replayed batch rewrites the same version.
* dedup (K2): ``dropDuplicatesWithinWatermark`` on the content key.
* rate limit (R1) and breaker (R2): ``transformWithStateInPandas`` in event time; rows wait
  until the watermark has passed them, so results don't depend on files or micro-batches.
* latency windows (R3): watermark + tumbling window, update mode, upserted
  per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions import constants as K
from quarry.operators import ingest as ig
from quarry.operators import store as st
from quarry.sources.json_records import RECORD_SCHEMA

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state in RocksDB (needed by transformWithState; bounded memory)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(stream: DataFrame, batch_fn: Callable[[DataFrame, int], None],
                  checkpoint: str, output_mode: str = "append") -> None:
    """Run a stream over everything available now, batch by batch, then stop."""
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(batch_fn)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------- intake S4/K2

def record_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").json(path))


def keyed_stream(records: DataFrame, only_accepted: bool = True) -> DataFrame:
    """Keyed records; with ``only_accepted=False`` the S7 ``reason`` column is
    kept for consumers that pick accepted rows themselves."""
    k = ig.keyed_documents(ig.normalise_records(records)).drop("text_lines")
    return ig.accepted(k) if only_accepted else k


def intake_to_table(spark: SparkSession, source: str, table_path: str, checkpoint: str,
                    files_per_batch: int = 1) -> st.InsertOnlyTable:
    """S4 as a stream: every micro-batch inserts its new first arrivals as one
    delta (named by the batch id, so a replay rewrites only that delta)."""
    tbl = st.InsertOnlyTable(spark, table_path, key="id")

    def batch(df: DataFrame, batch_id: int) -> None:
        tbl.insert_if_absent(df, part=batch_id, valid="reason")

    run_available(keyed_stream(record_stream(spark, source, files_per_batch), only_accepted=False),
                  batch, checkpoint)
    return tbl


def dedup_stream(keyed: DataFrame, key: str = "id", event_time: str = "arrival",
                 delay: str = "3650 days", valid: str | None = "reason") -> DataFrame:
    """K2 in a stream: duplicates of a key within the watermark delay are dropped.

    With ``valid`` (a rejection reason column) accepted and rejected rows are
    de-duplicated apart and the rejected ones dropped afterwards, so no filter
    sits over the key extraction (it would be pushed down and run it twice).
    """
    if valid is None or valid not in keyed.columns:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    x = keyed.withColumn("_ok", F.col(valid).isNull()).withWatermark(event_time, delay)
    return x.dropDuplicatesWithinWatermark([key, "_ok"]).filter(F.col("_ok")).drop("_ok")


# ------------------------------------------------------------ R1 / R2 state

DECISION_SCHEMA = T.StructType([
    T.StructField("client", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts_us", T.LongType()), T.StructField("window_start_us", T.LongType()),
    T.StructField("n_in_window", T.LongType()), T.StructField("allowed", T.BooleanType())])


N_SHARDS = 1024
NO_CLIENT = -1                # shard of the rows without a client
STATE_ROWS = 50_000           # rows in one value of list state


class OrderedProcessor(StatefulProcessor):
    """Handles each client's rows in (ts, event_id) order, however files and micro-batches cut the log.

    The key is a shard of clients, so that a call handles many clients at once; clients without an id have
    a shard of their own.  Rows wait in list state, many in one value, until the watermark has passed them: none can
    come before them any more.  One timer at the earliest waiting row brings the shard back: only then are its waiting
    rows read.  Subclasses say what is left of a client's past; it is dropped when it can't matter any more."""

    OUT: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows BINARY")      # client, ts_us, event_id, failed
        self.past = handle.getListState("past", "rows BINARY")            # client, what the subclass keeps
        self.timer = handle.getValueState("timer", "ms LONG")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            if len(frame):
                self.waiting.appendList(self._packed(np.column_stack([
                    frame["client"].astype("int64"), frame["ts_us"].astype("int64"), frame["event_id"].astype("int64"), frame["failed"].astype(bool)])))
                self._wake_at(int(frame["ts_us"].min()))
        return iter([])

    def _wake_at(self, ts_us: int) -> None:
        ms = -(-ts_us // 1000)
        if self.timer.exists():
            due = self.timer.get()[0]
            if due <= ms:
                return
            self.handle.deleteTimer(due)
        self.timer.update((ms,))
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._rows(self.waiting)
        ready, rest = held[held[:, 1] <= passed_us], held[held[:, 1] > passed_us]
        if len(ready):
            self._put(self.waiting, rest)
            past = {r[0]: tuple(r[1:]) for r in self._rows(self.past).tolist()}
            out = []
            ready = ready[np.lexsort(ready.T[::-1])]
            for client, group in groupby(ready.tolist(), key=lambda r: r[0]):
                decided, past[client] = self.decide([(t, event, bool(failed)) for _, t, event, failed in group], past.get(client))
                shown = None if key[0] == NO_CLIENT else client
                out += [(shown, *r) for r in decided]
            self._put(self.past, np.array([(client, *p) for client, p in past.items() if self.matters(p, passed_us)], "int64"))
            yield pd.DataFrame(out, columns=self.OUT.names)
        if len(rest):
            self._wake_at(int(rest[:, 1].min()))

    @staticmethod
    def _packed(rows: np.ndarray) -> list[tuple[bytes]]:
        """Rows of integers as values of list state: the number of columns, then the rows."""
        return [(np.append(rows.shape[1], rows[i:i + STATE_ROWS]).astype("int64").tobytes(),)
                for i in range(0, len(rows), STATE_ROWS)]

    @staticmethod
    def _rows(state) -> np.ndarray:
        parts = [np.frombuffer(value, "int64") for (value,) in state.get()]
        return np.concatenate([p[1:].reshape(-1, p[0]) for p in parts] or [np.empty((0, 4), "int64")])

    def _put(self, state, rows: np.ndarray) -> None:
        if len(rows):
            state.put(self._packed(rows))
        else:
            state.clear()

    def decide(self, rows: list[tuple[int, int, bool]], past: tuple | None) -> tuple[list[tuple], tuple]:
        """Output rows without the client for a client's rows in order, and its past (integers) after them."""
        raise NotImplementedError

    def matters(self, past: tuple, passed_us: int) -> bool:
        """False if that past changes nothing for rows after ``passed_us``."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class RateLimitProcessor(OrderedProcessor):
    """R1 per client: past = (window start, requests counted in it), dropped once the window is over."""

    OUT = DECISION_SCHEMA

    def __init__(self, window_seconds: int = K.RATE_WINDOW_SECONDS, limit: int = K.RATE_LIMIT):
        self.w = int(window_seconds * 1_000_000)
        self.limit = limit

    def decide(self, rows, past):
        start, cnt = past or (None, 0)
        out = []
        for t, event, _failed in rows:
            start, cnt = (t, 1) if start is None or t >= start + self.w else (start, cnt + 1)
            out.append((event, t, start, cnt, cnt <= self.limit))
        return out, (start, cnt)

    def matters(self, past, passed_us):
        return passed_us < past[0] + self.w


CALL_SCHEMA = T.StructType([
    T.StructField("client", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts_us", T.LongType()), T.StructField("failed", T.BooleanType()),
    T.StructField("outcome", T.StringType())])


class BreakerProcessor(OrderedProcessor):
    """R2 per client: past = (consecutive failures, last failure time, OPEN?), kept while there are failures."""

    OUT = CALL_SCHEMA

    def __init__(self, threshold: int = K.BREAKER_THRESHOLD,
                 timeout_seconds: float = K.BREAKER_TIMEOUT_SECONDS):
        self.threshold = threshold
        self.t = int(timeout_seconds * 1_000_000)

    def decide(self, rows, past):
        f, last, is_open = past or (0, 0, False)
        out = []
        for t, event, failed in rows:
            if is_open and not (t - last > self.t):
                outcome = "rejected"
            elif not failed:
                f, is_open, outcome = 0, False, "accepted"
            else:
                f, last = f + 1, t
                is_open = f >= self.threshold
                outcome = "opened" if is_open else "accepted"
            out.append((event, t, failed, outcome))
        return out, (f, last, is_open)

    def matters(self, past, passed_us):
        return past[0] > 0


def log_stream(spark: SparkSession, path: str, schema: T.StructType,
               files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").parquet(path))


def stateful_decisions(log: DataFrame, processor: OrderedProcessor, delay: str, n_shards: int = N_SHARDS) -> DataFrame:
    """Decisions per client; ``delay``: how much later than the newest row a row may still come.
    Calls into Python cost per shard and micro-batch; the waiting rows of one shard are held in memory."""
    timed = log.withColumn("_ts", F.timestamp_micros("ts_us")).withWatermark("_ts", delay)
    shard = F.when(F.col("client").isNull(), F.lit(NO_CLIENT)).otherwise(F.pmod(F.xxhash64("client"), F.lit(n_shards)))
    known = F.coalesce("client", F.lit(0).cast("bigint"))          # a null would make the column's batch doubles in pandas
    return timed.withColumn("_shard", shard).withColumn("client", known).groupBy("_shard").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUT, outputMode="Append", timeMode="EventTime")


def append_batches(table_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink writing batch ``b`` to ``<path>/batch=<b>`` (replay-safe)."""
    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
    return batch


# ------------------------------------------------------------------- R3

def latency_window_stream(log: DataFrame, width: str = "1 hour",
                          delay: str = "1 day") -> DataFrame:
    """R3 in a stream: tumbling windows per client after a watermark; late rows
    (older than the watermark) are dropped by Spark."""
    ts = F.timestamp_micros("ts_us")
    return (log.withColumn("_ts", ts).withWatermark("_ts", delay)
            .groupBy(F.window("_ts", width).alias("w"), "client")
            .agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"),
                 F.max("latency_ms").alias("max_ms"))
            .select(F.unix_micros("w.start").alias("window_start_us"), "client", "n_calls",
                    "avg_ms", "max_ms"))


def upsert_batches(spark: SparkSession, table_path: str, key_cols: list[str]
                   ) -> tuple[st.VersionedTable, Callable[[DataFrame, int], None]]:
    """foreachBatch sink upserting update-mode rows by ``key_cols`` (version = batch id)."""
    tbl = st.VersionedTable(spark, table_path, key="_k")

    def batch(df: DataFrame, batch_id: int) -> None:
        k = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key_cols])
        tbl.upsert(df.withColumn("_k", k), version=batch_id + 1)
    return tbl, batch
