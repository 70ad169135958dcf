"""Keyed tables on Parquet: scan (S3), upsert (S5), append (S6), counts.

No table format with MERGE is available, so an upsert writes a *new version
directory* and never overwrites the path being read.  A version is named by
the writer (for a stream: the micro-batch id), which makes a replay of the
same batch rewrite the same version: idempotent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ingest import accepted, validate
from quarry.session import list_dirs, path_exists


def scan(emails: DataFrame, limit: int | None = None) -> DataFrame:
    """S3: ``get_emails(collection, limit)``.

    user_id is read from ``metadata['user_id']`` first, else the top-level
    field, else ``"unknown"``; rows failing validation are skipped; ``limit``
    null or 0 means all; rows are ordered by id so that a limit is
    deterministic (``TakeOrderedAndProject``, no global sort of the rest).
    """
    top_user = F.col("user_id") if "user_id" in emails.columns else F.lit(None).cast("string")
    out = validate(emails.select(
        F.col("id"), F.col("text"),
        F.coalesce(F.nullif(F.col("metadata")["user_id"], F.lit("")), top_user,
                   F.lit("unknown")).alias("user_id"),
        F.col("metadata")))
    out = accepted(out)
    if limit:
        return out.orderBy("id").limit(int(limit))
    return out


def latest_per_key(df: DataFrame, key: str, order: list[str] | str) -> DataFrame:
    """Newest row per key by ``order`` (last write wins), as a partial aggregate."""
    order = [order] if isinstance(order, str) else list(order)
    others = [c for c in df.columns if c != key]
    ordkey = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    return df.groupBy(key).agg(F.max_by(F.struct(*others), ordkey).alias("_last")) \
        .select(key, "_last.*")


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str,
           keep_last_good: str | None = None) -> DataFrame:
    """The whole row is replaced by the newest version of its key.

    ``keep_last_good`` names a column whose null value in a newer row must not
    replace an older non-null one (off by default, as in the reference).
    """
    both = base.unionByName(updates, allowMissingColumns=True)
    if not keep_last_good:
        return latest_per_key(both, key, version)
    good = both.withColumn("_good", F.col(keep_last_good).isNotNull())     # a key without any good row keeps its newest
    return latest_per_key(good, key, ["_good", version]).drop("_good")


class VersionedTable:
    """A keyed Parquet table stored as ``<path>/v=<n>`` directories."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def versions(self) -> list[int]:
        """Versions whose write was committed."""
        return sorted(int(d[2:]) for d in list_dirs(self.spark, self.path)
                      if d.startswith("v=") and path_exists(self.spark, f"{self.path}/{d}/_SUCCESS"))

    def read(self, before: int | None = None) -> DataFrame | None:
        vs = [v for v in self.versions() if before is None or v < before]
        if not vs:
            return None
        return self.spark.read.parquet(f"{self.path}/v={vs[-1]}")

    def write_version(self, df: DataFrame, version: int) -> str:
        out = f"{self.path}/v={version}"
        df.write.mode("overwrite").parquet(out)
        return out

    def upsert(self, updates: DataFrame, version: int, order: str = "updated_version",
               keep_last_good: str | None = None) -> str:
        """Merge ``updates`` into the newest version below ``version`` and write
        ``version``; re-running the same version gives the same table."""
        upd = updates.withColumn(order, F.lit(version).cast("bigint")) \
            if order not in updates.columns else updates
        base = self.read(before=version)
        merged = upd if base is None else upsert(base, upd, self.key, order, keep_last_good)
        if base is None:
            merged = latest_per_key(upd, self.key, order)
        return self.write_version(merged, version)



class InsertOnlyTable:
    """A keyed table that only ever gains rows (S4): one delta directory per
    write, ``<path>/part=<run>-<n>``.  An insert reads only the *keys* of the other
    committed deltas (column pruning), anti-joins, and writes its new rows as its own
    delta.  A stream's run is its query id (kept in its checkpoint), so a replayed
    micro-batch overwrites its own delta only; without a number each call is a run of
    its own, so no write ever touches another one's rows."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def parts(self) -> list[str]:
        return sorted(d[5:] for d in list_dirs(self.spark, self.path)
                      if d.startswith("part=") and path_exists(self.spark, f"{self.path}/{d}/_SUCCESS"))

    def read(self, but: str | None = None) -> DataFrame | None:
        ps = [p for p in self.parts() if p != but]
        if not ps:
            return None
        return self.spark.read.parquet(*[f"{self.path}/part={p}" for p in ps])

    def insert_if_absent(self, incoming: DataFrame, part: int | None = None,
                         valid: str | None = None) -> tuple[str, DataFrame]:
        from quarry.operators.ingest import first_per_key, insert_if_absent
        run = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        part = uuid.uuid4().hex if part is None else f"{run or 'batch'}-{part}"
        prior = self.read(but=part)
        new = first_per_key(incoming, self.key, valid=valid) if prior is None else \
            insert_if_absent(incoming, prior.select(self.key), self.key, valid=valid)
        out = f"{self.path}/part={part}"
        new.write.mode("overwrite").parquet(out)
        return out, new


def append(df: DataFrame, path: str) -> None:
    """Append-only sink."""
    df.write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table, one aggregate job per table, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["scan", "latest_per_key", "upsert", "VersionedTable", "InsertOnlyTable", "append",
           "read_or_empty", "table_counts"]
