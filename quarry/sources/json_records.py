"""JSON record source.

Two forms:

* **array / object files** (what the upload endpoint takes): one file holds a
  single object or an array whose non-object elements are skipped.  Read with
  ``wholetext`` (one row per file), parsed as ``array<string>`` so a bad
  element does not spoil its neighbours, exploded, and each object parsed
  with the record schema.  A file that is not JSON goes to quarantine.
* **JSON Lines** (large intake): text lines, splittable, parsed with a schema
  given up front (no inference); a bad line keeps its raw text and a reason.
  ``parse_record_lines`` takes a stream of lines as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import py_strip

RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("seq", T.LongType()),
])


def parse_record_files(files: DataFrame, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """``files(path, value)`` -> records plus ``_file``, ``_pos`` and ``_reason``
    (null for a good record, ``unreadable_file`` for a file that is not JSON)."""
    body = F.regexp_replace(py_strip(F.regexp_replace("value", "\\A\ufeff", "")), "\\A\ufeff", "")
    wrapped = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    arr = F.from_json(wrapped, T.ArrayType(T.StringType()))
    parsed = files.select(F.col("path").alias("_file"), arr.alias("_arr"))
    bad = parsed.filter(F.col("_arr").isNull()).select(
        "_file", F.lit(None).cast("int").alias("_pos"), F.lit("unreadable_file").alias("_reason"))
    good = parsed.filter(F.col("_arr").isNotNull()) \
        .select("_file", F.posexplode("_arr").alias("_pos", "_elem")) \
        .filter(F.ltrim(F.col("_elem")).startswith("{")) \
        .select("_file", "_pos", F.from_json("_elem", schema).alias("_rec")) \
        .filter(F.col("_rec").isNotNull()) \
        .select("_rec.*", "_file", "_pos", F.lit(None).cast("string").alias("_reason"))
    return good.unionByName(bad, allowMissingColumns=True)


def read_record_files(spark: SparkSession, path: str,
                      schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        "value", F.input_file_name().alias("path"))
    return parse_record_files(files, schema)


def parse_record_lines(lines: DataFrame, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """``lines(value)`` -> records plus ``_reason`` and ``_line``.

    A line that is not exactly one JSON object (broken, cut off, an array, a bare
    value, two objects) gives a row with reason ``bad_line`` and its raw text in
    ``_line``; good records have null in both.  Blank lines are skipped.  The
    line is parsed as a one-element array, once."""
    text = py_strip(F.regexp_replace("value", "\\A\ufeff", ""))
    arr = F.from_json(F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))), T.ArrayType(schema))
    rec = F.get(F.get(F.filter(F.array(arr), lambda a: F.size(a) == 1), F.lit(0)), F.lit(0))
    rows = lines.filter(text != F.lit("")).select("value", rec.alias("_rec"))
    bad = F.col("_rec").isNull()
    return rows.select("_rec.*", F.when(bad, F.lit("bad_line")).alias("_reason"), F.when(bad, F.col("value")).alias("_line"))


def read_record_lines(spark: SparkSession, path: str,
                      schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    return parse_record_lines(spark.read.text(path), schema)


def write_record_files(df: DataFrame, path: str, n_files: int, order: str = "seq",
                       junk_elements: bool = True, file_bytes: int = 8 << 20) -> None:
    """Write records as JSON *array* files (at least ``n_files``, and enough that
    none holds more than about ``file_bytes``; rows ordered by
    ``order`` inside a file).  A file is built by one task, so its size is
    bounded rather than growing with the data."""
    import math
    j = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    n_bytes = df.agg(F.sum(F.octet_length(j).cast("bigint"))).first()[0] or 0
    n_files = max(n_files, math.ceil(n_bytes / file_bytes))
    bucket = F.pmod(F.xxhash64(F.col(order)), F.lit(n_files))
    per_file = df.select(bucket.alias("_b"), F.col(order).alias("_o"), j.alias("_j")) \
        .groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_o", "_j"))).alias("_rows"))
    items = F.array_join(F.transform("_rows", lambda r: r["_j"]), ", ")
    prefix = '[1, "not an object", null, ' if junk_elements else "["
    # partitionBy puts each bucket in its own directory: one array per file even
    # when AQE coalesces the buckets into fewer tasks.
    per_file.select("_b", F.concat(F.lit(prefix), items, F.lit("]")).alias("value")) \
        .write.mode("overwrite").partitionBy("_b").text(path)
