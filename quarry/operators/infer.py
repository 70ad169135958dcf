"""Batch inference: model-call hook (I1), reply parsing (T9), fallback routing
(T10), result projection (T11), embeddings (I4).

The only Python stage is the model call itself (``mapInPandas``, one backend
per partition, Arrow batches); everything around it is Catalyst expressions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import constants as K
from quarry.functions import text as tx

# ------------------------------------------------------------------- I1

Backend = Callable[[list[str]], list[str]]


class ModelCallError(RuntimeError):
    pass


def call_with_retry(backend: Backend, prompts: list[str], retries: int = K.MODEL_RETRIES,
                    backoff: float = K.MODEL_BACKOFF_SECONDS, sleep=time.sleep):
    """attempts = max(1, retries + 1); sleep ``backoff * 2**i`` before retry i+1.

    Returns (replies, attempts, error); on final failure replies are None and
    ``error`` holds the last exception text (the batch never fails).
    """
    attempts = max(1, retries + 1)
    last = None
    for i in range(attempts):
        try:
            out = backend(prompts)
            if len(out) != len(prompts):
                raise ModelCallError(f"backend returned {len(out)} replies for {len(prompts)}")
            return out, i + 1, None
        except Exception as e:  # noqa: BLE001 - any backend error becomes data
            last = e
            if i < attempts - 1:
                sleep(backoff * (2 ** i))
    return [None] * len(prompts), attempts, f"{type(last).__name__}: {last}"


def call_each(backend: Backend, prompts: list[str], retries: int = K.MODEL_RETRIES,
              backoff: float = K.MODEL_BACKOFF_SECONDS, sleep=time.sleep):
    """One (reply, attempts, error) per prompt, so that a prompt the backend fails
    on spoils no other one: the prompts are sent together with retries; if that
    fails, halves are sent once each and halved again, down to single prompts,
    which get the retries again.  ``attempts`` counts all requests a prompt was in."""
    def alone(part: list[str], before: int, tries: int):
        replies, attempts, error = call_with_retry(backend, part, tries, backoff, sleep)
        if error is None or len(part) == 1:
            return [(reply, before + attempts, error) for reply in replies]
        middle = len(part) // 2
        halves = (part[:middle], part[middle:])
        return [row for half in halves
                for row in alone(half, before + attempts, retries if len(half) == 1 else 0)]
    return alone(prompts, 0, retries) if prompts else []


def call_model(df: DataFrame, backend_factory: Callable[[], Backend], prompt_col: str = "prompt",
               batch_rows: int = 16, retries: int = K.MODEL_RETRIES,
               backoff: float = K.MODEL_BACKOFF_SECONDS,
               num_partitions: int | None = None) -> DataFrame:
    """Add ``reply, attempts, error, latency_ms`` by calling the backend.

    ``backend_factory`` is called once per partition (connections, model
    weights).  Requests go in groups of ``batch_rows``; a failing group is halved
    until the failing prompts stand alone (``call_each``): only they get their
    error in the ``error`` column, and the job carries on.
    """
    out_schema = T.StructType(df.schema.fields + [
        T.StructField("reply", T.StringType()), T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType()), T.StructField("latency_ms", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = backend_factory()
        for pdf in batches:
            replies, attempts, errors, lat = [], [], [], []
            prompts = pdf[prompt_col].fillna("").tolist()
            for s in range(0, len(prompts), batch_rows):
                chunk = prompts[s:s + batch_rows]
                t0 = time.perf_counter()
                rows = call_each(backend, chunk, retries, backoff)
                ms = round((time.perf_counter() - t0) * 1000 / max(1, len(chunk)), 2)
                replies += [r for r, _, _ in rows]
                attempts += [a for _, a, _ in rows]
                errors += [e for _, _, e in rows]
                lat += [ms] * len(chunk)
            yield pdf.assign(reply=replies, attempts=attempts, error=errors, latency_ms=lat)

    src = df.repartition(num_partitions) if num_partitions else df
    return src.mapInPandas(run, out_schema)


class FirstSentenceBackend:
    """Deterministic stand-in model: replies with a JSON object built from the
    first sentence of the message body found in the prompt."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            body = p.split("\n\nBody:\n\n", 1)[-1].split("\n\nThe input format is:", 1)[0]
            first = body.strip().split(".")[0].strip()
            out.append(json.dumps({"category": "Other", "summary": first,
                                   "detailedSummary": first, "priority": "Normal"}))
        return out


# ------------------------------------------------------------------- T9

REPLY_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("detailedSummary", T.StringType()),
    T.StructField("priority", T.StringType()),
])

FENCE_OPEN_RE = r"(?i)\A```(?:json)?" + K.WS + r"*\n?"
FENCE_CLOSE_RE = r"(?i)\n?```\n?\z"
OBJECT_RE = r"(?s)(\{.*\})"


def reply_object(col) -> Column:
    """T9 first half: fences removed, stripped, greedy first '{' .. last '}'."""
    t = F.regexp_replace(tx._c(col), FENCE_OPEN_RE, "")
    t = tx.py_strip(F.regexp_replace(t, FENCE_CLOSE_RE, ""))
    return F.regexp_extract(t, OBJECT_RE, 1)


def parse_reply(col, schema: T.StructType = REPLY_SCHEMA) -> Column:
    """The reply's JSON object as a struct, null when there is none or it is
    not strict JSON (a one-element array parse rejects trailing text, a second
    object and single quotes, which plain ``from_json`` would let through).

    No object gives ``[]``, an array without elements.  The array is bound by
    ``filter``, so the text is cleaned and parsed once a row."""
    arr = F.from_json(F.concat(F.lit("["), reply_object(col), F.lit("]")), T.ArrayType(schema),
                      {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    one = F.filter(F.array(arr), lambda a: F.size(a) == 1)
    return F.get(F.get(one, F.lit(0)), F.lit(0))


# ------------------------------------------------------------------ T10

RESULT_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("detailedSummary", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("flag_fallback_disabled", T.BooleanType()),
    T.StructField("flag_empty_body", T.BooleanType()),
    T.StructField("flag_email_id", T.StringType()),
])


def route_result(parsed: Column, body: Column, email_id: Column) -> Column:
    """No summary -> UNKNOWN record; else blank body -> NOTIF record; else
    the parsed reply."""
    def rec(category=None, subject=None, summary=None, detailed=None, priority=None,
            typ=None, conf=None, fb=None, empty=None, eid=None):
        def v(x, t):
            return x if isinstance(x, Column) else F.lit(x).cast(t)
        return F.struct(v(category, "string").alias("category"), v(subject, "string").alias("subject"),
                        v(summary, "string").alias("summary"),
                        v(detailed, "string").alias("detailedSummary"),
                        v(priority, "string").alias("priority"), v(typ, "string").alias("type"),
                        v(conf, "double").alias("confidence"),
                        v(fb, "boolean").alias("flag_fallback_disabled"),
                        v(empty, "boolean").alias("flag_empty_body"),
                        v(eid, "string").alias("flag_email_id"))
    s = parsed["summary"]
    no_summary = s.isNull() | (s == F.lit(""))
    blank = tx.py_strip(F.coalesce(body, F.lit(""))) == F.lit("")
    return (F.when(no_summary, rec(typ="UNKNOWN", conf=0.0, fb=True,
                                   eid=F.coalesce(email_id, F.lit("unknown"))))
            .when(blank, rec(typ="NOTIF", conf=0.0, empty=True))
            .otherwise(rec(parsed["category"], parsed["subject"], s, parsed["detailedSummary"],
                           parsed["priority"])))


# ------------------------------------------------------------------ T11

def session_id(email_id: Column, run_id: str) -> Column:
    """Deterministic session id per (run, email) (the service uses uuid4)."""
    return F.sha2(F.concat(F.lit(run_id + ":"), email_id), 256)


def project_result(result: Column, email_id: Column, subject: Column, run_id: str) -> list[Column]:
    """The live seven keys; subject always from metadata; no enum checks."""
    return [session_id(email_id, run_id).alias("session_id"), email_id.alias("email_id"),
            result["category"].alias("category"), subject.alias("subject"),
            result["summary"].alias("summary"),
            result["detailedSummary"].alias("detailedSummary"),
            result["priority"].alias("priority")]


# ------------------------------------------------------------------- I4

def embed(df: DataFrame, summary: str = "summary", subject: str = "subject",
          num_features: int = 1 << 12, out: str = "embedding") -> DataFrame:
    """I4 default: hashed term frequencies of "Subject: {s}\\nSummary: {m}",
    L2-normalised (``pyspark.ml.feature``, JVM-side).  Rows without a summary
    get an empty vector, as the reference returns "" without text."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    text = F.when(F.col(summary).isNotNull() & (F.col(summary) != F.lit("")),
                  F.concat(F.lit("Subject: "), F.coalesce(F.col(subject), F.lit("None")),
                           F.lit("\nSummary: "), F.col(summary)))
    x = df.withColumn("_embed_text", F.coalesce(text, F.lit("")))
    tok = RegexTokenizer(inputCol="_embed_text", outputCol="_tok", pattern=r"[^\p{L}\p{N}]+")
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    nm = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0)
    y = nm.transform(tf.transform(tok.transform(x)))
    vec = F.when(F.col("_embed_text") == F.lit(""), F.array().cast("array<double>")) \
        .otherwise(vector_to_array("_vec"))
    return y.withColumn(out, vec).drop("_embed_text", "_tok", "_tf", "_vec")
