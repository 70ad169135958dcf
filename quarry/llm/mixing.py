"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Training time runs from 0 to 1.  Each source has a schedule, a weight that is linear between knots.

1. The integral of its schedule is a source's weight.  All sources together get as many words as the corpus
   has; a source's target is its weight's part of them, but at most ``most`` times its own size; what is cut
   off goes to the others by weight, until no target is above its limit.
2. Up to time t a source has to supply ``D(t) = target * integral(0..t) / integral(0..1)`` words.  Its
   documents lie one after another in an order fixed by md5(doc_id), again from the start for each repeat;
   a copy that begins at word c of that line gets the training position D^-1(c) (a quadratic per segment).
   Words of a copy beyond the target are not taken.
3. Rows are range-sorted by the position of their first copy.

Where a document begins on its source's line is a prefix sum: documents fall into bins by the digits of
their md5, sums of bins are added up over groups of bins, and running sums stay inside one bin, so a source
with a third of all rows is spread over as many tasks as any other rows.

Defined results: null and empty texts have size 0 and nothing taken; a null source is a source, last in
order; a null doc_id is ordered as the empty string; equal rows are separate documents that follow one
another; a source without words has target 0; columns named like a result are replaced, others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

Schedule = Sequence[tuple[float, float]]       # knots (time, weight), times from 0 to 1
#: Integrals 1, 2 and 3: the light sources fade out, the heavy ones fade in.
FADE = ([(0.0, 1.5), (1.0, 0.5)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 1.5), (1.0, 4.5)])
BIN_ROWS = 256
BROADCAST_BYTES = 16 << 20
WORD = "[^ \\t-\\r]+"
_UP = Window.unboundedPreceding


def segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(integral before, time, weight, slope) of each piece between two knots, and at the end the whole integral."""
    times = [t for t, _ in schedule]
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])) or min(w for _, w in schedule) < 0:
        raise ValueError("a schedule has weights of 0 or more at increasing times from 0 to 1")
    out, done = [], 0.0
    for (t, w), (t2, w2) in zip(schedule, schedule[1:]):
        out.append((done, t, w, (w2 - w) / (t2 - t)))
        done += (w + w2) / 2 * (t2 - t)
    if done <= 0:
        raise ValueError("a schedule's integral is above 0")
    return [*out, (done, 1.0, schedule[-1][1], 0.0)]


def _rank(sources: DataFrame, name: str) -> DataFrame:
    """Sources numbered from 0 by code point, null last, without one task for all: ranges first."""
    last = F.col(name).isNull()
    ranged = cut_lineage(sources.withColumn("_mx_last", last).repartitionByRange("_mx_last", name)
                         .withColumn("_mx_part", F.spark_partition_id()))
    before = ranged.groupBy("_mx_part").agg(F.count(F.lit(1)).alias("_mx_n"))     # a row per partition
    before = before.withColumn("_mx_off", F.coalesce(F.sum("_mx_n").over(
        Window.orderBy("_mx_part").rowsBetween(_UP, -1)), F.lit(0))).drop("_mx_n")
    inside = F.row_number().over(Window.partitionBy("_mx_part").orderBy("_mx_last", name))
    return ranged.withColumn("_mx_at", inside).join(F.broadcast(before), "_mx_part") \
        .withColumn("_mx_sid", (F.col("_mx_off") + F.col("_mx_at") - 1).cast("bigint")) \
        .drop("_mx_part", "_mx_off", "_mx_at", "_mx_last")


def targets(sources: DataFrame, most: float) -> DataFrame:
    """Adds target: (source_size, weight) rows share the sum of sizes by weight, at most ``most`` sizes each."""
    rate, n_before = None, -1
    limit = F.lit(float(most)) * F.col("source_size")
    while True:
        above = F.lit(False) if rate is None else limit < F.lit(rate) * F.col("_mx_weight")
        total, kept, left, n = sources.agg(
            F.sum("source_size"), F.sum(F.when(above, limit).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("_mx_weight"))), F.count(F.when(above, 1))).first()
        if n == n_before or total is None:
            break
        n_before, rate = n, ((total - kept) / left if left else 0.0)
    return sources.withColumn("target", F.least(limit, F.lit(rate or 0.0) * F.col("_mx_weight")))


def _position(start: Column) -> Column:
    """The time at which the source's demand has reached word ``start``."""
    whole = F.element_at("_mx_segments", -1)["before"]
    x = F.when(F.col("target") > 0, start / F.col("target") * whole).otherwise(0.0)
    s = F.element_at(F.filter("_mx_segments", lambda s: s["before"] <= x), -1)
    y = x - s["before"]
    return s["time"] + F.when(y > 0, 2 * y / (s["weight"] + F.sqrt(s["weight"] * s["weight"] + 2 * s["slope"] * y))).otherwise(0.0)


def plan(docs: DataFrame, cycle: Sequence[Schedule] = FADE, most: float = 3.0, source: str = "source") -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with size, source_size, target, taken (words, repeats counted)
    and copies (array of structs position, words; one for each time that the document is used).

    ``cycle``: schedules given to the sources in code-point order, over and over."""
    docs = docs.drop("size", "source_size", "target", "taken", "copies")
    names = docs.columns
    docs = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")) \
        .withColumn("_mx_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    by_source = docs.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_mx_docs"))
    ranked = _rank(by_source, source)
    pieces = [segments(s) for s in cycle]
    kind = "array<struct<before: double, time: double, weight: double, slope: double>>"
    mine = F.element_at(F.array(*[F.array(*[F.struct(*map(F.lit, p)) for p in ps]).cast(kind) for ps in pieces]),
                        (F.pmod("_mx_sid", F.lit(len(cycle))) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("_mx_segments", mine)
                         .withColumn("_mx_weight", F.element_at("_mx_segments", -1)["before"]))
    n_sources, n_docs = ranked.agg(F.count(F.lit(1)), F.sum("_mx_docs")).first()
    aimed = targets(ranked, most).select(F.col(source).alias("_mx_source"), "_mx_sid", "source_size", "target", "_mx_segments")
    if n_sources * 200 <= BROADCAST_BYTES:           # else an ordinary join
        aimed = F.broadcast(aimed)
    docs = docs.join(aimed, F.col(source).eqNullSafe(F.col("_mx_source")))

    digits = max(1, math.ceil(math.log(max(1, (n_docs or 0) / BIN_ROWS), 16)))
    docs = docs.withColumn("_mx_bin", F.substring("_mx_key", 1, digits))
    group = F.substring("_mx_bin", 1, digits // 2).alias("_mx_group")
    bins = docs.groupBy("_mx_sid", "_mx_bin").agg(F.sum("size").alias("n")).select("_mx_sid", group, "_mx_bin", "n")
    groups = bins.groupBy("_mx_sid", "_mx_group").agg(F.sum("n").alias("n")).select(
        "_mx_sid", "_mx_group", F.coalesce(F.sum("n").over(
            Window.partitionBy("_mx_sid").orderBy("_mx_group").rowsBetween(_UP, -1)), F.lit(0)).alias("before"))
    begin = bins.join(groups, ["_mx_sid", "_mx_group"]).select("_mx_sid", "_mx_bin", (F.col("before") + F.coalesce(F.sum("n").over(
        Window.partitionBy("_mx_sid", "_mx_group").orderBy("_mx_bin").rowsBetween(_UP, -1)), F.lit(0))).alias("_mx_begin"))
    running = F.coalesce(F.sum("size").over(Window.partitionBy("_mx_sid", "_mx_bin").orderBy("_mx_key", "doc_id", "size")
                                            .rowsBetween(_UP, -1)), F.lit(0))
    placed = docs.withColumn("_mx_run", running).join(begin, ["_mx_sid", "_mx_bin"]) \
        .withColumn("_mx_start", F.col("_mx_begin") + F.col("_mx_run"))

    end = F.round("target").cast("bigint")
    start = lambda i: F.col("_mx_start") + i * F.col("source_size")
    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(math.ceil(most) - 1).cast("bigint")), lambda i: F.struct(
        _position(start(i)).alias("position"),
        F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), end - start(i))).alias("words"))), lambda c: c["words"] > 0)
    return placed.withColumn("copies", copies).select(
        *names, "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"]).alias("taken"), "copies")


def by_position(planned: DataFrame) -> DataFrame:
    """Range-sorted by the first copy's position; documents that are not used come last."""
    first = F.get("copies", 0)["position"]
    return planned.withColumn("first_position", first).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, cycle: Sequence[Schedule] = FADE, most: float = 3.0, source: str = "source") -> DataFrame:
    """The training sequence itself: a row of ``docs`` for each copy used, whole, range-sorted by position."""
    rows = plan(docs, cycle, most, source).withColumn("_mx_copy", F.explode("copies"))
    return rows.orderBy("_mx_copy.position", "doc_id").select(*docs.columns)
