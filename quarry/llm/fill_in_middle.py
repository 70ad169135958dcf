"""Fill-in-the-middle: a text is cut at two unit boundaries and its parts are written in another order.

Units are lines (``[^\\n]*\\n|[^\\n]+``).  The bytes of a text are taken in fixed blocks; two Fenwick trees hold the
unit ends and the code points of each block.  A cut after u units goes down the trees by binary lifting to the block
that holds the u-th unit end, adding up the code points before it, and finds the end itself inside that block, so a
cut in a long text reads one block.  Cuts, form and order come from a hash of ``seed:doc_id`` alone.

Forms: ``plain`` is the text; ``psm`` is <P>prefix<S>suffix<M>middle; ``spm`` is <S>suffix<P>prefix<M>middle.  A
text that contains a marker stays plain, so a marker's first occurrence in an output is the one put there (no two
markers overlap), and ``restored`` gives the text back exactly.

Defined results: null texts count as empty; empty texts are plain with n = 0; a null doc_id hashes as the empty
string; rows equal in doc_id and text give equal outputs; other columns pass through, but n, form, prefix_chars,
middle_chars and output are replaced.  A row is handled by itself: no shuffle, memory of one Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 2048                                     # bytes
MARKERS = ("<P>", "<S>", "<M>")
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def fenwick(counts: np.ndarray) -> list[int]:
    """Tree over the counts; entry i (from 1) is the sum of the ``i & -i`` counts that end with the i-th."""
    total = np.append(0, np.cumsum(counts))
    i = np.arange(len(total))
    return (total - total[i - (i & -i)]).tolist()


class Blocks:
    """Unit ends and code points of a text's bytes by block."""

    def __init__(self, data: np.ndarray):
        self.data = data
        at = np.arange(0, len(data), BLOCK)
        ends = np.add.reduceat(data == 10, at, dtype=np.int64)
        ends[-1] += data[-1] != 10                                     # the last unit may lack its line end
        self.n = int(ends.sum())
        self.units = fenwick(ends)
        self.chars = fenwick(np.add.reduceat((data & 0xC0) != 0x80, at, dtype=np.int64))

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` units."""
        if not units:
            return 0, 0
        at, left, chars = 0, units, 0
        step = 1 << (len(self.units) - 1).bit_length() - 1
        while step:                                                    # blocks before the one with the wanted end
            if at + step < len(self.units) and self.units[at + step] < left:
                at += step
                left -= self.units[at]
                chars += self.chars[at]
            step >>= 1
        block = self.data[at * BLOCK:(at + 1) * BLOCK]
        ends = np.flatnonzero(block == 10)
        to = int(ends[left - 1]) + 1 if left <= len(ends) else len(block)
        return at * BLOCK + to, chars + int(np.count_nonzero((block[:to] & 0xC0) != 0x80))


def _parts(seed: int, rate: int, spm: int) -> list[Column]:
    """The four 32-bit groups of the row's hash, as the columns that the cuts use."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    return [h[0].alias("_fim_h1"), h[1].alias("_fim_h2"), (h[2] % 100 < rate).alias("_fim_takes_part"),
            (h[3] % 100 < spm).alias("_fim_spm")]


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``docs`` (doc_id, text, any others) with n (units), form, prefix_chars, middle_chars and output.
    ``rate`` and ``spm``: per cent of the texts that are cut, and of those in the order suffix, prefix, middle."""
    p, s, m = (x.encode() for x in markers)
    names = [c for c in docs.columns if c not in MADE]
    kept = docs.select(*names)
    fields = [*kept.schema.fields, T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
              T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
              T.StructField("output", T.StringType())]

    def one(raw: pa.Buffer | None, h1: int, h2: int, takes_part: bool, spm_form: bool) -> tuple:
        text = raw.to_pybytes() if raw is not None else b""
        if not text:
            return 0, "plain", None, None, text
        blocks = Blocks(np.frombuffer(text, np.uint8))
        if not takes_part or p in text or s in text or m in text:
            return blocks.n, "plain", None, None, text
        cuts = h1 % (blocks.n + 1), h2 % (blocks.n + 1)
        (a, chars_a), (b, chars_b) = blocks.cut(min(cuts)), blocks.cut(max(cuts))
        head, middle, tail = text[:a], text[a:b], text[b:]
        out = b"".join((s, tail, p, head, m, middle) if spm_form else (p, head, s, tail, m, middle))
        return blocks.n, "spm" if spm_form else "psm", chars_a, chars_b - chars_a, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.as_buffer() if t.is_valid else None for t in part.column("text")]
                rows = list(zip(*map(one, texts, *(part.column(c).to_pylist() for c in ("_fim_h1", "_fim_h2", "_fim_takes_part", "_fim_spm")))))
                made = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()),
                        pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary()).cast(pa.string())]
                yield pa.record_batch([*(part.column(c) for c in names), *made], names=[*names, *MADE])
    return kept.select(*names, *_parts(seed, rate, spm)).mapInArrow(run, T.StructType(fields))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from."""
    p, s, m = map(re.escape, markers)
    return F.when(form == "psm", F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2")) \
        .when(form == "spm", F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")).otherwise(output)
