"""Token counts of a sentence-piece vocabulary, with overlap resynchronisation of huge texts.

A huge text is cut into chunks.  Each is encoded with an overlap into its neighbours, as rows of their own,
so one text's chunks run in parallel.  Inside an overlap both encodings list where tokens begin; the pair is
spliced at a boundary that both have and that is proven stable: a blank after a character that is no blank,
where no piece of the vocabulary holds a blank after something else, so no merge can ever cross it.  Counts
left of it come from the left chunk, counts right of it from the right one.  Where an overlap holds no such
boundary, the text is encoded again with wider overlaps, in the end as one chunk.

Shorter texts use the same stable boundaries: between two of them the library's answer depends on that
stretch alone, so the counts of short stretches are kept in a bounded table and the library encodes only
stretches that are not in it.  Vocabularies for which stability can't be proven (another normaliser, other
pieces) are encoded text by text by the library.

Defined results: null and empty texts have 0 bytes and 0 tokens; every input row gives one row; equal rows
give equal results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

CHUNK_CHARS = 32_768
OVERLAP = 512
KEPT_CHARS = 48
KEPT = 600_000
ROWS = 128                  # texts whose new stretches go to the library together
BLANK = "▁"
_STRETCH = re.compile(" *[^ ]+| +")


class Pieces:
    """A vocabulary file's library encoder and what can be proven from its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.stable = all(BLANK not in p.lstrip(BLANK) for p in names) and BLANK in names and self._plain()
        # characters of text that a token stands for; of byte tokens, the first byte of a character
        self.chars = np.array([(int(p[3:5], 16) & 0xC0 != 0x80) if self.library.is_byte(i) else len(p)
                               for i, p in enumerate(names)], dtype=np.int64)
        self.kept: dict[str, int] = {}

    def _plain(self) -> bool:
        """Whether the normaliser only puts one blank before a text and turns blanks into the blank sign."""
        lib = self.library
        for text in (" a", "a  b ", "\uff21 e\u0301 \ufb01\u3000x\u00a0 \t\n", "\u6f22\U0001f600"):
            out = b"".join(bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.encode()
                           for i, p in zip(lib.encode(text), lib.encode(text, out_type=str)))
            if out.decode() != BLANK + text.replace(" ", BLANK):
                return False
        return True

    def _stretches(self, text: str) -> tuple[list[str], int]:
        """Stretches between stable boundaries, as texts for the library, and single blanks at the end."""
        if BLANK in text:                 # the blank sign itself counts as a blank: no shortcut
            return [text], 0
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" "), 0
        first, *rest = _STRETCH.findall(text)
        # the blank that the library puts before a text stands for the first blank of a later stretch
        alone = bool(rest) and rest[-1] == " "
        return [first, *(s[1:] for s in (rest[:-1] if alone else rest))], int(alone)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        if not self.stable:
            return [len(ids) for ids in self.library.encode(texts)]
        parts = [self._stretches(t) if t else ([], 0) for t in texts]
        kept = self.kept
        new = {s for p, _ in parts for s in p if s not in kept}
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = {s for p, _ in parts for s in p}
        new = list(new)
        kept.update(zip(new, map(len, self.library.encode(new))))
        out = [sum(map(kept.__getitem__, p)) + alone for p, alone in parts]
        for s in new:
            if len(s) > KEPT_CHARS:
                del kept[s]
        return out

    def starts(self, text: str) -> np.ndarray:
        """Where the tokens of a text begin, in characters; the blank put before it is at -1."""
        n = self.chars[np.array(self.library.encode(text), dtype=np.int64)]
        return np.cumsum(n) - n - 1


_made: dict[int, Pieces] = {}


def _pieces(shared) -> Pieces:
    """One per Python worker and vocabulary."""
    key = hash(shared.value)
    if key not in _made:
        _made[key] = Pieces(shared.value)
    return _made[key]


def stable_boundaries(text: str, lo: int, hi: int) -> list[int]:
    """Blanks after a character that is neither a blank nor the blank sign, at lo <= p < hi."""
    out, at = [], text.find(" ", max(lo, 1), hi)
    while at >= 0:
        if text[at - 1] not in (" ", BLANK):
            out.append(at)
        at = text.find(" ", at + 1, hi)
    return out


def _count_whole(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared)
        for batch in batches:
            texts, n = batch.column("text"), []
            for at in range(0, len(texts), ROWS):
                n += pieces.counts([t or "" for t in texts.slice(at, ROWS).to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                  names=["doc_id", "n_bytes", "n_tokens"])
    return run


MARK = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))


def marks(text: str, starts: np.ndarray, offset: int, lo: int, hi: int) -> list[dict]:
    """Stable token boundaries of the whole text within [lo, hi), each with the tokens before it in this chunk."""
    at = np.array(stable_boundaries(text, lo - offset, hi - offset), dtype=np.int64)
    if not len(at) or not len(starts):
        return []
    before = np.searchsorted(starts, at, side="right") - 1    # the last of equal starts: others are inner bytes
    return [{"at": int(a + offset), "before": int(b)} for a, b, s in zip(at, before, starts[before]) if a == s]


def _encode_chunks(shared):
    """Rows (doc_id, text_hash, no, n_chunks, from, offset, chunk, lo, hi) to their marks and totals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared)
        for batch in batches:
            left, right, total = [], [], []
            for chunk, offset, lo, hi, over in zip(*(batch.column(c).to_pylist() for c in ("chunk", "offset", "lo", "hi", "over"))):
                starts = pieces.starts(chunk)
                total.append(len(starts))
                left.append(marks(chunk, starts, offset, lo - over, lo + over) if lo else [])
                right.append(marks(chunk, starts, offset, hi - over, hi + over))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "text_hash", "no", "n_chunks")),
                                   pa.array(left, MARK), pa.array(right, MARK), pa.array(total, pa.int64())],
                                  names=["doc_id", "text_hash", "no", "n_chunks", "left", "right", "total"])
    return run


ENCODED = ("doc_id long, text_hash long, no long, n_chunks long, left array<struct<at: long, before: long>>, "
           "right array<struct<at: long, before: long>>, total long")


def _spliced(encoded: DataFrame) -> DataFrame:
    """Tokens of each text from its chunks; null where two neighbours have no common boundary."""
    w = Window.partitionBy("doc_id", "text_hash").orderBy("no")
    rows = encoded.dropDuplicates(["doc_id", "text_hash", "no"]).withColumn("after", F.lead("left").over(w))
    common = F.get(F.filter("right", lambda m: F.exists("after", lambda k: k["at"] == m["at"])), 0)
    rows = rows.withColumn("common", common)
    theirs = F.get(F.filter("after", lambda k: k["at"] == F.col("common.at")), 0)["before"]
    rows = rows.withColumn("n", F.when(F.col("no") + 1 == F.col("n_chunks"), F.col("total"))
                           .otherwise(F.col("common.before") - theirs))
    return rows.groupBy("doc_id", "text_hash").agg(
        F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"))


def _chunk_rows(docs: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_chars)).cast("bigint")
    rows = docs.select("doc_id", "text_hash", "text", "n", n.alias("n_chunks")) \
        .withColumn("no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1))) \
        .withColumn("lo", F.col("no") * chunk_chars).withColumn("hi", F.least(F.col("n"), (F.col("no") + 1) * chunk_chars)) \
        .withColumn("offset", F.greatest(F.lit(0).cast("bigint"), F.col("lo") - overlap))
    chunk = F.substring("text", (F.col("offset") + 1).cast("int"), (F.col("hi") + overlap - F.col("offset")).cast("int"))
    return rows.select("doc_id", "text_hash", "no", "n_chunks", "offset", "lo", "hi", F.lit(overlap).alias("over"),
                       chunk.alias("chunk"))


def count_tokens(docs: DataFrame, model_path: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of ``docs`` (doc_id, text), as the library counts whole texts."""
    with open(model_path, "rb") as f:
        model = f.read()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)          # a vocabulary file: fixed size
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    huge = F.coalesce(F.length("text") > chunk_chars + overlap, F.lit(False)) if Pieces(model).stable else F.lit(False)
    whole = docs.where(~huge).mapInArrow(_count_whole(shared), "doc_id long, n_bytes long, n_tokens long")

    long = docs.where(huge).select("doc_id", "text", "n_bytes", F.xxhash64("text").alias("text_hash"),
                                   F.length("text").cast("bigint").alias("n"))
    done = _resynchronise(long, shared, chunk_chars, overlap)
    named = long.select("doc_id", "n_bytes", "text_hash").join(
        done.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_tokens"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return whole.unionByName(named.select("doc_id", "n_bytes", "n_tokens"))


def _resynchronise(long: DataFrame, shared, chunk_chars: int, overlap: int) -> DataFrame:
    """(doc_id, text_hash, n_tokens) of the huge texts; rounds with wider overlaps until all align."""
    done, todo = None, long
    while True:
        encoded = _chunk_rows(todo, chunk_chars, overlap).repartition("doc_id", "text_hash", "no") \
            .mapInArrow(_encode_chunks(shared), ENCODED)
        found = cut_lineage(_spliced(encoded))
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = found.where("n_tokens is null").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
        if failed.isEmpty():
            return done
        overlap *= 4
        chunk_chars *= 2                     # chunks stay longer than their overlaps; in the end one chunk is left
        todo = todo.join(failed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
