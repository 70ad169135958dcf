"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words of a text (A-Z lower-cased) and one end token.  Bigrams of the training texts are
counted in Spark over buckets of the hash space (each task merges repeats first).  Every bucket turns
its counts into a segment of the filter: a bigram of count c is entered at the levels 1..floor(log2 c)+1,
``HASHES`` bits each.  Probing level after level until one is missing gives the quantised count back;
it is never too low and is a level too high with probability about 2**-HASHES.  The model is

    P(w | v) = (min(q(v, w), c(v)) + MU * P0(w)) / (c(v) + MU),   P0(w) = (c(w) + 1) / (N + V + 1)

with q(v, w) from the filter and the exact word counts c that the base score needs anyway; those come
back to each block of documents from the buckets of the word counts, so no vocabulary is broadcast.

The filter grows with the corpus.  Up to ``max_broadcast_bytes`` (checked on its stored size) it is
broadcast and probed where the texts are.  Beyond that the segments stay in their buckets, the blocks
send their bigrams there and get the quantised counts back; both ways give the same scores.

Defined results: a null or empty text is its end token; a null doc_id counts as training (the caller's
``train`` column decides, null means true); equal rows are separate documents; an empty table has no scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.textvec import U64, mix, one_array, salted, slices
from quarry.session import cut_lineage

HASHES = 6
MU = 200.0
END = U64(0x9D8A7F3C5B1E2460)
START = U64(0x13C6EF372B7E1516)
SEND_BYTES = 24 << 20           # text whose counts a task merges before it sends them
MAX_BROADCAST = 128 << 20
WORDS, BIGRAMS = 0, 1
LEVEL_VALUE = np.array([0.0] + [(2.0 ** (q - 1) + 2.0 ** q - 1) / 2 for q in range(1, 65)])


# ---------------------------------------------------------------- tokens

def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, hash of each token's predecessor, tokens per text)."""
    cur, prev, sizes = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _a, _b, w in slices(texts):
        h = w.hashes(lower=True)
        n = np.diff(w.first)
        text = np.repeat(np.arange(len(n)), n)
        c = np.empty(len(h) + len(n), dtype=U64)
        c[np.arange(len(h)) + text] = h
        c[w.first[1:] + np.arange(len(n))] = END
        p = np.empty_like(c)
        p[1:] = c[:-1]
        p[w.first[:-1] + np.arange(len(n))] = START
        cur.append(c)
        prev.append(p)
        sizes.append(n + 1)
    return np.concatenate(cur), np.concatenate(prev), np.concatenate(sizes)


def bigrams(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    return mix(prev * U64(0x9E3779B97F4A7C15) + salted(cur, 11))


# ---------------------------------------------------------------- the filter

def levels(counts: np.ndarray) -> np.ndarray:
    """floor(log2 c) + 1 for counts of one or more."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def segment_bits(counts: np.ndarray) -> int:
    """Bits for the entries of all levels at the load where half of the bits are set."""
    return max(64, (int(levels(counts).sum()) * HASHES * 1443 // 1000 + 63) // 64 * 64)


def _positions(keys: np.ndarray, level: int, i: int, m) -> np.ndarray:
    a, b = salted(keys, 2 * level), salted(keys, 2 * level + 1) | U64(1)
    return (a + U64(i) * b) % m


def build_segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    m = segment_bits(counts)
    flag = np.zeros(m, dtype=bool)
    q = levels(counts)
    level = 1
    while len(keys):
        for i in range(HASHES):
            flag[_positions(keys, level, i, U64(m))] = True
        level += 1
        more = q >= level
        keys, q = keys[more], q[more]
    return np.packbits(flag, bitorder="little").tobytes()


class Filter:
    """Segments by bucket in one array of bytes."""

    def __init__(self, n_buckets: int, segments: dict[int, bytes]):
        self.n_buckets = n_buckets
        size = np.array([len(segments.get(b, b"")) for b in range(n_buckets)], dtype=np.int64)
        self.bits = size.astype(np.uint64) * U64(8)
        self.at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(segments.get(b, b"") for b in range(n_buckets)), dtype=np.uint8)

    def level_of(self, keys: np.ndarray) -> np.ndarray:
        """Quantised level of each bigram; 0: not in the filter."""
        out = np.zeros(len(keys), dtype=np.int64)
        bucket = (salted(keys, 7) % U64(self.n_buckets)).astype(np.int64)
        alive = np.flatnonzero(self.bits[bucket] > 0)
        level = 1
        while len(alive):
            for i in range(HASHES):
                m, at = self.bits[bucket[alive]], self.at[bucket[alive]]
                pos = _positions(keys[alive], level, i, m).astype(np.int64)
                alive = alive[(self.data[at + (pos >> 3)] >> (pos & 7).astype(np.uint8)) & 1 == 1]
                if not len(alive):
                    return out
            out[alive] = level
            level += 1
            if level >= len(LEVEL_VALUE):
                return out
        return out


# ---------------------------------------------------------------- counting

def _send_counts(n_buckets: int):
    def flush(texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        cur, prev, _sizes = tokens_of(pa.concat_arrays(texts))
        for kind, items in ((WORDS, cur), (BIGRAMS, bigrams(prev, cur))):
            rows = B.packed_rows((items, None, None), n_buckets, 0).drop_columns("block")
            rows = rows.append_column("kind", pa.array([kind] * len(rows), pa.int32()))
            yield from rows.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("text"))
            n += batch.column("text").nbytes
            if n >= SEND_BYTES:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)
    return run


def _build(table: pa.Table) -> pa.Table:
    _keys, distinct, totals, _at = B.merge_bucket(table)
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()),
                     "n": pa.array([len(distinct)], pa.int64()), "total": pa.array([int(totals.sum())], pa.int64()),
                     "segment": pa.array([build_segment(distinct, totals) if kind == BIGRAMS else b""], pa.binary())})


def _probe(n_buckets: int):
    def run(sent: pa.Table, built: pa.Table) -> pa.Table:
        keys = B.keys_of(sent)
        if not keys:
            return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()),
                             "totals": pa.array([], pa.binary())})
        bucket = sent.column("bucket")[0].as_py()
        segments = {bucket: built.column("segment")[0].as_py()} if len(built) else {}
        return B.answer_rows(sent, Filter(n_buckets, segments).level_of(np.concatenate(keys)).astype(np.uint64), keys)
    return run


# ---------------------------------------------------------------- scoring

SCORED = ("doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _scores(table: pa.Table, cur, prev, sizes, count: np.ndarray, level: np.ndarray, n: int, v: int, n_texts: int) -> pa.Table:
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before = np.empty(len(cur), dtype=np.float64)
    before[1:] = count[:-1]
    before[first] = n_texts
    c = count.astype(np.float64)
    p0 = (c + 1.0) / (n + v + 1.0)
    p = (np.minimum(LEVEL_VALUE[level], before) + MU * p0) / (before + MU)
    add = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has its end token
    return pa.table({
        "doc_id": one_array(table.column("doc_id")), "train": one_array(table.column("train")),
        "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(add((count > 0).astype(np.int64)), pa.int64()),
        "train_tokens": pa.array(np.full(len(sizes), n), pa.int64()),
        "base_score": pa.array(add(np.log10(p0))), "score": pa.array(add(np.log10(p)))})


def score(docs: DataFrame, train: Column, max_broadcast_bytes: int = MAX_BROADCAST) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text) under a model of the rows where ``train`` holds.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score
    (log10 probability of the whole text under the bigram model)."""
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("train"))
    n_bytes = B.text_bytes(docs)
    n_buckets = B.n_buckets_for(docs, n_bytes // 5)
    counts = docs.where("train").select("text").mapInArrow(
        _send_counts(n_buckets), "bucket int, keys binary, counts binary, kind int")
    built = cut_lineage(counts.groupBy("kind", "bucket").applyInArrow(
        _build, "kind int, bucket int, n long, total long, segment binary"))
    n, v, size = built.agg(F.sum(F.when(F.col("kind") == WORDS, F.col("total"))),
                           F.sum(F.when(F.col("kind") == WORDS, F.col("n"))),
                           F.sum(F.length("segment").cast("bigint"))).first()
    n, v, size = n or 0, v or 0, size or 0
    n_texts = docs.where("train").count()
    segments = built.where(F.col("kind") == BIGRAMS).select("bucket", "segment")

    dealt = B.deal(docs, B.n_blocks_for(docs, n_bytes), "train")
    words = lambda t: _word_items(t)[:3]
    answers = B.answer(B.send(dealt, words, n_buckets))
    if size <= max_broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(
            Filter(n_buckets, {r.bucket: bytes(r.segment) for r in segments.collect()}))

        def use(table: pa.Table, count: np.ndarray) -> pa.Table:
            cur, prev, sizes = tokens_of(one_array(table.column("text")))
            return _scores(table, cur, prev, sizes, count, shared.value.level_of(bigrams(prev, cur)), n, v, n_texts)
        return B.receive(dealt, answers, words, n_buckets, use, SCORED)

    sent = B.send(dealt, _bigram_items, n_buckets)
    probed = sent.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInArrow(_probe(n_buckets), B.ANSWER)
    both = answers.withColumn("kind", F.lit(WORDS)).unionByName(probed.withColumn("kind", F.lit(BIGRAMS)))

    def use_both(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {k: right.filter(pc.equal(right.column("kind"), k)) for k in (WORDS, BIGRAMS)}
        count, level = (B.spread_answers(items(left), n_buckets, got[k].column("bucket").to_pylist(),
                                         one_array(got[k].column("totals")))
                        for k, items in ((WORDS, words), (BIGRAMS, _bigram_items)))
        cur, prev, sizes = tokens_of(one_array(left.column("text")))
        return _scores(left, cur, prev, sizes, count, level.astype(np.int64), n, v, n_texts)
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(use_both, SCORED)


def _word_items(table: pa.Table):
    cur, _prev, sizes = tokens_of(one_array(table.column("text")))
    train = one_array(table.column("train")).to_numpy(zero_copy_only=False)
    return cur, np.repeat(train, sizes), None


def _bigram_items(table: pa.Table):
    cur, prev, _sizes = tokens_of(one_array(table.column("text")))
    return bigrams(prev, cur), None, None
