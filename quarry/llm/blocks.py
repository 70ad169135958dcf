"""Exact counts of hashed items over all documents, with answers sent back to where the items are.

Documents are dealt into blocks of bounded bytes by a hash.  Every block sorts its item hashes,
counts repeats inside the block, and sends one packed array per bucket of the hash space.  A bucket
adds up what all blocks sent and answers each of them with one packed array of totals in the order
received, so answers need no keys.  A hot item costs one entry per block, whatever its count.

    blocks = deal(docs, n_blocks)             # one shuffle of the texts, read again for the answers
    sent = send(blocks, items)                # (bucket, block, keys, counts)
    answers = answer(sent)                    # (bucket, block, totals)
    receive(blocks, answers, use, schema)     # use(table, totals of its items) -> table
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.textvec import U64, one_array, salted

BLOCK_BYTES = 8 << 20
BUCKET_ITEMS = 4_000_000
SENT = "bucket int, block int, keys binary, counts binary"
ANSWER = "bucket int, block int, totals binary"


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: a scan of lengths, one row to the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0)


def n_blocks_for(docs: DataFrame, n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(2 * shuffle_partitions(docs), math.ceil(n_bytes / block_bytes))


def n_buckets_for(docs: DataFrame, n_items: int) -> int:
    return max(shuffle_partitions(docs), math.ceil(n_items / BUCKET_ITEMS))


def deal(docs: DataFrame, n_blocks: int, *more: str) -> DataFrame:
    """doc_id, text (and ``more``) with the block that they belong to; copies of a text spread by doc_id."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    return docs.select("doc_id", "text", *more, block.alias("block"))


def _packed(counts: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the counts."""
    most = int(counts.max()) if len(counts) else 0
    for kind in (np.uint8, np.uint16, np.uint32):
        if most <= np.iinfo(kind).max:
            return counts.astype(kind)
    return counts.astype(np.uint64)


def _unpacked(raw, n: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(raw) // n]
    return np.frombuffer(raw, dtype=kind)


class Sorted:
    """Items of a block in (bucket, hash) order, repeats merged."""

    def __init__(self, hashes: np.ndarray, route: np.ndarray | None, n_buckets: int):
        bucket = ((salted(hashes, 7) if route is None else route) % U64(n_buckets)).astype(np.int32)
        order = np.argsort(hashes)
        by_bucket = bucket[order]
        order = order[np.argsort(by_bucket.astype(np.uint16) if n_buckets <= 1 << 16 else by_bucket,
                                 kind="stable")]
        h, b = hashes[order], bucket[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        self.order, self.at = order, np.flatnonzero(new)
        self.keys, self.bucket = h[self.at], b[self.at]
        self.group = np.cumsum(new) - 1
        self.n = len(hashes)

    def counts(self, weights: np.ndarray | None = None) -> np.ndarray:
        if weights is None:
            return np.diff(np.append(self.at, self.n)).astype(np.uint64)
        if not self.n:
            return np.zeros(0, np.uint64)
        return np.add.reduceat(weights[self.order].astype(np.uint64), self.at)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(self.bucket) \
            else np.zeros(0, np.int64)
        return cuts, np.append(cuts[1:], len(self.bucket))

    def spread(self, totals: np.ndarray) -> np.ndarray:
        """Totals of the merged items, back at every item's place."""
        out = np.empty(self.n, dtype=totals.dtype)
        out[self.order] = totals[self.group]
        return out


#: items(table) -> (hash of every item, weight of every item or None, second hash or None).  The
#: bucket comes from the second hash where there is one: its bits then add to the key's 64.
Items = Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]


def packed_rows(items: tuple, n_buckets: int, block: int) -> pa.Table:
    """One row per bucket: the distinct hashes and their counts."""
    hashes, weights, route = items
    s = Sorted(hashes, route, n_buckets)
    counts = s.counts(weights)
    lo, hi = s.bounds()
    return pa.table({
        "bucket": pa.array(s.bucket[lo] if len(lo) else [], pa.int32()),
        "block": pa.array([block] * len(lo), pa.int32()),
        "keys": pa.array([s.keys[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary()),
        "counts": pa.array([_packed(counts[a:b]).tobytes() for a, b in zip(lo, hi)], pa.binary())})


def send(blocks: DataFrame, items: Items, n_buckets: int) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        return packed_rows(items(table), n_buckets, table.column("block")[0].as_py())
    return blocks.groupBy("block").applyInArrow(one, SENT)


def merge_bucket(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(keys sent by each row, distinct keys, their totals, index of every sent key among the distinct)."""
    keys = keys_of(table)
    counts = [_unpacked(x.as_buffer(), len(k)) for x, k in zip(one_array(table.column("counts")), keys)]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), dtype=np.uint64)
    done = 0
    for k, c in zip(keys, counts):       # keys of one block are distinct: plain indexed addition
        totals[at[done:done + len(k)]] += c.astype(np.uint64)
        done += len(k)
    return keys, distinct, totals, at


def answer(sent: DataFrame, most: int | None = None) -> DataFrame:
    """Totals over all blocks.  ``most``: answers above it are given as it (flags need one byte)."""
    def one(table: pa.Table) -> pa.Table:
        keys, _distinct, totals, at = merge_bucket(table)
        if most is not None:
            totals = np.minimum(totals, U64(most))
        return answer_rows(table, totals[at], keys)
    return sent.groupBy("bucket").applyInArrow(one, ANSWER)


def answer_rows(table: pa.Table, values: np.ndarray, keys: list[np.ndarray]) -> pa.Table:
    """``values`` of all keys sent, cut up for the rows that sent them."""
    cuts = np.cumsum([0, *map(len, keys)])
    return pa.table({"bucket": one_array(table.column("bucket")), "block": one_array(table.column("block")),
                     "totals": pa.array([_packed(values[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def keys_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=U64) for x in one_array(table.column("keys"))]


def spread_answers(items: tuple, n_buckets: int, buckets: list[int], totals: pa.Array) -> np.ndarray:
    """The answers to a block, at the places of its items."""
    hashes, _weights, route = items
    s = Sorted(hashes, route, n_buckets)
    lo, hi = s.bounds()
    got = dict(zip(buckets, totals))
    parts = [_unpacked(got[b].as_buffer(), z - a).astype(np.uint64)
             for b, a, z in zip((s.bucket[lo].tolist() if len(lo) else []), lo, hi)]
    return s.spread(np.concatenate(parts) if parts else np.zeros(0, np.uint64))


def receive(blocks: DataFrame, answers: DataFrame, items: Items, n_buckets: int, use, schema: str) -> DataFrame:
    """``use(table, totals)`` for each block, with every item's total over all documents."""
    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return use(left, spread_answers(items(left), n_buckets, right.column("bucket").to_pylist(),
                                        one_array(right.column("totals"))))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, schema)
