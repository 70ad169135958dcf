"""Words and word hashes of whole text columns, vectorised over Arrow buffers.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D`` (UTF-8
never uses those bytes inside a character).  Hashes are polynomial hashes modulo
2**64 with a random value per byte, finished by a bijective mixer; they are the
same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.worker import drop, give_back

U64 = np.uint64
SEGMENT = 1 << 18          # bytes hashed at once: keeps the temporaries in cache
SLICE_BYTES = 1 << 19      # documents taken together
PART_ROWS = 1000           # rows of a batch whose results are sent on together

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """An independent hash of hash values for each ``salt``."""
    return mix(x + U64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64)))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n; the table grows by doubling and is kept."""
    p = _powers.get(base)
    if p is None:
        p = np.ones(1, dtype=U64)
    while len(p) < n:
        p = np.concatenate([p, p * U64(pow(base, len(p), 1 << 64))])
    if len(p) <= 4 * SEGMENT:
        _powers[base] = p
    return p[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@dataclass
class Words:
    """Words of consecutive texts: byte bounds in ``data`` and each text's first word."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray     # len(texts) + 1

    def hashes(self, lower: bool) -> np.ndarray:
        table = _BYTE_LOWER if lower else _BYTE
        n = len(self.start)
        out = np.empty(n, dtype=U64)
        at = 0
        inv = inverse(_BASE)
        while at < n:
            lo = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, lo + SEGMENT, side="right")))
            hi = int(self.end[to - 1])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            total = np.zeros(hi - lo + 1, dtype=U64)
            np.cumsum(table[self.data[lo:hi]] * powers(inv, hi - lo), out=total[1:])
            h = (total[e] - total[s]) * powers(_BASE, hi - lo)[s]
            out[at:to] = mix(h + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
            at = to
        return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    bufs = texts.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], dtype=kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def find_words(data: np.ndarray, off: np.ndarray) -> Words:
    word = ~_SPACE[data]
    n = len(data)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = off[:-1][off[:-1] < n]
    before[starts] = False
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, off))


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of texts of about ``max_bytes``; a longer text stands alone."""
    data, off = buffers(texts)
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
        to = min(to, n)
        part = off[at:to + 1]
        yield at, to, find_words(data[part[0]:part[-1]], part - part[0])
        at = to


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``k`` consecutive values (``len(h) - k + 1``)."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=U64)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(h * powers(inverse(base), n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(base, n)[:n - k + 1])


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that results are small; freed buffers go back to the system, and what another
    operator keeps in the worker goes."""
    drop()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
    give_back()


def one_array(column) -> pa.Array:
    """A table's column as one array."""
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) \
            if column.num_chunks else pa.array([], type=column.type)
    return column
