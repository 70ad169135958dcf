"""Periodic runs of words by recompression.

A run is a stretch of consecutive words with smallest period q whose length is at least ``shortest`` and 2 q and that
no neighbouring word extends.  Documents of a slice, in classes of like lengths, stand one after the other with unique
separators between them.

Recompression turns the word numbers into a run-length grammar, level by level: block compression writes a stretch of
one symbol as (symbol, count); pair compression splits the symbols by a hash bit into left and right ones and writes
each left-right pair as one symbol.  Whether a boundary lies between two symbols depends on these two alone, so equal
stretches are cut alike inside.  A longest-common-extension query climbs the levels while both sides stand at
the beginnings of equal symbols and goes down where the symbols differ: a bounded number of steps a level, to either
side, exactly.  All queries of a slice go through the levels together.

Candidates: a run of period q has at least max(q, shortest - q) places in a row whose word comes again q words later,
so one of them lies on the grid of that step.  Grid places whose two words agree are extended both ways (n log n
grid places for n words).  Of equal stretches the smallest period is kept: by Fine and Wilf a longer period of such
a stretch is a multiple of the smallest.

Words are compared by 64-bit hashes.  Each document is handled by itself; memory is a slice of some megabytes, or one
longer document.

Defined results: null, empty and blank texts have no words and no runs, and collapse to the empty text; every row
gives a row, repeated rows alike; other columns pass through, but n_words, runs and collapsed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.textvec import U64, Words, salted, slices

SHORTEST = 12
SLICE = 4 << 20                   # bytes of text handled together
QUERIES = 1 << 18                 # extension queries asked together
TOP = 4                           # levels are added until no document has more symbols
MOST_LEVELS = 400
RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
MADE = ("n_words", "runs", "collapsed")


class Grammar:
    """Levels of a sequence: symbols, the parent of each on the next level, and each parent's first child.

    Symbols below zero are separators: they occur once each, at both ends of the sequence too, and join no pair."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.parent, self.first, self.blocks = [symbols], [], [], []
        self.fresh = int(symbols.max(initial=0)) + 1
        while len(self.symbols) < MOST_LEVELS and np.diff(np.flatnonzero(self.symbols[-1] < 0)).max(initial=0) > TOP + 1:
            self._block()
            self._pair()

    def _level(self, begins: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        self.parent.append((np.cumsum(begins) - 1).astype(np.int32))
        self.first.append(np.append(np.flatnonzero(begins), len(begins)))
        self.symbols.append(symbols)
        self.blocks.append(blocks)

    def _named(self, keys: np.ndarray) -> np.ndarray:
        """New symbols for keys, equal ones for equal keys."""
        codes, distinct = pd.factorize(keys)
        self.fresh += len(distinct)
        return codes + (self.fresh - len(distinct))

    def _block(self) -> None:
        s = self.symbols[-1]
        begins = np.append(True, s[1:] != s[:-1])
        if begins.all():
            return
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, len(s)))
        out = s[first]
        many = size > 1
        out[many] = self._named(out[many] << 32 | size[many])
        self._level(begins, out, True)

    def _pair(self) -> None:
        s = self.symbols[-1]
        right = (salted(s.astype(U64), len(self.symbols)) & U64(1)).astype(bool)
        pair = (s[:-1] >= 0) & (s[1:] >= 0) & ~right[:-1] & right[1:]
        if not pair.any():                                       # another bit on the next level
            self._level(np.ones(len(s), dtype=bool), s, False)
            return
        begins = np.append(True, ~pair)
        out = s[begins]
        at = np.flatnonzero(pair)
        out[np.cumsum(begins)[at] - 1] = self._named(s[at] << 32 | s[at + 1])
        self._level(begins, out, False)

    def extend(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many symbols from places i and j (i < j) on agree, to the right (step 1) or left (step -1)."""
        who, a, b = np.arange(len(i)), i, j
        stopped = []
        top = len(self.parent)
        for s, parent, first in zip(self.symbols, self.parent, self.first):
            same = s[a] == s[b]
            ended = [(who[~same], a[~same], b[~same])]
            who, a, b = who[same], a[same], b[same]
            pa_, pb = parent[a], parent[b]
            left_a, left_b = (first[pa_ + 1] - a, first[pb + 1] - b) if step > 0 else (a - first[pa_] + 1, b - first[pb] + 1)
            inside = (left_a < first[pa_ + 1] - first[pa_]) | (left_b < first[pb + 1] - first[pb])
            move = step * inside * np.minimum(left_a, left_b)    # to the end of the nearer parent
            a, b = a + move, b + move
            same = s[a] == s[b]
            ended.append((who[~same], a[~same], b[~same]))
            stopped.append(ended)
            who, a, b = who[same], parent[a[same]], parent[b[same]]
        s, ended = self.symbols[top], []
        while len(who):
            same = s[a] == s[b]
            ended.append((who[~same], a[~same], b[~same]))
            who, a, b = who[same], a[same] + step, b[same] + step
        stopped.append(ended)
        who, a, b = map(np.concatenate, zip(*stopped[top])) if stopped[top] else (who, a, b)
        for s, first, blocks, ended in reversed(list(zip(self.symbols, self.first, self.blocks, stopped))):
            size_a, size_b = first[a + 1] - first[a], first[b + 1] - first[b]
            a, b = (first[a], first[b]) if step > 0 else (first[a + 1] - 1, first[b + 1] - 1)
            same = s[a] == s[b]                                  # of different parents: the next children differ
            move = step * same * (np.minimum(size_a, size_b) if blocks else 1)
            who, a, b = map(np.concatenate, zip((who, a + move, b + move), *ended))
        out = np.empty(len(i), dtype=np.int64)
        out[who] = (a - i[who]) * step
        return out


def candidates(s: np.ndarray, doc: np.ndarray, longest: int, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid places whose words agree, in portions."""
    held, n = [], 0
    for q in range(1, longest // 2 + 1):
        step = max(q, shortest - q)
        at = np.flatnonzero(s[:len(s) - q:step] == s[q::step]) * step
        if not len(at):
            continue
        at = at[doc[at] == doc[at + q]]
        for lo in range(0, len(at), QUERIES):
            part = at[lo:lo + QUERIES]
            held.append((part, np.full(len(part), q, dtype=np.int64)))
            n += len(part)
            if n >= QUERIES:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def find_runs(words: np.ndarray, first: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (document, start, length, period) by document, start, period; document d has words[first[d]:first[d + 1]]."""
    size = np.diff(first)
    found = [np.zeros((0, 4), dtype=np.int64)]
    kind = np.frexp(np.maximum(size, 1))[1]
    for c in np.unique(kind[size >= max(2, shortest)]):
        docs = np.flatnonzero((kind == c) & (size >= max(2, shortest)))
        n = size[docs]
        begin = np.cumsum(n + 1) - n                             # a separator before each document, and one at the end
        s = np.full(int(n.sum()) + len(n) + 1, -1, dtype=np.int64)
        inside = np.ones(len(s), dtype=bool)
        inside[begin - 1] = inside[-1] = False
        which = np.repeat(np.arange(len(docs)), n)
        s[inside] = pd.factorize(words[np.arange(len(which)) + np.repeat(first[docs] - (np.cumsum(n) - n), n)])[0]
        s[~inside] = -1 - np.arange(len(n) + 1)
        doc = np.cumsum(~inside)
        grammar = Grammar(s)
        stretches = []
        for i, q in candidates(s, doc, int(n.max()), shortest):
            after = grammar.extend(i, i + q, 1)
            before = grammar.extend(i - 1, i + q - 1, -1)
            start, end = i - before, i + q + after
            long = end - start >= np.maximum(shortest, 2 * q)
            stretches.append(np.unique(np.stack([start, end, q], axis=1)[long], axis=0))
        runs = np.unique(np.concatenate(stretches), axis=0) if stretches else np.zeros((0, 3), dtype=np.int64)
        if len(runs):                                            # sorted: the smallest period of a stretch comes first
            runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))]
            d = doc[runs[:, 0]] - 1
            found.append(np.stack([docs[d], runs[:, 0] - begin[d], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1))
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def dropped(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words stand in a run after its first period."""
    edge = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    start = first[runs[:, 0]] + runs[:, 1]
    np.add.at(edge, start + runs[:, 3], 1)
    np.add.at(edge, start + runs[:, 2], -1)
    return np.cumsum(edge)[:-1] > 0


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank."""
    n_docs = len(w.first) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(w.first))[keep]
    start, size = w.start[keep], (w.end - w.start)[keep]
    blank = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, dtype=bool)
    to = np.cumsum(size + blank)
    out = np.full(int(to[-1]) if len(to) else 0, 32, dtype=np.uint8)
    at = to - size - blank
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[place + np.repeat(at, size)] = w.data[place + np.repeat(start, size)]
    cut = np.append(0, to)[np.searchsorted(doc, np.arange(n_docs + 1))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n_docs, [None, pa.py_buffer(cut), pa.py_buffer(out)]).cast(pa.string())


def runs_of(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` (text, any others) with n_words, runs (array of start, length, period by start and period) and
    collapsed, the words without those that repeat a run's first period, joined by one blank."""
    names = [c for c in docs.columns if c not in MADE]
    kept = docs.select(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", RUN),
                           T.StructField("collapsed", T.StringType())])
    cell = pa.struct([pa.field(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in slices(batch.column("text"), SLICE):
                runs = find_runs(w.hashes(lower=False), w.first, shortest)
                rows = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(cell))
                cuts = pa.array(np.searchsorted(runs[:, 0], np.arange(to - at + 1)), pa.int32())
                part = batch.slice(at, to - at)
                made = [pa.array(np.diff(w.first), pa.int64()), pa.ListArray.from_arrays(cuts, rows), joined(w, ~dropped(runs, w.first))]
                yield pa.record_batch([*(part.column(c) for c in names), *made], names=[*names, *MADE])
            pa.default_memory_pool().release_unused()
    return kept.mapInArrow(run, schema)
