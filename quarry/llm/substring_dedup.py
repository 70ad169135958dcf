"""Substring dedup: words covered by a word window that starts more than once in the corpus.

Method: a Rabin-Karp hash of every window of ``k`` consecutive words; the hashes are counted over
all documents in Spark (:mod:`quarry.llm.blocks`); windows counted twice or more merge into maximal
intervals of words to remove.  64 hash bits and the bucket (from a second hash) identify a window.

Defined results: null and empty texts have no words and no spans; texts shorter than ``k`` words
keep all; a window that occurs twice in one text counts as repeated; equal rows (same doc_id) are
separate documents; null doc_ids stay null.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import blocks as B
from quarry.llm.textvec import U64, one_array, rolling, salted, slices

SCHEMA = "doc_id long, n_words long, spans array<struct<start: long, stop: long>>, kept_text string"
_WINDOW = 0xC2B2AE3D27D4EB4F | 1
_WINDOW_2 = 0x165667B19E3779F9 | 1


def window_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of ``k`` words, in text order."""
    one, two = [np.zeros(0, U64)], [np.zeros(0, U64)]
    for _a, _b, w in slices(texts):
        h = w.hashes(lower=False)
        if len(h) < k:
            continue
        per = np.maximum(np.diff(w.first) - k + 1, 0)
        edge = np.zeros(len(h) + 1, dtype=np.int64)       # +1 where a text's windows begin, -1 after
        np.add.at(edge, w.first[:-1], per > 0)
        np.add.at(edge, w.first[:-1] + per, -(per > 0).astype(np.int64))
        inside = np.cumsum(edge)[:len(h) - k + 1] > 0
        one.append(rolling(h, k, _WINDOW)[inside])
        two.append(rolling(salted(h, 3), k, _WINDOW_2)[inside])
    return np.concatenate(one), np.concatenate(two)


def covered_words(repeated: np.ndarray, k: int) -> np.ndarray:
    """Which of a text's words lie in a window that is marked in ``repeated``."""
    edge = np.zeros(len(repeated) + k, dtype=np.int64)
    edge[:len(repeated)] += repeated
    edge[k:] -= repeated
    return np.cumsum(edge)[:len(repeated) + k - 1] > 0


def _spans(cover: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def remove_repeats(docs: DataFrame, k: int = 35) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (word positions removed), kept_text."""
    if k < 1:
        raise ValueError("a window has at least one word")
    n_bytes = B.text_bytes(docs)
    dealt = B.deal(docs, B.n_blocks_for(docs, n_bytes))
    n_buckets = B.n_buckets_for(docs, n_bytes // 5)

    def items(table: pa.Table):
        first, second = window_hashes(one_array(table.column("text")), k)
        return first, None, second

    def use(table: pa.Table, totals: np.ndarray) -> pa.Table:
        texts = one_array(table.column("text"))
        sizes = _window_counts(texts, k)
        n_words, spans, kept, at = [], [], [], 0
        for text, size in zip(texts, sizes):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n_words.append(len(words))
            mark = totals[at:at + size] > 1
            at += size
            if mark.any():
                cover = covered_words(mark, k)
                spans.append(_spans(cover))
                words = compress(words, (~cover).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table({"doc_id": one_array(table.column("doc_id")), "n_words": pa.array(n_words, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    answers = B.answer(B.send(dealt, items, n_buckets), most=2)
    return B.receive(dealt, answers, items, n_buckets, use, SCHEMA)


def _window_counts(texts: pa.Array, k: int) -> np.ndarray:
    return np.concatenate([np.maximum(np.diff(w.first) - k + 1, 0) for _a, _b, w in slices(texts)]) \
        if len(texts) else np.zeros(0, np.int64)
