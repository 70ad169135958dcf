"""Quality rules: a linear-chain CRF labels lines as content or boilerplate; the content share decides.

Counts of the rules (words, characters, symbols, repeated lines, repeated three-word windows) and the line
features come from the same vectorised pass over whole texts.  The CRF has two labels, one weight per feature
and a 2 x 2 transition table; Viterbi decoding labels all lines that hold a word.  A document is kept when
the base rules pass and its content lines hold at least ``MIN_SHARE`` of its words.

Training uses the ``SAMPLE`` labelled documents with the smallest hashes (a documented bound): first a
logistic model of lines against the quality of their document; lines of poor documents that it takes for
content become content; then the CRF, by gradient ascent on the exact likelihood.  Without labels of both
kinds all lines are content and only the base rules decide.

Defined results: null and empty texts have no words and fail the base rules; equal rows give equal results;
other columns pass through, columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textvec import U64, Words, buffers, find_words, mix, parts, rolling, salted

SAMPLE = 2000                 # labelled documents to learn from
MIN_SHARE = 0.5
TRAIN_LINES = 64              # lines of a training sequence; longer documents give several
SYMBOLS = b"#*$%&|<>"
_THREE = 0x8CB92BA72F3D8DD7 | 1
SLICE = 1 << 19

_CLASS = {name: np.zeros(256, dtype=bool) for name in ("space", "symbol", "upper", "lower", "digit", "bar", "mark", "end", "start")}
_CLASS["space"][[0x20, 9, 10, 11, 12, 13]] = True
_CLASS["symbol"][list(SYMBOLS)] = True
_CLASS["upper"][65:91] = True
_CLASS["lower"][97:123] = True
_CLASS["digit"][48:58] = True
_CLASS["bar"][124] = True
_CLASS["mark"][list(b"!?")] = True
_CLASS["end"][list(b".,;:")] = True
_CLASS["start"][:] = [b & 0xC0 != 0x80 for b in range(256)]      # first byte of a character
N_FEATURES = 12


@dataclass
class Counts:
    """Per text of a slice, and per line with a word (``doc``: its text)."""
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray
    line_words: np.ndarray
    features: np.ndarray = field(repr=False)


def _in_runs(flag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=total[1:])
    return total[hi] - total[lo]


def count(data: np.ndarray, off: np.ndarray) -> Counts:
    """Counts and features of consecutive texts."""
    n_docs = len(off) - 1
    w = find_words(data, off)
    h = w.hashes(lower=False)
    n_words = np.diff(w.first)
    word_doc = np.repeat(np.arange(n_docs), n_words)
    # lines: cut after each break and at the texts' ends
    breaks = np.flatnonzero(data == 10)
    order = np.concatenate([off[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n_docs), np.searchsorted(off, breaks, side="right") - 1])
    rank = np.lexsort((owner, order))
    begin, doc = order[rank], owner[rank]
    stop = np.empty_like(begin)
    stop[:-1] = np.where(doc[1:] == doc[:-1], begin[1:] - 1, off[doc[:-1] + 1])
    stop[-1:] = off[doc[-1:] + 1]
    words_at = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    line_words = words_at[1] - words_at[0]
    keep = line_words > 0
    begin, stop, doc, line_words = begin[keep], stop[keep], doc[keep], line_words[keep]
    first_word = words_at[0][keep]

    key = mix(Words(data, begin, stop, w.first).hashes(lower=False) + salted(doc.astype(U64), 5))
    fresh = np.unique(key, return_index=True)[1]
    n_lines = np.bincount(doc, minlength=n_docs)
    n_dup = n_lines - np.bincount(doc[fresh], minlength=n_docs)

    window = rolling(h, 3, _THREE)
    inside = word_doc[:len(window)] == word_doc[2:] if len(window) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    _, back, times = np.unique(mix(window[at] + salted(word_doc[at].astype(U64), 6)), return_inverse=True, return_counts=True)
    covered = np.zeros(len(h), dtype=bool)
    again = at[times[back] > 1]
    for i in range(3):
        covered[again + i] = True

    run = {name: _in_runs(table[data], begin, stop) for name, table in _CLASS.items()}
    chars = run["start"] - run["space"]
    line_of = np.repeat(np.arange(len(begin)), line_words)
    distinct_key = mix(h + salted(line_of.astype(U64), 8))
    distinct = np.bincount(line_of[np.unique(distinct_key, return_index=True)[1]], minlength=len(begin))
    last = data[w.end[first_word + line_words - 1] - 1] if len(begin) else np.zeros(0, np.uint8)
    letters = np.maximum(run["upper"] + run["lower"], 1)
    per_word = 1.0 / np.maximum(line_words, 1)
    features = np.stack([
        np.ones(len(begin)), np.log1p(line_words), run["symbol"] * per_word, run["upper"] / letters,
        run["digit"] / np.maximum(chars, 1), np.minimum(run["bar"] * per_word, 1), np.minimum(run["mark"] * per_word, 2),
        run["end"] * per_word, 1 - distinct * per_word, chars * per_word / 10, _CLASS["end"][last].astype(float),
        np.minimum(1.0, _in_runs(covered, first_word, first_word + line_words) * per_word)], axis=1) \
        if len(begin) else np.zeros((0, N_FEATURES))
    words_in = _in_runs(_CLASS["start"][data] & ~_CLASS["space"][data], off[:-1], off[1:])
    return Counts(n_words, words_in, _in_runs(_CLASS["symbol"][data], off[:-1], off[1:]), n_dup,
                  _in_runs(covered, w.first[:-1], w.first[1:]), doc, line_words, features)


def counted(texts: pa.Array) -> Iterator[Counts]:
    data, off = buffers(texts)
    at = 0
    while at < len(off) - 1:
        to = min(len(off) - 1, max(at + 1, int(np.searchsorted(off, off[at] + SLICE, side="right")) - 1))
        yield count(data[off[at]:off[to]], off[at:to + 1] - off[at])
        at = to


# ---------------------------------------------------------------- the CRF

@dataclass
class Crf:
    """Labels 0 (boilerplate) and 1 (content); ``weight @ features`` speaks for content."""
    weight: np.ndarray
    move: np.ndarray          # move[a, b]: from label a to label b

    def viterbi(self, score: list[float]) -> list[int]:
        """The best label sequence for the lines' scores; ties go to content."""
        if not score:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        zero, one, back = 0.0, score[0], []
        for s in score[1:]:
            b0, b1 = (1 if one + m10 >= zero + m00 else 0), (1 if one + m11 >= zero + m01 else 0)
            zero, one = (one + m10 if b0 else zero + m00), (one + m11 if b1 else zero + m01) + s
            back.append((b0, b1))
        label = 1 if one >= zero else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


EVERYTHING = Crf(np.eye(N_FEATURES)[0], np.zeros((2, 2)))     # all lines are content


def _adam(value: np.ndarray, grad, steps: int, rate: float = 0.05) -> np.ndarray:
    m, v = np.zeros_like(value), np.zeros_like(value)
    for t in range(1, steps + 1):
        g = grad(value)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        value = value + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return value


def train(docs: list[tuple[np.ndarray, int]], steps: int = 250, decay: float = 1e-3) -> Crf:
    """``docs``: line features of a document and its quality (0 or 1)."""
    docs = [(x, q) for x, q in docs if len(x)]
    if len({q for _, q in docs}) < 2:
        return EVERYTHING
    x = np.concatenate([f for f, _ in docs])
    poor = np.concatenate([np.full(len(f), q == 0) for f, q in docs])
    weigh = np.where(poor, 0.5 / max(1, poor.sum()), 0.5 / max(1, (~poor).sum()))   # both kinds count the same

    def logistic(w):
        return x.T @ (weigh * (~poor - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))) - decay * w
    first = _adam(np.zeros(N_FEATURES), logistic, steps)
    label = (~poor | (x @ first > 0)).astype(np.int64)

    # sequences of at most TRAIN_LINES lines, padded
    runs, at = [], 0
    for f, _ in docs:
        runs += [(a, min(a + TRAIN_LINES, at + len(f))) for a in range(at, at + len(f), TRAIN_LINES)]
        at += len(f)
    size = np.array([b - a for a, b in runs])
    index = np.minimum(np.array([a for a, _ in runs])[:, None] + np.arange(TRAIN_LINES), len(x) - 1)
    real = np.arange(TRAIN_LINES) < size[:, None]
    y = np.where(real, label[index], 0)
    pairs = real[:, 1:]
    seen = np.array([[np.sum(pairs & (y[:, :-1] == a) & (y[:, 1:] == b)) for b in (0, 1)] for a in (0, 1)], dtype=float)
    n = real.sum()

    def likelihood(p):
        w, move = p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2)
        e = np.stack([np.zeros_like(index, dtype=float), (x @ w)[index]], axis=2)
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, TRAIN_LINES):
            ahead[:, t] = np.where(real[:, t, None], e[:, t] + np.logaddexp(ahead[:, t - 1, :1] + move[0], ahead[:, t - 1, 1:] + move[1]),
                                   ahead[:, t - 1])
        for t in range(TRAIN_LINES - 2, -1, -1):
            z = e[:, t + 1] + behind[:, t + 1]
            behind[:, t] = np.where(real[:, t + 1, None], np.logaddexp(move[:, 0] + z[:, :1], move[:, 1] + z[:, 1:]), 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
        content = np.exp(np.clip(ahead[:, :, 1] + behind[:, :, 1] - total, -50, 0)) * real
        gap = np.bincount(index.ravel(), weights=((y - content) * real).ravel(), minlength=len(x))
        expected = np.array([[np.sum(pairs * np.exp(np.clip(
            ahead[:, :-1, a] + move[a, b] + e[:, 1:, b] + behind[:, 1:, b] - total, -50, 0))) for b in (0, 1)] for a in (0, 1)])
        return np.concatenate([x.T @ gap, (seen - expected).ravel()]) / n - decay * p
    fitted = _adam(np.concatenate([first, np.zeros(4)]), likelihood, steps)
    return Crf(fitted[:N_FEATURES], fitted[N_FEATURES:].reshape(2, 2))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        out = []
        for c in counted(batch.column("text")):
            cut = np.searchsorted(c.doc, np.arange(len(c.n_words) + 1))
            out += [c.features[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])]
        yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(out, pa.binary())],
                              names=["doc_id", "quality", "lines"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    """A model from at most ``sample`` labelled documents (labels: doc_id, quality)."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)") \
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")) \
        .orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(      # at most `sample` rows
        _features, "doc_id long, quality int, lines binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.lines)))
    return train([(np.frombuffer(r.lines, dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64), r.quality) for r in rows])


# ---------------------------------------------------------------- the rules

RESULTS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()),
    T.StructField("line_labels", T.ArrayType(T.ByteType())), T.StructField("kept", T.BooleanType())]


def base_fails(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def label(docs: DataFrame, crf: Crf, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` with the counts, base_failed, line_labels (1 content, 0 boilerplate; lines that hold a word),
    content_share (of words, null without words) and kept."""
    names = [f.name for f in RESULTS]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            cols: dict[str, list] = {n: [] for n in names}
            for c in counted(batch.column("text")):
                score = (c.features @ crf.weight).tolist()
                cut = np.searchsorted(c.doc, np.arange(len(c.n_words) + 1))
                labels = [crf.viterbi(score[a:b]) for a, b in zip(cut, cut[1:])]
                flat = np.array([v for one in labels for v in one], dtype=np.int64)
                content = np.bincount(c.doc, weights=flat * c.line_words, minlength=len(c.n_words))
                share = content / np.maximum(c.n_words, 1)
                failed = base_fails(c.n_words, c.n_repeat_words)
                for name, v in (("n_words", c.n_words), ("word_chars", c.word_chars), ("n_symbols", c.n_symbols),
                                ("n_dup_lines", c.n_dup_lines), ("n_repeat_words", c.n_repeat_words), ("base_failed", failed),
                                ("kept", ~failed & (share >= min_share))):
                    cols[name] += v.tolist()
                cols["content_share"] += [s if n else None for s, n in zip(share.tolist(), c.n_words)]
                cols["line_labels"] += labels
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.list_(pa.int8()), pa.bool_()]
            yield pa.record_batch(batch.columns + [pa.array(cols[n], k) for n, k in zip(names, kinds)],
                                  names=batch.schema.names + names)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULTS]))
