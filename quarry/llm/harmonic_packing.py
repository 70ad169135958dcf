"""Harmonic packing of tokenised documents into sequences of a fixed capacity C.

A piece of length l is of class k = C div l: lengths in (C / (k + 1), C / k], k pieces to a sequence.  Documents are
cut so that classes fill their sequences: whole sequences first, then from what is left the largest C div k that
leaves nothing or at least ``LEAST`` tokens, until ``FINE`` tokens or fewer are left, which are the last piece.  So
pieces of the low classes have the class's full length, and only last pieces leave some room.  The cut depends on
the document's length alone.

Each class is dealt to workers by hash bins.  The counts of (class, bin) tell every worker the number of its first
piece within the class, and with it the sequences of all its pieces: piece r of class k stands in the class's
sequence r div k.  No worker asks another one, and a hot class is spread over all bins.  Pieces that do not fill a
class's last sequence (fewer than k of each class: at most some 25,000 pieces and a million tokens for a capacity of
4,096, whatever the corpus) stand one after the other and are cut every C tokens; what remains at the very end is
cut into powers of two, which are not padded.

Tokens: a document splits at ASCII blanks, which the pre-tokeniser always drops, so the library's ids of a text are
those of its words one after the other, and a Latin text's those of its splits (``splits_at_blanks`` and
``latin_splits`` test this on the tokenizer's specification).  The ids of short words and splits are kept in bounded
tables per worker; splits are found and looked up for many texts at once, as arrays of the texts' bytes.

Defined results: null and empty texts have the end token only; a null doc_id is kept; repeated rows are packed as
many times as they occur; no document, no piece.  Other columns are not read.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.textvec import U64, mix
from quarry.llm.worker import give_back, once
from quarry.session import batch_rows, shared_path

CAPACITY = 4096
FINE = 16                       # pieces of up to C / FINE tokens are not cut any more
LEAST = 16                      # no cut leaves fewer tokens than this
BIN_PIECES = 100_000
BATCH_ROWS = 1000               # documents sent to a worker at a time
PART_CHARS = 1 << 18
KEPT = 400_000                  # splits of a worker's table; half as many words
KEPT_LENGTH = 48
TOGETHER = 2000                 # splits given to the library as one text
SLOTS = 1 << 20                 # of the table of splits, over twice KEPT
AT_ONCE = 1 << 16               # splits looked up at once
KEY_BYTES = 23                  # longer splits are not kept
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"   # each a letter, unchanged by NFC, its lower case one letter of these
OTHERS = re.compile(f"[^\x00-\x7f{LETTERS}]")
PIECE = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=1 << 16)
def rest_cuts(n: int, capacity: int) -> tuple[int, ...]:
    """Lengths of the pieces of ``n`` < capacity tokens."""
    out = []
    while n * FINE > capacity:
        k = next((k for k in range(1, capacity + 1) if (left := n - capacity // k) == 0 or left >= LEAST), None)
        if k is None:                                                  # of small capacities only
            break
        out.append(capacity // k)
        n -= capacity // k
    return (*out, n) if n else tuple(out)


def cuts(n: int, capacity: int = CAPACITY) -> tuple[int, ...]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    return (capacity,) * (n // capacity) + rest_cuts(n % capacity, capacity)


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file (parsed) gives every run between ASCII blanks the ids that it has in the whole text:
    characters are normalised one by one or by NFC, which joins nothing to a blank; the first split drops all white
    space; models see one split at a time; nothing is added around a text's ids; and no added token holds a blank."""
    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " "
                for s in steps(spec["normalizer"], "normalizers"))
    split = (steps(spec["pre_tokenizer"], "pretokenizers") or [{}])[0]
    drops = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] \
        and split["pattern"].get("Regex", "").endswith("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
    whole = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    return plain and drops and whole and not spec.get("truncation") and not spec.get("padding")


def latin_splits(spec: dict) -> bool | None:
    """For a file that ``splits_at_blanks``: whether texts are lower-cased first, if ``find_splits`` splits texts of
    ASCII characters and ``LETTERS`` as the file does; None if it does not."""
    normal, split = spec["normalizer"] or {}, spec["pre_tokenizer"]
    split = split["pretokenizers"][0] if split["type"] == "Sequence" else split
    if split["pattern"]["Regex"] != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
        return None
    return any(s["type"] == "Lowercase" for s in normal.get("normalizers", [normal]) if s)


SPACE, LETTER, DIGIT, OTHER = range(4)
_KIND = np.full(256, OTHER, dtype=np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = SPACE
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = LETTER
_KIND[128:] = LETTER                                                  # bytes of LETTERS
_KIND[list(b"0123456789")] = DIGIT


def find_splits(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the splits of texts of ASCII characters and ``LETTERS`` (bytes, a blank at the end): runs of
    letters, single digits, runs of others, and at the beginning of such a run ``'s 't 're 've 'm 'll 'd``."""
    kind = _KIND[data]
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    new = (kind != before) | (kind == DIGIT)
    mark = np.flatnonzero((data[:-1] == 39) & (before[:-1] != OTHER))
    one, two = data[mark + 1], data[np.minimum(mark + 2, len(data) - 1)]
    size = np.zeros(len(mark), dtype=np.int64)
    for c in b"stmd":
        size[one == c] = 2
    for c, d in (b"re", b"ve", b"ll"):
        size[(one == c) & (two == d)] = 3
    mark, size = mark[size > 0], size[size > 0]
    new[mark + 1] = False
    new[mark + size] = True
    end = new & (before != SPACE)
    new &= kind != SPACE
    return np.flatnonzero(new), np.flatnonzero(end)


class Splits:
    """Ids of splits, ``KEPT`` of them kept by open addressing: a key is the split's bytes and its length."""

    def __init__(self, encode):
        self.encode = encode                     # of a list of splits: all ids, and how many each has
        self.forget()

    def __len__(self) -> int:
        return self.used

    def forget(self) -> None:
        self.used = self.n_ids = 0
        self.slots = np.full(SLOTS, -1, dtype=np.int32)
        self.keys = np.zeros((3, 1 << 12), dtype=U64)
        self.begin, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, dtype="<u4")

    def texts(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        joined = b" ".join([*raw, bytes(24)])
        data = np.frombuffer(joined, dtype=np.uint8)
        start, end = find_splits(data[:len(data) - 24])
        first = np.cumsum([0, *(len(r) + 1 for r in raw)])
        bounds = np.searchsorted(start, first).tolist()
        step = max(1, min(AT_ONCE, KEPT))
        found = [self._found(joined, start[at:at + step], end[at:at + step]) for at in range(0, len(start), step)]
        if not found:
            return [b""] * len(texts)
        ids = np.concatenate([i for i, _ in found])
        cut = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in found]))])[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def _found(self, joined: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these splits, and how many each has."""
        size = end - start
        short = np.flatnonzero(size <= KEY_BYTES)
        keys = _keys(joined, start[short], size[short])
        entry = self._look_up(keys)
        new = short[entry < 0]
        if len(new):
            lacks = np.unique(_hashes(keys[:, entry < 0]), return_index=True)[1]
            if self.used + len(lacks) > KEPT:
                self.forget()
                entry[:] = -1
            while len(open_ := np.flatnonzero(entry < 0)):              # again only for keys of one hash
                some = open_[np.unique(_hashes(keys[:, open_]), return_index=True)[1]]
                at = short[some]
                self._keep(keys[:, some], *self.encode([joined[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())]))
                entry[open_] = self._look_up(keys[:, open_])
        begin, count, ids = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), self.ids
        begin[short], count[short] = self.begin[entry], self.count[entry]
        if len(short) < len(start):
            at = np.flatnonzero(size > KEY_BYTES)
            long = [joined[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())]
            number = {w: i for i, w in enumerate(dict.fromkeys(long))}
            more, n = self.encode(list(number))
            which = np.array([number[w] for w in long])
            begin[at], count[at] = (self.n_ids + np.cumsum(n) - n)[which], n[which]
            ids = np.concatenate([ids[:self.n_ids], more])
        to = np.cumsum(count)
        return ids[np.repeat(begin - (to - count), count) + np.arange(int(to[-1]))], count

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """The entries of keys; -1: not kept."""
        at = (_hashes(keys) & U64(SLOTS - 1)).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[:, out] != keys).any(axis=0))
        while len(open_):
            at[open_] = at[open_] + 1 & SLOTS - 1
            out[open_] = found = self.slots[at[open_]]
            open_ = open_[(found >= 0) & (self.keys[:, found] != keys[:, open_]).any(axis=0)]
        return out

    def _keep(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New entries, all different."""
        n, n_ids = self.used + len(count), self.n_ids + len(ids)
        if n > len(self.count):
            self.keys, self.begin, self.count = (_longer(x, self.used, 2 * n) for x in (self.keys, self.begin, self.count))
        if n_ids > len(self.ids):
            self.ids = _longer(self.ids, self.n_ids, 2 * n_ids)
        entry = np.arange(self.used, n)
        self.keys[:, self.used:n], self.count[self.used:n] = keys, count
        self.begin[self.used:n] = self.n_ids + np.cumsum(count) - count
        self.ids[self.n_ids:n_ids] = ids
        at = (_hashes(keys) & U64(SLOTS - 1)).astype(np.int64)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]                           # of several, one stays
            left = self.slots[at] != entry
            entry, at = entry[left], at[left] + 1 & SLOTS - 1
        self.used, self.n_ids = n, n_ids


def _longer(x: np.ndarray, used: int, n: int) -> np.ndarray:
    out = np.zeros((*x.shape[:-1], n), dtype=x.dtype)
    out[..., :used] = x[..., :used]
    return out


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


def _keys(joined: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of splits of up to ``KEY_BYTES`` as three numbers, and in the last one's highest byte how many they are."""
    words = np.ndarray(len(joined) - 7, dtype="<u8", buffer=joined, strides=(1,))
    out = np.stack([words[start + 8 * i] & _MASK[np.clip(size - 8 * i, 0, 8)] for i in range(3)])
    out[2] |= size.astype(U64) << U64(56)
    return out


def _hashes(keys: np.ndarray) -> np.ndarray:
    return mix(keys[0] + mix(keys[1] + U64(0x9E3779B97F4A7C15) * keys[2]))


def _blanks(text: str) -> str:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return text


class Tokens:
    """Ids of whole texts as bytes (little-endian unsigned 32-bit).

    A text of ASCII characters and ``LETTERS`` is split as the model sees it, other texts at their blanks; the ids of
    the splits and words met are kept in two bounded tables, and the library encodes what is in neither."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        self.by_word = splits_at_blanks(parsed)
        self.words: dict[str, bytes] = {}
        self.splits = Splits(self._encode_splits)
        if self.by_word:
            self.lower = latin_splits(parsed)
            self.added = [t["content"].lower() for t in parsed["added_tokens"]]
            suffix = parsed["model"].get("end_of_word_suffix") or None
            size = self.library.get_vocab_size()
            first, *rest = parsed["pre_tokenizer"].get("pretokenizers", [parsed["pre_tokenizer"]])
            blank = first | {"pattern": {"String": " "}, "invert": False}
            bare = {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blank, *rest]},
                    "added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
            self.bare = Tokenizer.from_str(json.dumps(parsed | bare))  # of normalised splits with blanks between them
            self.bare.model = self.library.model
            self.is_end = np.array([bool(suffix) and (self.library.id_to_token(i) or "").endswith(suffix) for i in range(size)])

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_splits(self, splits: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of splits, many at a time, and how many each has: the last id of each ends a word."""
        out, counts = [], []
        for at in range(0, len(splits), TOGETHER):
            part = splits[at:at + TOGETHER]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):         # a vocabulary without such ids
                each = self._encode(part)
                ids, ends = np.frombuffer(b"".join(each), dtype="<u4"), np.cumsum([len(e) // 4 for e in each])
            out.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(out), np.concatenate(counts)

    def _kept(self, kept: dict[str, bytes], rows: list[list[str]], encode) -> list[bytes]:
        """The ids of rows of words, from the table where they are in it, which holds ``KEPT // 2`` of them."""
        out: list[bytes | None] = []
        for row in rows:
            try:
                out.append(b"".join(map(kept.__getitem__, row)))
            except KeyError:
                out.append(None)
        open_rows = [row for row, ids in zip(rows, out) if ids is None]
        if not open_rows:
            return out
        used = set().union(*open_rows)
        new = list(used.difference(kept))
        if len(kept) + len(new) > KEPT // 2:
            kept.clear()
            new = list(used)
        kept.update(zip(new, encode(new)))
        made = iter([b"".join(map(kept.__getitem__, row)) for row in open_rows])
        for w in new:
            if len(w) > KEPT_LENGTH:
                del kept[w]
        return [next(made) if ids is None else ids for ids in out]

    def _plain(self, text: str) -> str | None:
        """The normalised text, if its characters are ASCII or ``LETTERS`` and it holds no added token."""
        if self.lower is None or not text.isascii() and OTHERS.search(text):
            return None
        low = text.lower()
        return None if any(t in low for t in self.added) else low if self.lower else text

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        plain = [self._plain(w) for w in words]
        split = iter(self.splits.texts([w for w in plain if w is not None]))
        whole = iter(self._encode([w for w, p in zip(words, plain) if p is None]))
        return (next(whole if p is None else split) for p in plain)

    def texts(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encode(texts)
        plain = [self._plain(t) for t in texts]
        split = iter(self.splits.texts([t for t in plain if t is not None]))
        rows = [_blanks(t).split(" ") for t, p in zip(texts, plain) if p is None]
        words = iter(self._kept(self.words, rows, self._encode_words))
        return [next(words if p is None else split) for p in plain]

    def long_text(self, text: str) -> bytes:
        """A long text in portions that end at a blank."""
        if not self.by_word or len(text) <= PART_CHARS:
            return self.texts([text])[0]
        out, at = [], 0
        while at < len(text):
            to = text.find(" ", at + PART_CHARS)
            to = len(text) if to < 0 else to
            out += self.texts([text[at:to]])
            at = to + 1
        return b"".join(out)


def _tokens(spec: str) -> Tokens:
    """One per Python worker and vocabulary."""
    return once("harmonic_packing", hash(spec), lambda: Tokens(spec))


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (bytes), ids_crc32, doc_tokens."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())         # a vocabulary file: fixed size
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(spec.value)
        for doc_ids, texts in _parts(batches):
            ids = tokens.texts(texts) if len(texts) > 1 else [tokens.long_text(texts[0])]
            rows = []
            for doc_id, raw in zip(doc_ids, ids):
                raw = memoryview(raw + end)
                at, n = 0, len(raw) // 4
                for length in cuts(n, capacity):
                    piece = raw[4 * at:4 * (at + length)]
                    rows.append((doc_id, at, length, piece, zlib.crc32(piece), n))
                    at += length
            yield _batch(rows)
            pa.default_memory_pool().release_unused()
        give_back()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECE)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Documents taken together, up to PART_CHARS characters; a longer one stands alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            text = text.as_py()
            if texts and size + len(text) > PART_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens")
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    path = shared_path(spark, "packing")
    with batch_rows(spark, BATCH_ROWS):                                  # numbers and ids are read again: one fixed table
        tokenised(docs, tokenizer_path, end_id, capacity).withColumn("piece", F.monotonically_increasing_id()) \
            .write.option("compression", "zstd").parquet(path)
    pieces = spark.read.parquet(path)
    n_bins = max(1, math.ceil(pieces.count() / BIN_PIECES))
    pieces = pieces.withColumn("k", F.expr(f"{capacity} div length")) \
        .withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "piece"), F.lit(n_bins)))

    counts = pieces.groupBy("k", "bin").agg(F.count(F.lit(1)).alias("n_bin"))
    before = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n_bin").over(before), F.lit(0)))
    # one row a class, of which there are no more than the capacity
    classes = counts.groupBy("k").agg(F.sum("n_bin").alias("n_class")).withColumn("full", F.expr("n_class div k"))
    base = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    classes = F.broadcast(classes.withColumn("base", F.coalesce(F.sum("full").over(base), F.lit(0))).drop("n_class"))

    order = Window.partitionBy("k", "bin").orderBy("piece")
    ranked = pieces.withColumn("r", F.row_number().over(order) - 1).join(firsts.drop("n_bin"), ["k", "bin"]) \
        .withColumn("r", F.col("r") + F.col("first")).join(classes, "k") \
        .withColumn("sequence_id", F.expr("base + r div k"))
    inside = Window.partitionBy("sequence_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.where("r < full * k").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))

    n_full = classes.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    rest = ranked.where("r >= full * k").select("piece", "k", "r", "length")
    joined = _joined(rest, pieces, capacity, n_full)
    out = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*out).unionByName(joined.select(*out))


def _joined(rest: DataFrame, pieces: DataFrame, capacity: int, n_full: int) -> DataFrame:
    """The bounded rest one after the other, cut at multiples of the capacity and its end at powers of two."""
    line = Window.partitionBy(F.lit(0)).orderBy("k", "r").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("g", F.coalesce(F.sum("length").over(line), F.lit(0)))
    total = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    whole, left = divmod(total, capacity)
    ends, at = [], whole * capacity
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            ends.append(at)
            at += 1 << bit
    begins = F.array(*[F.lit(x).cast("bigint") for x in ends]) if ends else F.array().cast("array<bigint>")

    def number(x: Column) -> Column:
        return F.when(x < whole * capacity, F.floor(x / capacity)).otherwise(
            whole - 1 + F.size(F.filter(begins, lambda b: b <= x))).cast("bigint")

    def begin(s: Column) -> Column:
        return F.when(s < whole, s * capacity).otherwise(F.get(begins, (s - whole).cast("int"))).cast("bigint")

    parts = rest.withColumn("s", F.explode(F.sequence(number(F.col("g")), number(F.col("g") + F.col("length") - 1)))) \
        .withColumn("lo", F.greatest("g", begin(F.col("s")))) \
        .withColumn("hi", F.least(F.col("g") + F.col("length"), F.coalesce(begin(F.col("s") + 1), F.lit(total)))) \
        .select("piece", "s", (F.col("lo") - F.col("g")).alias("skip"), (F.col("hi") - F.col("lo")).alias("n"),
                (F.col("lo") - begin(F.col("s"))).alias("offset"))
    found = pieces.drop("k", "bin").join(F.broadcast(parts), "piece")
    ids = F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * n as int))")
    return found.select("doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("n").alias("length"), ids.alias("ids"),
                        "doc_tokens", (F.col("s") + n_full).alias("sequence_id"), "offset").withColumn("ids_crc32", F.crc32("ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (array) of every sequence, without padding; a group is one sequence, C tokens at most."""
    rows = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    raw = F.hex(F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"])))
    word = F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))

    def token(i: Column) -> Column:
        byte = [F.substring(F.col("raw"), F.lit(8) * i + 2 * b + 1, F.lit(2)) for b in (3, 2, 1, 0)]
        return F.conv(F.concat(*byte), 16, 10).cast("int")
    return rows.withColumn("raw", raw).select("sequence_id", "length", F.transform(word, token).alias("ids"))
