"""Byte-level BPE as a lazily determinised transducer, and decoding through an incremental UTF-8 machine.

Encoding.  A split of bytes into tokens is the one that the merges give exactly when every two
neighbouring tokens are what the merges give for the two alone; so "which tokens may follow token t"
compiles the merges into a finite-state machine.  A hypothesis is (last token, place in the token trie).
Reading a byte moves each hypothesis down the trie and, where a token ends that may follow the last one,
opens a hypothesis at the root.  The set of hypotheses is one state of the determinised machine.  What was
read has one split, so just one hypothesis is at the root, and its last token is the state's output: from
the end of a match, outputs lead back token by token.  Long matches emit at every stretch the tokens common
to all hypotheses.  States and transitions are made when first met and kept in a bounded table.

Texts are cut first by the pre-tokeniser's pattern.  A single blank between two characters that are no
white space always begins a match of that pattern, so a text splits there into independent chunks, and
the ids of short chunks are kept in a bounded table.

Decoding maps ids to bytes; the UTF-8 machine passes on whole characters and keeps the bytes of an
unfinished one until the next tokens.

Defined results: null and empty texts give no ids and empty bytes; every row of the input gives a row;
other columns pass through unread, but ``ids``, ``n_tokens`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.worker import give_back, once

PORTION = 1 << 20            # characters of a text handled at once
CHUNK_KEPT = 48              # longest chunk whose ids are kept
KEPT_CHUNKS = 100_000        # and as many older ones
KEPT_STATES = 250_000
KEPT_PAIRS = 300_000
SLOTS = 20                   # binary logarithm of the slots for transitions, at most three quarters of them in use
TOGETHER = 1 << 18           # bytes of the short matches that move on together
SHORT = 64                   # longest of them
STRETCH = 1 << 12            # bytes of a match, or ids, between two looks at what is settled
ROOT = 0
_PLACE = (1 << 24) - 1

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s | \s|^ | $")
# letters, and marks behind them but no apostrophe: the pattern's matches of such a chunk are the two groups
_PLAIN = re.compile("( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Hypotheses are packed as ``last token + 1 << 24 | trie place``, states numbered in steps of 256."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.trie: dict[int, int] = {}               # place << 8 | byte: the next place
        self.ends: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                after = self.trie.get(node << 8 | byte)
                if after is None:
                    after = self.trie[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.ends[node] = rank
        if len(self.ends) > _PLACE:
            raise ValueError("the vocabulary is too large")
        self.inner = bytearray(len(self.ends))        # places that tokens go on from
        for key in self.trie:
            self.inner[key >> 8] = 1
        self.lengths = np.zeros(max(self.bytes_of, default=0) + 1, dtype=np.int64)
        self.lengths[list(self.size)] = list(self.size.values())
        self._follows: dict[int, bool] = {}
        self._seams: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.forget()

    def forget(self, key: bytes = b"") -> int:
        """Drop all states but the first and the one of ``key``, which gets a new number."""
        first = array("Q", [ROOT]).tobytes()
        self.numbers = {first: 0}
        self.states = [first]
        self.last = array("i", [-1])                  # by state: the token that ends what was read
        self.steps: dict[int, int] = {}               # state | byte: the next state; of matches that go alone
        self.slots = np.full((2, 1 << SLOTS), -1, dtype=np.int32)     # the same, of matches that go together
        self.used = 0
        return self._number(key, array("Q", key)[-1]) if key else 0

    def _number(self, key: bytes, ended: int) -> int:
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states) << 8
            self.states.append(key)
            self.last.append((ended >> 24) - 1)
        return number

    def merged(self, data: bytes, keep: int = 1) -> list[bytes]:
        """The merges applied one by one, lowest rank first, until none applies or ``keep`` parts are left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > keep:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of a token before its last merge."""
        parts = self.merged(token, keep=2)
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def seam(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """Parts that stand at a token's right (left) edge while it is built, each with the rank of the
        merge that ends it; the token itself is never ended."""
        known = self._seams.get((token, right))
        if known is None:
            part, ended, known = self.bytes_of[token], 1 << 60, []
            while True:
                known.append((part, ended))
                halves = self._split(part) if len(part) > 1 else None
                if halves is None:
                    break
                ended = self.ranks[part]
                part = halves[1] if right else halves[0]
            self._seams[token, right] = known
        return known

    def may_follow(self, last: int, token: int) -> bool:
        """Whether the merges of both tokens' bytes give [last, token]: no part at the right edge of the one
        and part at the left edge of the other merge while both stand (of equal ranks, the left goes first)."""
        known = self._follows.get(last + 1 << 24 | token)
        if known is None:
            if last < 0:
                known = self.merged(self.bytes_of[token]) == [self.bytes_of[token]]
            else:
                rank_of, left, known = self.ranks.get, self.seam(token, False), True
                for x, x_ends in self.seam(last, True):
                    for y, y_ends in left:
                        rank = rank_of(x + y)
                        if rank is not None and rank < x_ends and rank <= y_ends:
                            known = False
                            break
                    if not known:
                        break
            if len(self._follows) > KEPT_PAIRS:
                self._follows.clear()
            self._follows[last + 1 << 24 | token] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte; the one hypothesis at the trie's root stands last in it."""
        alive, ended = array("Q"), 0
        trie, ends, inner, follows = self.trie, self.ends, self.inner, self._follows
        for h in array("Q", self.states[state >> 8]):
            after = trie.get((h & _PLACE) << 8 | byte)
            if after is None:
                continue
            base = h & ~_PLACE
            token = ends[after]
            if token >= 0:
                may = follows.get(base | token)
                if may or (may is None and self.may_follow((h >> 24) - 1, token)):
                    ended = token + 1 << 24
            if inner[after]:
                alive.append(base | after)
        alive.append(ended)
        return self._number(alive.tobytes(), ended)

    def _walk(self, data: bytes, state: int) -> list[int]:
        """The states met on reading ``data``."""
        steps, out = self.steps, []
        if len(steps) > KEPT_STATES:
            steps.clear()
        for byte in data:
            after = steps.get(state | byte)
            if after is None:
                after = steps[state | byte] = self._step(state, byte)
            state = after
            out.append(state)
        return out

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The next states for many ``state | byte``, by open addressing."""
        known, value = self.slots
        last = len(known) - 1
        at = keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> 32 & last
        out = value[at]
        open_ = np.flatnonzero(known[at] != keys)
        new = []
        while len(open_):
            place = at[open_]
            free = known[place] < 0
            new.append(open_[free])
            open_, place = open_[~free], place[~free] + 1 & last
            at[open_] = place
            out[open_] = value[place]
            open_ = open_[known[place] != keys[open_]]
        missing = np.concatenate(new) if new else np.zeros(0, np.int64)
        if len(missing):
            lacks, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
            after = []
            for key, to in zip(lacks.tolist(), at[missing[first]].tolist()):
                after.append(self._step(key & ~255, key & 255))
                while known[to] >= 0:                  # a new one may have taken the place
                    to = to + 1 & last
                known[to], value[to] = key, after[-1]
            self.used += len(after)
            out[missing] = np.array(after, dtype=np.int32)[which]
        return out

    def run_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many matches, little-endian unsigned 32-bit; short ones are read together, a byte of each at a time."""
        out = [b""] * len(words)
        group, size = [], 0
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None or len(word) > SHORT:
                out[i] = _packed([whole] if whole is not None else self.run(word))
                continue
            if size + len(word) > TOGETHER:
                self._together(words, group, out)
                group, size = [], 0
            group.append(i)
            size += len(word)
        self._together(words, group, out)
        return out

    def _together(self, words: list[bytes], group: list[int], out: list[bytes]) -> None:
        if len(self.states) > KEPT_STATES or 2 * self.used > len(self.slots[0]):
            self.forget()
        group = sorted((i for i in group if words[i]), key=lambda i: -len(words[i]))
        if not group:
            return
        data = np.frombuffer(b"".join([words[i] for i in group]), dtype=np.uint8)
        size = np.array([len(words[i]) for i in group])
        begin = np.cumsum(size) - size
        state, met = np.zeros(len(group), np.int64), np.zeros((int(size[0]), len(group)), np.int32)
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t))        # so many are longer than t
            state = self._next(state[:n] | data[begin[:n] + t]).astype(np.int64)
            met[t, :n] = state
        last, at, who, tokens = np.frombuffer(self.last, dtype=np.int32), size, [], []
        live = np.arange(len(group))
        while len(live):                               # outputs lead back from the ends
            token = last[met[at - 1, live] >> 8]
            who.append(live)
            tokens.append(token)
            at = at - self.lengths[token]
            live, at = live[at > 0], at[at > 0]
        del last                                       # an array with a view can't grow
        who, tokens = np.concatenate(who[::-1]), np.concatenate(tokens[::-1])
        raw = tokens[np.argsort(who, kind="stable")].astype("<u4").tobytes()
        to = (np.cumsum(np.bincount(who, minlength=len(group))) * 4).tolist()
        for i, a, b in zip(group, [0, *to], to):
            out[i] = raw[a:b]

    def run(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > STRETCH:
            return self._long(data)
        met, last, size, out = self._walk(data, 0), self.last, self.size, []
        at = len(data)
        while at:
            token = last[met[at - 1] >> 8]
            out.append(token)
            at -= size[token]
        out.reverse()
        if len(self.states) > KEPT_STATES:
            self.forget()
        return out

    def _long(self, data: bytes) -> list[int]:
        """As ``run``, a stretch at a time: tokens that no hypothesis doubts are emitted, the rest is held."""
        out, held, state = [], [], 0                  # held: the token that ends at each byte not yet emitted
        for at in range(0, len(data), STRETCH):
            met = self._walk(data[at:at + STRETCH], state)
            held += [self.last[m >> 8] for m in met]
            key = self.states[met[-1] >> 8]
            state = self.forget(key) if len(self.states) > KEPT_STATES else met[-1]
            begun = {len(held) - self.depth[h & _PLACE] for h in array("Q", key)} if at + STRETCH < len(data) else {len(held)}
            while len(begun) > 1:                     # back to where all hypotheses agree
                furthest = max(begun)
                begun.remove(furthest)
                begun.add(furthest - self.size[held[furthest - 1]])
            agreed = to = begun.pop()
            tokens = []
            while to:
                tokens.append(held[to - 1])
                to -= self.size[held[to - 1]]
            out += reversed(tokens)
            del held[:agreed]
        return out


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Kept(dict):
    """Ids of chunks; long chunks are not kept, and a full table becomes the old one, whose used entries move over."""

    def __init__(self, chunk):
        super().__init__()
        self.chunk = chunk
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.chunk(" " + word)
        if len(word) < CHUNK_KEPT:
            self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > KEPT_CHUNKS:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of texts.  ``kept`` maps a chunk without its leading blank to the chunk's ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.machine = Transducer(ranks)
        self.matches = regex.compile(pattern).findall
        self.kept = _Kept(self.chunk)

    def parts(self, chunk: str) -> list[str]:
        """The matches of a chunk."""
        plain = _PLAIN(chunk)
        return [part for part in plain.groups() if part] if plain else self.matches(chunk)

    def chunk(self, chunk: str) -> bytes:
        parts = self.parts(chunk)
        if len(parts) < 16:
            return b"".join([_packed(self.machine.run(part.encode())) for part in parts])
        found = self.found(dict.fromkeys(parts))
        return b"".join(map(found.__getitem__, parts))

    def found(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids of matches."""
        parts = list(parts)
        return dict(zip(parts, self.machine.run_all([part.encode() for part in parts])))

    def fill(self, words: set[str]) -> None:
        """Chunks that are not kept yet are encoded together and kept."""
        kept = self.kept
        kept.turn()
        new = []
        for word in words - kept.keys():
            ids = kept.old.get(word)
            if ids is not None:
                kept[word] = ids
            elif len(word) < CHUNK_KEPT:
                new.append(word)
        parts = [self.parts(" " + w) for w in new]
        found = self.found({part for some in parts for part in some})
        for word, some in zip(new, parts):
            kept[word] = found[some[0]] if len(some) == 1 else b"".join(map(found.__getitem__, some))

    def together(self, texts: list[str], cut: bool = False) -> list[bytes]:
        """Ids of texts; ``cut``: the texts stood behind the blank of a chunk."""
        chunks = [_CUT.split(t) if _ODD.search(t) else t.split(" ") for t in texts]
        at = 0 if cut else 1
        self.fill(set().union(*(c[at:] for c in chunks)))
        return [b"".join([*map(self.chunk, c[:at]), *map(self.kept.__getitem__, c[at:])]) for c in chunks]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, little-endian unsigned 32-bit."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, min(len(text), at + PORTION)) if len(text) > PORTION else None
            to = cut.start() if cut else len(text)
            out += self.together([text[at:to]]) if not at else self.together([text[at + 1:to]], cut=True)
            at = to
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; short texts are taken together."""
        out, group, size = [], [], 0
        for text in texts:
            if group and size + len(text) > PORTION:
                out += self.together(group)
                group, size = [], 0
            if len(text) > PORTION:
                out.append(self.encode(text))
            else:
                group.append(text)
                size += len(text)
        return out + (self.together(group) if group else [])


class Utf8Machine:
    """Incremental UTF-8: whole characters leave at once, an unfinished one waits.

    A byte that can't continue or begin a character leaves as it is, so no byte is lost."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def wanted(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        back = 1
        while back <= min(3, len(data)) and 0x80 <= data[-back] < 0xC0:
            back += 1
        if back <= len(data) and self.wanted(data[-back]) > back:
            self.held = data[-back:]
            return data[:-back]
        self.held = b""
        return data

    def end(self) -> bytes:
        out, self.held = self.held, b""
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.table = {r: t for t, r in ranks.items()}

    def stream(self, ids: np.ndarray) -> Iterator[bytes]:
        """Bytes of whole characters, a stretch of tokens at a time; what is unfinished at the end comes last."""
        machine = Utf8Machine()
        for at in range(0, len(ids), STRETCH):
            yield machine.feed(b"".join(map(self.table.__getitem__, ids[at:at + STRETCH].tolist())))
        yield machine.end()

    def decode(self, raw: bytes) -> bytes:
        return b"".join(self.stream(np.frombuffer(raw, dtype="<u4")))


def _once(kind, key: int, *args):
    """One encoder and one decoder per Python worker and vocabulary."""
    return once("bpe_fst", (kind, key), lambda: kind(*args))


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``docs`` with ids (binary, little-endian uint32) and n_tokens; ``decoded``: and the bytes of the ids."""
    ranks = read_ranks(ranks_path)
    if set(map(bytes, zip(range(256)))) - set(ranks):
        raise ValueError("a byte-level vocabulary has a token for every byte")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)      # a vocabulary file: fixed size
    key = hash((len(ranks), pattern, ranks_path))
    docs = docs.drop("ids", "n_tokens", "decoded")
    more = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] \
        + [T.StructField("decoded", T.BinaryType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(Encoder, key, shared.value, pattern)
        decoder = _once(Decoder, key, shared.value) if decoded else None
        for batch in batches:
            for part in _portions(batch):
                ids = encoder.encode_all([t or "" for t in part.column("text").to_pylist()])
                cols = [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
                if decoder:
                    cols.append(pa.array([decoder.decode(i) for i in ids], pa.binary()))
                yield pa.record_batch(part.columns + cols, names=part.schema.names + [f.name for f in more])
            pa.default_memory_pool().release_unused()
        give_back()
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def decode(rows: DataFrame, ranks_path: str) -> DataFrame:
    """``rows`` (with ``ids``) and a column decoded (binary)."""
    ranks = read_ranks(ranks_path)
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    key = hash((len(ranks), ranks_path))
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(Decoder, key, shared.value)
        for batch in batches:
            for part in _portions(batch):
                out = pa.array([decoder.decode(i.as_py() or b"") for i in part.column("ids")], pa.binary())
                yield pa.record_batch([*part.columns, out], names=[*part.schema.names, "decoded"])
            pa.default_memory_pool().release_unused()
        give_back()
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def _portions(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
