"""Fill-in-the-middle, periodic runs and packing against brute force and the public tokenizer library."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from unittest import mock

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import fill_in_middle, harmonic_packing, periodic_runs
from quarry.llm.queries import OP11_SQL, QUERIES, with_planted_runs
from quarry.llm.vocabularies import WORDS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---- op11

def fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_query_is_its_sql(spark, sf):
    got = {tuple(r) for r in QUERIES["op11_fill_in_middle"][0](spark, sf).collect()}
    want = duckdb.connect().sql(OP11_SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    assert got == set(want) and len(want) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_fim_odd_rows(spark, odd, odd_rows, empty):
    rng = random.Random(3)
    long = ["".join(rng.choice("ab \n\né☃\U0001f600") for _ in range(rng.choice((50, 3000, 20_000)))) for _ in range(30)]
    texts = long + ["\n", "\n\n\n", "x" * 5000 + "\n", "a<S>b\nc", "<P", "a<\nb<S\nP>c", "é" * 2048 + "\n" + "y" * 2047 + "\n"]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own"))
    out = fill_in_middle.transform(docs).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    got = {r.doc_id: r for r in out.collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim(i, t)
        assert r.back == t
    out = fill_in_middle.transform(odd)
    assert set(odd.columns) < set(out.columns)
    assert sorted(map(repr, ((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()))) == \
        sorted(repr(fim(r[0], r[1])) for r in odd_rows)
    assert fill_in_middle.transform(empty).count() == 0


# ---- op12

def brute_runs(w, shortest=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q) and j > i:
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def odd_sequences(rng):
    out = [[], [1], [1] * 11, [1] * 12, [1] * 500, [1, 2] * 6, [1, 2] * 6 + [1], [1, 2, 3] * 4, list(range(300)) * 2,
           (list(range(40)) * 3 + [7]) * 3, [1] * 30 + [2] + [1] * 30 + [2] + [1] * 30]
    a, b = [1], [1, 2]
    while len(b) < 600:
        a, b = b, b + a                                          # Fibonacci word: many runs
    out.append(b)
    out.append([bin(i).count("1") & 1 for i in range(512)])      # Thue-Morse word
    for _ in range(150):
        base = [rng.randrange(rng.choice((2, 3, 5, 50))) for _ in range(rng.randrange(1, 40))]
        out.append([rng.randrange(4) for _ in range(rng.randrange(30))] + (base * rng.randrange(1, 12))[:rng.randrange(1, 400)] + base[:5])
    return out


def test_runs_against_brute_force():
    seqs = odd_sequences(random.Random(5))
    first = np.cumsum([0] + [len(s) for s in seqs])
    words = np.array([x for s in seqs for x in s], dtype=np.uint64)
    got = defaultdict(list)
    for d, s, n, q in periodic_runs.find_runs(words, first).tolist():
        got[d].append((s, n, q))
    for d, s in enumerate(seqs):
        assert got[d] == brute_runs(s), s


def test_runs_query(spark, sf, documents):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"][0](spark, sf).collect()}
    assert got.keys() == documents.keys()
    n_planted = 0
    for i, d in documents.items():
        w = WORD.findall(d.text or "")
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and w:
            n_planted += 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute_runs(w) if len(w) < 3000 else None
        r = got[i]
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(collapsed(w, runs))
    assert n_planted


def test_runs_odd_rows(spark, odd, odd_rows, empty):
    out = periodic_runs.runs_of(odd)
    assert set(odd.columns) < set(out.columns)
    got = sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in out.collect())
    want = []
    for i, t, _ in odd_rows:
        w = WORD.findall(t or "")
        runs = [(0, 30_000, 5)] if len(w) == 30_000 else brute_runs(w)
        want.append(repr((i, len(w), runs, collapsed(w, runs))))
    assert got == sorted(want)
    assert periodic_runs.runs_of(empty).count() == 0 and with_planted_runs(empty).count() == 0
    assert with_planted_runs(odd).count() == len(odd_rows)


# ---- op13

def packed_right(rows, texts, capacity=4096):
    """Checks the contract of packed rows (with ids) against the library; gives the padding."""
    lib = Tokenizer.from_file(WORDS)
    want = defaultdict(int)
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, np.array(ids, dtype="<u4").tobytes()] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0 and r.ids_crc32 == zlib.crc32(r.ids)
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        starts = defaultdict(list)
        for r in pieces:
            starts[r.start].append(r)
        copies = sum(n for (i, ids), n in want.items() if i == key[0] and len(ids) == 4 * key[1])
        assert sum(r.length for r in pieces) == key[1] * copies
        if copies == 1:
            assert want[key[0], b"".join(r.ids for r in pieces)] == 1
            assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
    padding = 0
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sum(r.length for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    return padding


def test_packing(spark, sf, documents):
    rows = harmonic_packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), WORDS).collect()
    padding = packed_right(rows, [(i, d.text) for i, d in documents.items()])
    assert padding < 0.05 * sum(r.length for r in rows)
    again = QUERIES["op13_harmonic_packing"][0](spark, sf)
    assert sum(r.length for r in again.collect()) == sum(r.length for r in rows) and "ids" not in again.columns


def test_packing_odd_rows(spark, odd, odd_rows, empty):
    for capacity in (16, 4096):
        rows = harmonic_packing.pack(odd, WORDS, capacity=capacity).collect()
        packed_right(rows, [(r[0], r[1]) for r in odd_rows], capacity)
    assert harmonic_packing.pack(empty, WORDS).count() == 0
    assert harmonic_packing.sequences(harmonic_packing.pack(odd, WORDS)).agg(F.sum("length")).first()[0] == \
        harmonic_packing.pack(odd, WORDS).agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("capacity", [16, 100, 4096])
def test_cuts(capacity):
    for n in range(1, 3 * capacity):
        assert sum(harmonic_packing.cuts(n, capacity)) == n and min(harmonic_packing.cuts(n, capacity)) > 0


def test_tokens_of_splits_words_and_added_tokens():
    """Latin texts by splits, others by words, full tables and texts with added tokens: the ids of the library."""
    with open(WORDS, encoding="utf-8") as f:
        tokens = harmonic_packing.Tokens(f.read())
    rng = random.Random(3)
    parts = ["'", "s", "S", "'ll", "RE", "<|endoftext|>", "<|EndOfText|>", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "À", "ö", "ı", "İ", "ſ",
             "ß", "×", "é", "Σ", "٣", "½", "1", "!", "_", "</w>", "😀", "\x00", "word", "x" * 60]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)]
    texts += ["".join(rng.choices(parts[:5] + parts[7:12] + parts[14:17], k=rng.randint(0, 12))) for _ in range(4000)]
    with mock.patch.object(harmonic_packing, "KEPT", 500):
        made = [ids for at in range(0, len(texts), 40) for ids in tokens.texts(texts[at:at + 40])]
    wanted = [e.ids for e in tokens.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in made] == wanted
    assert len(tokens.splits) <= 500 and len(tokens.words) <= 500


def test_packing_keeps_one_tokenizer_a_worker(spark, sf):
    """Later tasks and queries find the worker's tokenizer; none is made again or left beside it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(64).repartition(16)

    def alive(batches):
        import gc
        import os
        import time
        time.sleep(0.3)
        gc.disable()
        made = [id(o) for o in gc.get_objects() if type(o).__name__ == "Tokens"]
        gc.enable()
        for _ in batches:
            yield pa.record_batch([pa.array([os.getpid()]), pa.array([made], pa.list_(pa.int64()))], names=["pid", "made"])

    def seen():
        found = defaultdict(set)
        for r in spark.range(0, 16, 1, 16).mapInArrow(alive, "pid long, made array<long>").collect():
            found[r.pid].add(tuple(sorted(r.made)))
        return found

    harmonic_packing.tokenised(docs, WORDS).agg(F.sum("length")).collect()
    before = seen()
    harmonic_packing.tokenised(docs, WORDS).agg(F.sum("length")).collect()
    after = seen()
    assert any(made != {()} for made in before.values())
    for pid, made in after.items():
        assert len(made) == 1 and len(*made) <= 1
        assert before.get(pid, {()}) in ({()}, made)


def test_splits_are_those_of_the_tokenizers_pattern():
    """Bounds found on bytes against the pattern as a regular expression; the table keeps apart what shares a slot or
    a hash, and the library sees a split that is kept once only."""
    letters = "A-Za-zÀ-ÖØ-öø-įı-ſ"
    pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^ \t-\r{letters}0-9]+")
    rng = random.Random(7)
    parts = ["'", "''", "'s", "'t", "'re", "'r", "'ve", "'m", "'ll", "'l", "'d", "s", "é", "ſ", "1", "22", "!", "_", "\x00", "\x1c", " ", "\n", "y" * 22]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(3000)]
    for text in texts:
        raw = text.encode()
        start, end = harmonic_packing.find_splits(np.frombuffer(raw + b" ", dtype=np.uint8))
        assert [raw[a:b].decode() for a, b in zip(start, end)] == pattern.findall(text)
    asked = []

    def encode(splits):
        asked.extend(splits)
        ids = [np.frombuffer(s.encode("utf-32-le"), dtype="<u4") for s in splits]
        return np.concatenate(ids), np.array([len(i) for i in ids])
    wanted = ["".join(pattern.findall(t)).encode("utf-32-le") for t in texts]
    with mock.patch.object(harmonic_packing, "SLOTS", 1 << 14):
        for hashes in (harmonic_packing._hashes, lambda keys: keys[2] >> np.uint64(56)):
            asked.clear()
            with mock.patch.object(harmonic_packing, "_hashes", hashes):
                splits = harmonic_packing.Splits(encode)
                for _ in range(2):
                    assert [ids for at in range(0, len(texts), 100) for ids in splits.texts(texts[at:at + 100])] == wanted
            short = [s for s in asked if len(s.encode()) <= harmonic_packing.KEY_BYTES]
            assert len(short) == len(set(short)) == len(splits)
