"""op3, op7, op8, op9, op10 against brute force and the public libraries."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bloom_lm, bpe_fst, crf_quality, license_scan, resync_tokens
from quarry.llm.queries import QUERIES
from quarry.llm.vocabularies import BYTE_RANKS, PATTERN, PIECES

LETTERS = "abcdefgh the  ing\n\t'stremvd012,;!é漢😀<s>▁.　\x1c\x85 "


def odd_texts(n, length, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(LETTERS, k=rnd.randint(0, length))) for _ in range(n)]


# ---------------------------------------------------------------- op10

@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken
    with open(BYTE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    ranks = bpe_fst.read_ranks(BYTE_RANKS)
    return bpe_fst.Encoder(ranks, PATTERN), bpe_fst.Decoder(ranks)


def as_bytes(ids):
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_is_the_library_s(coder, tiktoken_encoding, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = coder[0].encode(text)
    assert ids == as_bytes(tiktoken_encoding.encode_ordinary(text)) and coder[1].decode(ids) == text.encode()


def test_bpe_odd_texts_and_portions(coder, tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe_fst, "PORTION", 40)
    for t in [*odd_texts(1500, 200, 1), "a" * 5000, " " * 300, "x " * 300, "\n" * 50 + "y"]:
        assert coder[0].encode(t) == as_bytes(tiktoken_encoding.encode_ordinary(t))


def test_bpe_small_tables(tiktoken_encoding, monkeypatch):
    """Full tables start afresh without a change of results."""
    monkeypatch.setattr(bpe_fst, "KEPT_STATES", 20)
    monkeypatch.setattr(bpe_fst, "KEPT_CHUNKS", 5)
    encoder = bpe_fst.Encoder(bpe_fst.read_ranks(BYTE_RANKS), PATTERN)
    for t in odd_texts(300, 80, 2):
        assert encoder.encode(t) == as_bytes(tiktoken_encoding.encode_ordinary(t))


def test_bpe_texts_together(coder, tiktoken_encoding, monkeypatch):
    """Texts taken together, in small groups and with tables that start afresh, give what each gives alone."""
    for name, value in (("TOGETHER", 100), ("PORTION", 300), ("KEPT_CHUNKS", 30), ("KEPT_STATES", 500), ("KEPT_PAIRS", 200), ("SLOTS", 10)):
        monkeypatch.setattr(bpe_fst, name, value)
    encoder = bpe_fst.Encoder(bpe_fst.read_ranks(BYTE_RANKS), PATTERN)
    texts = [*odd_texts(200, 150, 4), "", "don't O'Brien's.' naïve, straße!! ab'c", "verüö. cióncociónquejamente%%% " * 40, "漢字" * 300]
    assert encoder.encode_all(texts) == [as_bytes(tiktoken_encoding.encode_ordinary(t)) for t in texts]


def test_bpe_one_long_match_keeps_tables_bounded(tiktoken_encoding, monkeypatch):
    """States are bounded within a match too, and its ids are those of the library."""
    monkeypatch.setattr(bpe_fst, "KEPT_STATES", 500)
    encoder = bpe_fst.Encoder(bpe_fst.read_ranks(BYTE_RANKS), PATTERN)
    most, number = [0], encoder.machine._number

    def watched(*key):
        most[0] = max(most[0], len(encoder.machine.states))
        return number(*key)
    encoder.machine._number = watched
    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyzäß", k=40_000))
    assert encoder.encode(text) == as_bytes(tiktoken_encoding.encode_ordinary(text))
    assert most[0] <= 500 + bpe_fst.STRETCH + 1


def test_may_follow_is_what_the_merges_give(coder):
    machine, rnd = coder[0].machine, random.Random(3)
    tokens = sorted(machine.bytes_of)
    for _ in range(4000):
        a, b = rnd.choice(tokens[:600] if rnd.random() < 0.5 else tokens), rnd.choice(tokens[:600] if rnd.random() < 0.5 else tokens)
        x, y = machine.bytes_of[a], machine.bytes_of[b]
        assert machine.may_follow(a, b) == (machine.merged(x + y) == [x, y])


def test_utf8_machine_passes_whole_characters_only():
    text = "aé漢😀z" * 3
    machine, out = bpe_fst.Utf8Machine(), []
    for byte in text.encode():
        out.append(machine.feed(bytes([byte])))
    assert [o.decode() for o in out if o] == list(text) and machine.end() == b""
    machine = bpe_fst.Utf8Machine()
    assert machine.feed(b"a\xe6\xbc") == b"a" and machine.end() == b"\xe6\xbc"


def test_op10_whole_table(spark, sf, documents, tiktoken_encoding):
    for r in QUERIES["op10_byte_bpe"][0](spark, sf).collect():
        text = documents[r.doc_id].text
        ids = as_bytes(tiktoken_encoding.encode_ordinary(text))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op10_odd_rows(odd, empty, tiktoken_encoding):
    rows = bpe_fst.decode(bpe_fst.encode(odd, BYTE_RANKS, PATTERN), BYTE_RANKS).collect()
    assert len(rows) == odd.count() and rows[0].block == "x"
    for r in rows:
        assert bytes(r.ids) == as_bytes(tiktoken_encoding.encode_ordinary(r.text or "")) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe_fst.encode(empty, BYTE_RANKS, PATTERN, decoded=True).collect() == []


# ---------------------------------------------------------------- op8

@pytest.fixture(scope="module")
def pieces():
    with open(PIECES, "rb") as f:
        return resync_tokens.Pieces(f.read())


def test_stretches_count_as_the_whole_text(pieces):
    assert pieces.stable
    texts = [*odd_texts(4000, 60, 5), "", " ", "  ", "a ", " a", "<s> </s><unk>", "▁ ▁a ▁"]
    assert pieces.counts(texts) == [len(pieces.library.encode(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_counts_of_any_text(pieces, text):
    assert pieces.counts([text]) == [len(pieces.library.encode(text))]


def test_op8_whole_table(spark, sf, documents, pieces):
    for r in QUERIES["op8_token_counts"][0](spark, sf).collect():
        text, n = documents[r.doc_id].text, len(pieces.library.encode(documents[r.doc_id].text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)


def test_op8_chunks_and_failed_alignments(spark, odd, odd_rows, empty, pieces):
    texts = [*odd_texts(12, 3000, 6), "x" * 4000, "▁ " * 900, "q w" * 900, "no blank here" * 3 + "y" * 1500 + " end"]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0])] + [r[:2] for r in odd_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = collections.Counter((d, len((t or "").encode()), len(pieces.library.encode(t or ""))) for d, t in rows)
    got = resync_tokens.count_tokens(df, PIECES, chunk_chars=300, overlap=8).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert resync_tokens.count_tokens(empty, PIECES).collect() == []


# ---------------------------------------------------------------- op7

def brute_model(rows):
    """rows: (id, text, train).  [(id, n_tokens, n_known, N, base, score with exact bigram counts)]."""
    texts = [(i, (t or "").encode().lower().split() + ["END"], train) for i, t, train in rows]
    one, two, n_texts = collections.Counter(), collections.Counter(), 0
    for _, w, train in texts:
        if train:
            one.update(w)
            two.update(zip([0, *w[:-1]], w))
            n_texts += 1
    n, v = sum(one.values()), len(one)
    out = []
    for i, w, _ in texts:
        p0 = [(one[x] + 1) / (n + v + 1) for x in w]
        score = sum(math.log10((two[a, b] + bloom_lm.MU * p) / ((one[a] if a else n_texts) + bloom_lm.MU))
                    for a, b, p in zip([0, *w[:-1]], w, p0))
        out.append((i, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, p0)), score))
    return out


def test_op7_whole_table(spark, sf, documents):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in documents}
    want = {w[0]: w for w in brute_model([(d, r.text, not held[d]) for d, r in documents.items()])}
    base = score = 0.0
    got = QUERIES["op7_lm_scoring"][0](spark, sf).collect()
    assert len(got) == len(documents)
    for r in got:
        _, n, known, total, low, exact = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, total)
        assert r.base_score == pytest.approx(low, rel=1e-9) and r.score == pytest.approx(exact, rel=0.1, abs=1)
        if r.held_out:
            base, score = base + r.base_score, score + r.score
    assert score > 0.95 * base               # log10 probabilities: the model is better on texts it has not seen


def test_op7_both_ways_and_odd_rows(odd, odd_rows, empty):
    train = F.col("doc_id") != 7
    a = collections.Counter(tuple(r) for r in bloom_lm.score(odd, train).collect())
    assert a == collections.Counter(tuple(r) for r in bloom_lm.score(odd, train, max_broadcast_bytes=0).collect())
    want = brute_model([(d, t, d != 7) for d, t, _ in odd_rows])
    assert sorted((str(r[0]), *r[2:5]) for r in a.elements()) == sorted((str(w[0]), *w[1:4]) for w in want)
    assert bloom_lm.score(empty, train).collect() == []


def test_filter_never_loses_and_seldom_adds():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 63, size=20000, dtype=np.uint64))
    counts = rnd.geometric(0.3, size=len(keys)).astype(np.uint64)
    f = bloom_lm.Filter(1, {0: bloom_lm.build_segment(keys, counts)})
    true, got = bloom_lm.levels(counts), f.level_of(keys)
    assert (got >= true).all() and (got > true).mean() < 0.04
    assert (f.level_of(rnd.integers(0, 1 << 63, size=20000, dtype=np.uint64)) > 0).mean() < 0.04


# ---------------------------------------------------------------- op9

def brute_counts(text):
    w = (text or "").encode().split()
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def counts_of(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_op9_whole_table(spark, sf, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op9_quality_rules"][0](spark, sf).collect()
    assert len(rows) == len(documents)
    verdicts = []
    for r in rows:
        assert counts_of(r) == brute_counts(documents[r.doc_id].text)
        assert not (r.kept and r.base_failed)
        if r.doc_id in labels and not r.base_failed:
            verdicts.append(r.kept == bool(labels[r.doc_id]))
    assert np.mean(verdicts) > 0.93


def test_op9_held_out_accuracy(spark):
    """Learns from one half of a larger table, judged on the other."""
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    crf = crf_quality.fit(docs, labels.where("doc_id % 2 = 0"))
    out = crf_quality.label(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), crf).where("not base_failed").collect()
    assert len(out) > 100 and np.mean([r.kept == bool(r.quality) for r in out]) > 0.95
    assert all(len(r.line_labels) == sum(bool(x.encode().split()) for x in r.text.split("\n")) for r in out)


def test_op9_odd_rows(odd, empty):
    out = crf_quality.label(odd, crf_quality.EVERYTHING)
    rows = out.collect()
    assert len(rows) == odd.count() and all(counts_of(r) == brute_counts(r.text) for r in rows)
    assert {r.kept for r in rows} == {False} and rows[0].block == "x"
    assert crf_quality.label(empty, crf_quality.EVERYTHING).collect() == []
    assert crf_quality.train([]).weight.tolist() == crf_quality.EVERYTHING.weight.tolist()


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        crf = crf_quality.Crf(np.zeros(1), rnd.normal(size=(2, 2)))
        score = rnd.normal(size=rnd.integers(1, 9)).tolist()

        def value(path):
            return sum(s for s, p in zip(score, path) if p) + sum(crf.move[a, b] for a, b in zip(path, path[1:]))
        best = max(value([i >> j & 1 for j in range(len(score))]) for i in range(1 << len(score)))
        assert value(crf.viterbi(score)) == pytest.approx(best)


# ---------------------------------------------------------------- op3

def test_op3_rules():
    wrapped = "Copyright (c) 2020 A B\n\n" + license_scan.SENTENCES["mit-grant"][0].replace(" of ", "\nof ") + ":\n\n" \
        + license_scan.SENTENCES["mit-notice"][0] + ".\n" + license_scan.SENTENCES["mit-as-is"][0] + ". More words."
    n, names, found = license_scan.scan_text(wrapped)
    assert (n, names) == (4, ["MIT"]) and found[0]["sentences"] == ["copyright-line", "mit-grant", "mit-notice", "mit-as-is"]
    n, names, found = license_scan.scan_text("a |\nReleased under the MIT Licence.\nx. All rights reserved.\ny")
    assert names == ["All-Rights-Reserved", "MIT"] and [m["start"] for m in found] == [4, 39]
    assert license_scan.scan_text("the license of this") == (0, [], [])
    far = license_scan.SENTENCES["gpl-3.0-free"][0] + "." + " x." * 9 + " " + license_scan.SENTENCES["gpl-no-warranty"][0] + "."
    assert [m["sentences"] for m in license_scan.scan_text(far)[2]] == [["gpl-3.0-free"]]


# Unshortened public notices, as they stand in files.
NOTICES = {
    "Apache-2.0": """# Copyright 2020 A B
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
""",
    "LGPL-2.1-or-later": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Lesser General Public License for more details.
""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.
""",
    "ISC": """ISC License

Copyright (c) 2020, A B

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
""",
    "Zlib": """Copyright (c) 2020 A B

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "BSL-1.0": """// Copyright 2020 A B
// Distributed under the Boost Software License, Version 1.0.
// (See accompanying file LICENSE_1_0.txt or copy at
// http://www.boost.org/LICENSE_1_0.txt)
""",
    "EPL-2.0": """ * This program and the accompanying materials are made
 * available under the terms of the Eclipse Public License 2.0
 * which is available at https://www.eclipse.org/legal/epl-2.0/
""",
    "EPL-1.0": """ * All rights reserved. This program and the accompanying materials
 * are made available under the terms of the Eclipse Public License v1.0
 * which accompanies this distribution, and is available at
 * http://www.eclipse.org/legal/epl-v10.html
""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring
rights to this software to the public domain worldwide. This software is distributed without any warranty.

You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see
<http://creativecommons.org/publicdomain/zero/1.0/>.
""",
}


@pytest.mark.parametrize("name", NOTICES)
def test_op3_public_notices(name):
    assert license_scan.scan_text(NOTICES[name])[1] == [name]


def test_op3_apache_header_whole():
    asf = NOTICES["Apache-2.0"].replace('Licensed under the', 'The ASF licenses this file to You under the')
    for text in (NOTICES["Apache-2.0"], asf):
        (match,) = license_scan.scan_text(text)[2]
        assert match["sentences"] == ["copyright-line", "apache-2.0-ref", "apache-2.0-comply", "apache-2.0-obtain", "apache-2.0-as-is"]


def test_op3_boost_full_text():
    text = "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + license_scan.SENTENCES["bsl-1.0-grant"][0].replace(" of ", "\nof ") + ":\n"
    assert license_scan.scan_text(text)[1] == ["BSL-1.0"]


def test_op3_narrow_column():
    """A word a line: only the words of the longest known sentence bound the search."""
    text = "\n".join((license_scan.SENTENCES["mit-grant"][0] + ":\n" + license_scan.SENTENCES["mit-notice"][0] + ".").split())
    assert license_scan.scan_text(text)[1] == ["MIT"]


def test_op3_spdx():
    def names(text):
        return license_scan.scan_text(text)[1]
    assert names("// SPDX-License-Identifier: apache-2.0\nint x;") == ["Apache-2.0"]
    assert names("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */") == ["Apache-2.0", "BSD-3-Clause", "MIT"]
    assert names("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0") == ["GPL-2.0-only"]
    assert names("<!-- SPDX-License-Identifier: 0BSD -->") == ["0BSD"] and names("SPDX-License-Identifier:") == []
    (match,) = license_scan.scan_text("a b. SPDX-License-Identifier: MIT is here")[2]
    assert (match["sentences"], match["start"], match["stop"]) == (["spdx:MIT"], 5, 33)
    assert names("SPDX-License-Identifier: MIT\nReleased under the MIT License.") == ["MIT"]


def test_op3_whole_table(spark, documents):
    where = "/root/testdata/sf0.01"
    marks = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
             "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
             "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "All-Rights-Reserved": "All rights reserved."}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    got = {r.doc_id: r.licenses for r in QUERIES["op3_license_scan"][0](spark, where).collect()}
    assert got == {d: ",".join(sorted(k for k, v in marks.items() if v in t)) for d, t in texts.items()} and any(got.values())


def test_op3_odd_rows(odd, empty):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == odd.count() and {r.n_sentences for r in rows} == {0} and rows[0].block == "x"
    assert license_scan.scan(empty).collect() == []
