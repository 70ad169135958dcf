"""op4, op5, op6 against brute force."""

import collections
import gc
import hashlib
import itertools
import random
import tracemalloc
import weakref
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import components as star_steps
from quarry.llm import line_dedup, sigtree_join, substring_dedup, textvec, worker
from quarry.llm.components import EDGE, connected_components
from quarry.llm.queries import QUERIES
from quarry.session import cut_lineage


def words(text):
    return (text or "").encode().split()


# ---------------------------------------------------------------- op6

def brute_repeats(rows, k):
    """[(doc_id, n_words, n_removed, kept)] by definition."""
    seen = collections.Counter(tuple(words(t)[i:i + k]) for _, t in rows for i in range(len(words(t)) - k + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for j in range(i, i + k)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_op6_whole_table(spark, sf, documents):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_substring_dedup"][0](spark, sf).collect()}
    want = {(d, n, m, hashlib.sha256(k.encode()).hexdigest())
            for d, n, m, k in brute_repeats([(d, r.text) for d, r in documents.items()], 35)}
    assert got == want and sum(m for _, _, m, _ in got) > 0


@pytest.mark.parametrize("k", [1, 3, 35])
def test_op6_odd_rows(odd, odd_rows, k):
    got = collections.Counter((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), r.kept_text)
                              for r in substring_dedup.remove_repeats(odd, k).collect())
    assert got == collections.Counter(brute_repeats([r[:2] for r in odd_rows], k))


def test_op6_empty_table(empty):
    assert substring_dedup.remove_repeats(empty).collect() == []


# ---------------------------------------------------------------- op5

def brute_components(rows, n, p, q):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def components(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_op5_whole_table(spark, sf, documents):
    rows = [(d, r.text) for d, r in documents.items()]
    got = components(QUERIES["op5_ngram_jaccard_join"][0](spark, sf))
    assert got == brute_components(rows, 3, 90, 100)


def test_op5_odd_rows(odd, odd_rows):
    assert components(sigtree_join.jaccard_components(odd)) == brute_components([r[:2] for r in odd_rows], 3, 90, 100)


def test_op5_empty_table(empty):
    assert sigtree_join.jaccard_components(empty).collect() == []


def near_copies(n, size, seed):
    """Groups of near copies whose similarity lies on both sides of the threshold."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, size))]
        for _ in range(6):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "p", "q"), [(3, 90, 100), (5, 80, 100), (1, 1, 2)])
def test_op5_near_copies(spark, n, p, q):
    rows = near_copies(25, 120, n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components(sigtree_join.jaccard_components(df, n, p, q)) == brute_components(rows, n, p, q)


def test_op5_blocks_of_a_large_group(spark, monkeypatch):
    """A group larger than a block: trees of several blocks meet."""
    monkeypatch.setattr(sigtree_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(sigtree_join, "BROADCAST_BYTES", 0)
    rows = near_copies(3, 80, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components(sigtree_join.jaccard_components(df)) == brute_components(rows, 3, 90, 100)


def test_signature_tree_prunes_and_loses_nothing():
    rnd = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = np.unique(rnd.integers(0, 1 << 63, size=200, dtype=np.uint64))
        for _ in range(3):
            keep = rnd.random(len(base)) > rnd.choice([0.01, 0.04])
            sets.append(np.unique(np.concatenate([base[keep], rnd.integers(0, 1 << 63, size=4, dtype=np.uint64)])))
    tree = sigtree_join.Tree(sets, list(range(len(sets))), sigtree_join.bitmap_bits(200))
    forest = sigtree_join.Forest()
    compared = []
    original = sigtree_join.linked
    try:
        sigtree_join.linked = lambda *a: compared.append(1) or original(*a)
        links = list(sigtree_join.dual_traversal(tree, tree, 90, 100, forest))
    finally:
        sigtree_join.linked = original
    want = sigtree_join.Forest()
    for i, j in itertools.combinations(range(len(sets)), 2):
        if original(sets[i], sets[j], 90, 100):
            want.join(i, j)
    assert [forest.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]
    assert links and len(compared) < 400          # of 7140 pairs


def test_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text), (1, text), (2, text + " more"), (None, text), (5, "other words here entirely now"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in sigtree_join.one_of_each_group(df).collect() if r.doc_id)
    assert [d for d, _ in got] == [1, 5, 6, 7]


def test_connected_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(150)] \
        + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    forest = sigtree_join.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {(x, forest.find(x)) for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_do_not_share_the_tasks_that_make_the_edges(spark, monkeypatch):
    """Two Python steps in one task hold two workers a core, which stay."""
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(star_steps, "cut_lineage", cut)
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4)], EDGE).mapInArrow(lambda batches: batches, EDGE)
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert sum("InArrow" in p for p in plans) == 2 and max(p.count("InArrow") for p in plans) == 1


def test_other_operators_tables_leave_the_worker():
    made = []
    make = lambda: made.append(0) or object()
    worker.drop()
    first = worker.once("bpe_fst", "encoder", make)
    worker.once("bpe_fst", "decoder", make)
    assert worker.once("bpe_fst", "encoder", make) is first and len(made) == 2
    assert len(list(textvec.parts(iter([pa.record_batch([pa.array(["x"])], names=["text"])])))) == 1
    assert worker.once("bpe_fst", "encoder", make) is not first
    worker.once("harmonic_packing", 1, make)
    worker.once("bpe_fst", "decoder", make)
    assert len(made) == 5
    worker.drop()


# ---------------------------------------------------------------- op4

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, min_words, similarity):
    """(doc_id, n_lines, n_removed, cleaned text) by definition; SimHashes from the operator."""
    occurrences = collections.defaultdict(list)
    for d, t in rows:
        key = (d is None, d if d is not None else 0)
        for i, line in enumerate((t or "").split("\n")):
            if len(words(line)) >= min_words:
                occurrences[b" ".join(line.encode().lower().split()).decode()].append((key, t, i))
    lines = list(occurrences)
    found = list(line_dedup.lines_of(pa.array(lines, pa.string()), min_words))
    sims = np.concatenate([f[3] for f in found]) if found else np.zeros(0, np.uint64)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(lines)):
        for j in np.flatnonzero(np.bitwise_count(sims[i + 1:] ^ sims[i]) <= line_dedup.MOST_BITS) + i + 1:
            a, b = lines[i], lines[j]
            if levenshtein(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i, line in enumerate(lines):
        groups[find(i)] += occurrences[line]
    gone = collections.defaultdict(set)
    for group in groups.values():
        first = min(group, key=lambda o: (o[0], o[2]))
        for key, t, i in group:
            if (key, t, i) != first:
                gone[key, t].add(i)
    out = []
    for d, t in rows:
        dead = gone[(d is None, d if d is not None else 0), t]
        cleaned = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in dead)
        out.append((d, 0 if t is None else len(t.split("\n")), len(dead), cleaned))
    return collections.Counter(out)


def test_op4_whole_table(spark, sf, documents):
    got = collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in QUERIES["op4_line_dedup"][0](spark, sf).collect())
    want = brute_lines([(d, r.text) for d, r in sorted(documents.items())], 4, 0.8)
    assert got == collections.Counter({(d, n, m, hashlib.sha256(t.encode()).hexdigest()): c for (d, n, m, t), c in want.items()})
    assert sum(m for _, _, m, _ in got) > 0


def test_op4_odd_rows(odd, odd_rows):
    out = line_dedup.dedup_lines(odd, min_words=2)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    got = collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in out.collect())
    assert got == brute_lines([r[:2] for r in odd_rows], 2, 0.8)


def test_op4_near_lines(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base + "\nshort line\n" + base.upper()), (2, base.replace("word59", "word58")), (3, "quite another line of words\n\n\nx")]
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, base + "\nshort line") and got[3] == (0, rows[2][1])
    want = brute_lines(rows, 4, 0.8)
    assert {(d, m, t) for d, _n, m, t in want} == {(d, m, t) for d, (m, t) in got.items()}


def test_op4_equal_short_lines(spark):
    """Lines of under four words go when equal to an earlier one, and link to no other."""
    rows = [(1, "All rights reserved.\nmenu\n\none two threes"), (2, "all  RIGHTS reserved.\nMenu\n\none two three"), (3, "menu"), (None, "menu\nx")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup_lines(frame, min_words=4, exact_words=1).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "\none two three"), 3: (1, ""), None: (1, "x")}
    assert {r.n_removed for r in line_dedup.dedup_lines(frame, min_words=4).collect()} == {0}
    stage = corpus_pipeline.dedup_lines(spark, frame.withColumn("n_chars", F.lit(7).cast("bigint")), "")
    assert {r.doc_id: (r.text, r.n_chars) for r in stage.collect()} == {1: (rows[0][1], 7), 2: ("\none two three", 14), None: ("x", 1)}


def test_op4_blocks_miss_no_pair():
    """Pigeonhole: whatever three bits differ, a pair of blocks agrees."""
    widths = [(s, (1 << w) - 1) for s, w in line_dedup.BLOCKS]
    assert sum(w for _, w in line_dedup.BLOCKS) == 64 and len(widths) == line_dedup.MOST_BITS + 2
    for bits in itertools.combinations(range(64), 3):
        x = sum(1 << b for b in bits)
        assert sum((x >> s) & m == 0 for s, m in widths) >= 2


def test_op4_large_group_in_blocks(spark, monkeypatch):
    """A group over several blocks: the same groups as in one."""
    rnd = random.Random(9)
    base = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(80)] = f"other{rnd.randrange(9)}"
        rows.append((i, " ".join(w)))
    want = brute_lines(rows, 4, 0.8)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 7)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in out) == want
    assert sum(r.n_removed for r in out) > 30


def test_levenshtein():
    rnd = random.Random(2)
    for _ in range(500):
        a = "".join(rnd.choices("abc", k=rnd.randint(0, 30)))
        b = "".join(rnd.choices("abcd", k=rnd.randint(0, 30)))
        assert line_dedup.levenshtein(a, b) == levenshtein(a, b)


def test_op4_lines_of_many_texts_take_little_memory():
    """Working arrays are of a slice's size, whatever the batch holds."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(1, 7))) for _ in range(3000)]
    texts = pa.array(["\n".join(" ".join(rnd.choices(words, k=12)) for _ in range(60)) for _ in range(1500)])
    tracemalloc.start()
    try:
        n = sum(len(part[0]) for part in line_dedup.lines_of(texts, 4))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1500 * 60 and peak < 60 << 20


def test_op4_empty_table(empty):
    assert line_dedup.dedup_lines(empty).collect() == []


def test_tables_of_another_operator_leave_the_worker_at_once():
    """Tables that refer to each other go without waiting for the collector, and freed memory is given back."""
    class Table:
        def __init__(self):
            self.own = self

    with mock.patch.object(worker, "_kept", {}), mock.patch.object(worker, "give_back") as given:
        kept = weakref.ref(worker.once("one", 1, Table))
        assert worker.once("one", 1, Table) is kept()
        gc.disable()
        try:
            worker.drop()
            assert kept() is None and given.called
        finally:
            gc.enable()


def test_rare_token_blocks_are_small(spark):
    """Sets of tokens counted at once come from 4 MB of texts: 80 MB make 20 blocks or more."""
    texts = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        with mock.patch.object(sigtree_join.B, "text_bytes", return_value=80 << 20), \
                mock.patch.object(sigtree_join.B, "deal", side_effect=lambda docs, n, *_: (_ for _ in ()).throw(ValueError(n))):
            with pytest.raises(ValueError) as got:
                sigtree_join._rare_routes(texts, 5, 80, 100)
        assert got.value.args[0] >= 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
