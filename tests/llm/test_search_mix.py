"""op1, op2 and the pipeline."""

import collections

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, multiprobe_lsh
from quarry.llm.queries import QUERIES


def exact(rows, queries, k):
    out = {}
    for q, v in rows:
        if not queries(q):
            continue
        best = {}
        for i, w in rows:
            if i != q:
                s = float((np.array(v, dtype=np.float64) * np.array(w, dtype=np.float64)).sum())
                best[i] = max(s, best.get(i, s))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_op1_recall(spark, where):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    got = collections.defaultdict(list)
    for r in QUERIES["op1_ann_multiprobe"][0](spark, where).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = []
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        mine = got.pop(int(ids[at]))
        assert [m[0] for m in mine] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        assert all(s == pytest.approx(score[ids == v][0], abs=1e-12) for _, v, s in mine)
        hit.append(len(best & {m[1] for m in mine}) / 20)
    assert not got and np.mean(hit) >= 0.9


def test_op1_odd_vectors(spark):
    """Fewer rows than neighbours, ties, a repeated id, other lengths; bad vectors take no part."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [3.0, 0.0]), (4, [-5.0, 1.0]), (20, [0.5, 0.5]),
            (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (None, [1.0, 1.0]),
            (40, [1.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.0]), (60, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in multiprobe_lsh.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    flat = exact(rows[:7], lambda i: i % 20 == 0, 20)
    assert dict(got) == {0: flat[0], 20: flat[20], 40: [(0.0, 11)]}
    assert multiprobe_lsh.search(df.limit(0), F.lit(True)).collect() == []


def test_op1_crowded_buckets_are_split(spark, monkeypatch):
    """A third of all rows is one vector: its buckets are spread, its queries still get exact ties."""
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(3000, 8))
    x[1000:2100] = x[999]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = collections.defaultdict(list)
    for r in multiprobe_lsh.search(df, F.col("vec_id") % 500 == 0, k=10).orderBy("query_id", "rank").collect():
        rows[r.query_id].append(r.vec_id)
    want = exact([(i, v) for i, v in enumerate(x)], lambda i: i % 500 == 0, 10)
    hit = [len(set(rows[q]) & {i for _, i in w}) for q, w in want.items()]
    assert sum(hit) >= 0.9 * 10 * len(want) and rows[1500] == [i for _, i in want[1500]]


def nearest(x, at, k):
    score = x @ x[at]
    score[at] = -np.inf
    return set(np.lexsort((np.arange(len(x)), -score))[:k].tolist())


def test_op1_meets_a_part_of_the_rows():
    """Time: 400 queries on 60,000 vectors, the four tables together, meet well under all rows, small buckets several at once."""
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 64))[rnd.integers(0, 300, 60000)] + 0.7 * rnd.normal(size=(60000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    ids, k = np.arange(len(x)), 20
    want = [nearest(x, at, k) for at in range(400)]
    kth = np.sort(x[:400] @ x.T, axis=1)[:, -k - 1]
    space = multiprobe_lsh.Space(64, len(x), 1.0, float(np.quantile(np.sqrt(2 - 2 * kth), 0.8)), multiprobe_lsh.functions_for(len(x)), 4, 0.95)
    worth, projected = space.worth(), space.queries(x[:400].astype(np.float64))
    bins, slots = space.bins(projected), space.numbers(space.rows(x.astype(np.float64)))
    asked = multiprobe_lsh.Asked(ids[:400], x[:400], bins, space.enough(x[:400], projected, bins, worth), np.full(400, -np.inf))
    pairs, calls, got = 0, 0, [set() for _ in range(400)]
    for t in range(4):
        cells = np.concatenate([np.tile(np.array([0, 0, 0, 64, t], np.uint8), (len(x), 1)), slots[:, t * space.k:(t + 1) * space.k]], axis=1)
        order = np.lexsort(cells.T[::-1])
        near = multiprobe_lsh.Nearest(asked, asked.floor, x[order], ids[order], 1.0, k)
        meet = near.meet

        def counted(queries, lo, hi, *more):
            nonlocal pairs, calls
            pairs, calls = pairs + len(queries) * (hi - lo), calls + 1
            meet(queries, lo, hi, *more)
        near.meet = counted
        some, few = multiprobe_lsh._possible(asked, cells[order], space, worth)
        multiprobe_lsh._visit(near, some, cells[order], 0, space, worth, few)
        for r in near.found().to_pylist():
            got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(w & g) / k for w, g in zip(want, got)]) >= 0.95
    assert pairs < 0.5 * 400 * len(x) and calls < 4 * len(x) / multiprobe_lsh.TOGETHER


def test_op1_floors_and_chunks_lose_nothing(spark, monkeypatch):
    """A dense group in scattered rows, so that floors fit some queries only, and single precision; queries come in many chunks."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(2400, 16))
    x[:800] = x[0] + 0.01 * rnd.normal(size=(800, 16))
    x = (x * rnd.uniform(0.5, 2, size=(2400, 1))).astype(np.float32)
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], schema)
    rows = {}
    for size in (multiprobe_lsh.CHUNK_BYTES, 2000):
        monkeypatch.setattr(multiprobe_lsh, "CHUNK_BYTES", size)
        found = multiprobe_lsh.search(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect()
        rows[size] = [(r.query_id, r["rank"], r.vec_id, r.score) for r in found]
    small, large = rows.values()
    assert small == large and len(small) == 120 * 10
    wide = x.astype(np.float64)
    hit = collections.Counter()
    for q, _rank, i, score in small:
        assert score == pytest.approx(wide[q] @ wide[i], abs=1e-12)
        hit[q] += i in nearest(wide, q, 10)
    assert sum(hit.values()) >= 0.95 * 10 * 120


# ---------------------------------------------------------------- op2

def check_mix(rows, most=3.0):
    """rows: doc_id, source, size, source_size, target, taken."""
    total = sum(r["size"] for r in rows)
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], {"size": 0, "taken": 0, "target": r["target"], "told": r["source_size"]})
        s = sources[r["source"]]
        s["size"] += r["size"]
        s["taken"] += r["taken"]
        assert 0 <= r["taken"] <= most * r["size"]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    for name, s in sources.items():
        assert s["size"] == s["told"] and s["target"] <= most * s["size"] + 1e-6 and abs(s["taken"] - s["target"]) <= 1
    assert sum(s["target"] for s in sources.values()) == pytest.approx(total)
    free = [s["target"] / weight[n] for n, s in sources.items() if s["target"] < most * s["size"] - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


def test_op2_oracle_and_contract(spark, sf):
    name = "op2_mix_sources"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(QUERIES[name][1])
    cols = [d[0] for d in want.description]
    want = {r[0]: r for r in want.fetchall()}
    got = QUERIES[name][0](spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in cols) for r in got} == want
    again = QUERIES[name][0](spark, sf).collect()
    assert got == again
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    check_mix([{**r.asDict(), "source": source[r.doc_id]} for r in got])
    at = [r.first_position for r in got if r.first_position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


def test_op2_plan_has_no_python(spark, sf, capsys):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixing.by_position(mixing.plan(docs)).explain()
    out = capsys.readouterr().out
    assert "Python" not in out and "Pandas" not in out and "Arrow" not in out


def test_op2_odd_rows(odd, empty):
    out = mixing.plan(odd)
    assert out.columns == [c for c in odd.columns if c != "size"] + ["size", "source_size", "target", "taken", "copies"]
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == odd.count()
    check_mix(rows)
    assert mixing.plan(empty).collect() == [] and mixing.mixed(odd).columns == odd.columns


def test_op2_positions_follow_the_schedule(spark):
    """Up to time t each source has supplied its schedule's share of words."""
    rows = [(i, "w " * 20, f"s{i % 3}") for i in range(900)]
    out = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    copies = collections.defaultdict(list)
    for r in out.collect():
        copies[r.source] += [(c.position, c.words) for c in r.copies]
    for schedule, name in zip(mixing.FADE, ("s0", "s1", "s2")):
        (_, w0), (_, w1) = schedule
        total = sum(n for _, n in copies[name])
        for t in (0.1, 0.25, 0.5, 0.8, 1.0):
            share = (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2)
            assert abs(sum(n for p, n in copies[name] if p < t) - share * total) <= 40
    with pytest.raises(ValueError):
        mixing.segments([(0.0, 1.0), (0.5, 1.0)])


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mix_sources", "byte_bpe"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        seen.append((docs, out))
        docs = out
    ids = [({r.doc_id for r in a.select("doc_id").collect()}, [r.doc_id for r in b.select("doc_id").collect()]) for a, b in seen]
    assert all(set(b) <= a for a, b in ids) and 0 < len(ids[0][1]) < len(ids[0][0])
    assert len(ids[2][1]) == len(set(ids[2][1]))
    labels = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    long = {r.doc_id for r in seen[0][0].where("n_chars > 600").select("doc_id").collect()}
    assert len(labels & long - set(ids[0][1])) <= 0.02 * len(labels & long)       # clean documents stay
    assert all(r.n_tokens == len(r.ids) // 4 for r in seen[4][1].collect())


def test_pipeline_stages_on_odd_rows(spark, sf):
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (None, "a b c d e f " * 20, None, "s", 3), (4, "a b c d e f " * 20, "en", "s", 3),
            (4, "a b c d e f " * 20, "en", "s", 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            out.collect()
            assert name == "byte_bpe" or out.columns == frame.columns
