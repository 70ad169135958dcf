"""Edge rows and invariants for intake, store, cache, quality and feedback."""

import json

from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.operators import cache as ch
from quarry.operators import feedback as fb
from quarry.operators import ingest as ig
from quarry.operators import quality as ql
from quarry.operators import store as st
from quarry.session import shared_path
from quarry.sources import json_records as js


def test_json_record_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "x", "text": "lone"}))
    (tmp_path / "b.json").write_text(json.dumps([1, "s", None, {"id": "y", "text": "t",
                                                              "metadata": {"cc": ["a", "b"]}}]))
    (tmp_path / "c.json").write_text("not json at all")
    out = js.read_record_files(spark, str(tmp_path))
    good = {r.id: r for r in out.filter("_reason IS NULL").collect()}
    assert set(good) == {"x", "y"}
    assert json.loads(good["y"].metadata["cc"]) == ["a", "b"]
    bad = out.filter("_reason IS NOT NULL").collect()
    assert len(bad) == 1 and bad[0]._file.endswith("c.json")


def _records(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, raw string, subject string, "
                                       "user_id string, seq long")


def test_normalise_and_key(spark):
    rows = [(None, "hello  world", None, "S", "u1", 1),
            ("", None, "hello world", None, None, 2),
            ("given", "hello world", None, "", "u2", 3),
            (None, "   ", None, None, None, 4)]
    n = ig.normalise_records(_records(spark, rows))
    k = ig.keyed_documents(n).orderBy("seq").collect()
    assert k[0].id == k[1].id != "given"
    assert k[2].id == "given"
    assert k[3].reason == "empty_text"
    m = n.orderBy("seq").collect()
    assert m[0].metadata == {"subject": "S", "user_id": "u1"} and m[0].has_raw is False
    assert m[1].metadata == {"has_raw": "true"} and m[1].text == "hello world"
    assert m[2].metadata == {"user_id": "u2"}


def test_dedup_accounting_invariant(spark):
    rows = [(None, t, None, None, None, i) for i, t in enumerate(["a", "b", "a", "c", "a b", "a  b"])]
    docs = ig.accepted(ig.keyed_documents(ig.normalise_records(_records(spark, rows))))
    acc = ig.dedup_accounting(docs).first()
    assert acc.received == 6 and acc.inserted == 4 and acc.inserted + acc.duplicates == acc.received
    firsts = {r.id: r.seq for r in ig.first_per_key(docs).collect()}
    assert sorted(firsts.values()) == [0, 1, 3, 4]


def test_insert_if_absent_rerun_inserts_nothing(spark):
    path = shared_path(spark, "test_store")
    tbl = st.InsertOnlyTable(spark, path)
    inc = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, seq long")
    _, new1 = tbl.insert_if_absent(inc, 0)
    assert new1.count() == 2
    _, new2 = tbl.insert_if_absent(inc, 1)
    assert new2.count() == 0 and tbl.read().count() == 2
    _, again = tbl.insert_if_absent(inc, 1)  # replayed write: same delta, same table
    assert again.count() == 0 and tbl.read().count() == 2 and tbl.parts() == ["batch-0", "batch-1"]
    tbl.insert_if_absent(spark.createDataFrame([("c", 9)], "id string, seq long"))  # a call of its own run
    assert sorted(r.id for r in tbl.read().collect()) == ["a", "b", "c"] and len(tbl.parts()) == 3


def test_upsert_null_overwrites_and_replay(spark):
    path = shared_path(spark, "test_upsert")
    tbl = st.VersionedTable(spark, path, key="id")
    tbl.upsert(spark.createDataFrame([("e1", "good")], "id string, summary string"), 1)
    upd = spark.createDataFrame([("e1", None)], "id string, summary string")
    tbl.upsert(upd, 2)
    assert tbl.read().first().summary is None
    tbl.upsert(upd, 2)  # replayed batch: same version, same result
    assert tbl.read().count() == 1 and tbl.versions() == [1, 2]
    keep = st.upsert(spark.createDataFrame([("e1", "good", 1)], "id string, summary string, v int"),
                     spark.createDataFrame([("e1", None, 2)], "id string, summary string, v int"),
                     "id", "v", keep_last_good="summary")
    assert keep.first().summary == "good"


def test_cache_ttl_boundaries(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    cache = spark.createDataFrame([
        ("eq", "2024-01-30 00:00:00", '{"a": 1}'), ("over", "2024-01-29 23:59:59", '{"a": 1}'),
        ("empty", "2024-01-30 12:00:00", "{}"), ("bad", "2024-01-30 12:00:00", "not json")],
        "key string, ts string, value string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    req = spark.createDataFrame([("eq",), ("over",), ("empty",), ("bad",), ("none",)], "key string")
    hits = {r.key: r.hit for r in ch.lookup(req, cache, now, 86400).collect()}
    assert hits == {"eq": True, "over": False, "empty": False, "bad": False, "none": False}
    forever = {r.key: r.hit for r in ch.lookup(req, cache, now, 0).collect()}
    assert forever["over"] is True


def test_cache_key_matches_python_json(spark):
    import hashlib
    prompt = "café \"quoted\" \\ line\nnext\t" + "x" * 2500
    for chars in (None, K.CACHE_KEY_CHARS):
        doc = json.dumps({"ns": K.CACHE_NAMESPACE, "model": K.DEFAULT_MODEL, "system": K.SYSTEM_PROMPT,
                          "user": prompt[:chars]}, ensure_ascii=False, sort_keys=True)
        want = hashlib.sha256(doc.encode()).hexdigest()
        got = spark.createDataFrame([(prompt,)], "p string").select(ch.cache_key("p", key_chars=chars)).first()[0]
        assert got == want


def test_retention_keeps_newest(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(10)], "key string, ts long")
    assert sorted(int(r.key) for r in ch.retain(df, 3).collect()) == [7, 8, 9]
    assert ch.retain(df, 0).count() == 10


def test_retention_large_cap_distributed(spark):
    rows = [(f"k{i:03d}", f"2024-01-01 00:00:{i % 50:02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    want = sorted(rows, key=lambda r: (-int(r[1][-2:]), r[0]))[:37]  # newest first, ties by key
    got = sorted(r.key for r in ch.retain(df, 37).collect())
    assert got == sorted(r[0] for r in want)


def test_quality_score_boundaries(spark):
    df = spark.createDataFrame([(0.248,), (0.2488,), (0.25,), (None,)], "confidence double")
    out = ql.quality_score(df).select("overall", "passed").collect()
    assert [(r.overall, r.passed) for r in out] == [(0.699, False), (0.7, True), (0.7, True),
                                                   (0.8, True)]
    rw = ql.rework(ql.quality_score(df))
    assert rw.count() == 1 and rw.first().corrections == 1


def test_consolidation(spark):
    rows = [(str(i), 1, None, ["deadline"] if i % 2 else [], i % 3 == 0, False, True, None, i)
            for i in range(12)]
    f = spark.createDataFrame(rows, fb.FEEDBACK_SCHEMA)
    text = fb.consolidate(f, threshold=5).first().instructions
    assert text.splitlines()[1].startswith("- Re-check the category")  # wrong_type: 12 reports
    assert "Always include the deadline" in text
    pts = fb.consolidation_points(f, every_n=5).filter("fires").orderBy("rank").collect()
    assert [p.rank for p in pts] == [5, 10]
    empty = fb.consolidate(f.limit(0)).first().instructions
    assert empty == ""


def test_passages_short_and_long(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "xbeta gammay")],
                                 "doc_id long, text string")
    ps = spark.createDataFrame([(10, "ta gamma delta eps"), (11, "beta gamma"), (12, "zzz"),
                                (13, "")], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in ql.passage_matches(ps, docs).collect()}
    want = {(p, d) for p, pt in [(10, "ta gamma delta eps"), (11, "beta gamma"), (12, "zzz")]
            for d, dt in [(1, "alpha beta gamma delta epsilon zeta"), (2, "xbeta gammay")] if pt in dt}
    assert got == want
