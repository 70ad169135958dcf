"""Results stay whole: no hidden caps, prefixes or lost neighbours."""

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import cache as ch
from quarry.operators import feedback as fb
from quarry.operators import quality as ql
from quarry.operators import store as st
from quarry.session import shared_path
from quarry.sources.json_records import parse_record_files


def test_fallback_body_keeps_text_after_long_markup(spark):
    raw = "x: y\n\n<script>" + "a" * 1_000_001 + "</script><p>seen</p>"
    assert spark.createDataFrame([(raw,)], "r string").select(tx.fallback_body("r")).first()[0] == "seen"


def test_prompts_equal_in_a_prefix_have_different_keys(spark):
    df = spark.createDataFrame([("a" * 2000 + "1",), ("a" * 2000 + "2",)], "p string")
    assert df.select(ch.cache_key("p")).distinct().count() == 2
    assert df.select(ch.cache_key("p", key_chars=2000)).distinct().count() == 1


def test_all_rules_over_the_threshold(spark):
    rows = [(str(i), [f"item{i % 30}"], False, False, False) for i in range(180)]
    df = spark.createDataFrame(rows, "session_id string, missing_items array<string>, tone_off boolean, wrong_priority boolean, wrong_type boolean")
    assert fb.consolidate(df).first().instructions.count("\n- ") == 30
    assert fb.consolidate(df, max_rules=3).first().instructions.count("\n- ") == 3


def test_short_passages_in_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "bone twofold"), (3, "")], "doc_id long, text string")
    passages = [(i, f"zz{i}") for i in range(40)] + [(100, "one"), (101, "one two"), (102, "one two three")]
    p = spark.createDataFrame(passages, "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in ql.passage_matches(p, docs, block_rows=7).collect()}
    assert got == {(100, 1), (100, 2), (101, 1), (101, 2), (102, 1)}


def test_retention_is_one_plan(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"), F.timestamp_seconds("id").alias("ts"))
    assert {int(r.key) for r in ch.retain(df, 7).collect()} == set(range(493, 500))


def test_neighbouring_references(spark):
    df = spark.createDataFrame([(1, "AB-12 CD-34 EF-56,GH-7 xAB-1 AB-1x")], "id long, text string")
    got = {r.value for r in ql.key_details_long(df).collect() if r.kind == "reference"}
    assert got == {"AB-12", "CD-34", "EF-56", "GH-7"}


def test_all_forms_of_href_and_clean_link_text(spark):
    html = "<a href='u1?a=1&amp;b=2'>one &mdash; <b>two</b></a> <a class=x href=u2>three</a> <a href=\"u3\"><i></i></a>"
    df = spark.createDataFrame([(html,)], "h string")
    hrefs, texts = df.select(*tx.link_edges("h")).first()
    assert hrefs == ["u1?a=1&b=2", "u2", "u3"] and texts == ["one — two", "three", ""]
    assert df.select(tx.html_to_clean_text("h")).first()[0] == "[one — **two**](u1?a=1&b=2) [three](u2) [__](u3)"


def test_record_files_with_newline_or_mark(spark):
    files = spark.createDataFrame([("a", '\n{"id": "1"}'), ("b", '﻿[{"id": "2"}, 3]'), ("c", "no json")], "path string, value string")
    got = {(r._file, r.id, r._reason) for r in parse_record_files(files).collect()}
    assert got == {("a", "1", None), ("b", "2", None), ("c", None, "unreadable_file")}


def test_keep_last_good_keeps_keys_without_a_good_value(spark):
    base = spark.createDataFrame([("a", "good", 1), ("b", None, 1)], "id string, s string, v long")
    new = spark.createDataFrame([("a", None, 2), ("c", None, 2), ("b", None, 2)], "id string, s string, v long")
    got = {(r.id, r.s, r.v) for r in st.upsert(base, new, "id", "v", keep_last_good="s").collect()}
    assert got == {("a", "good", 1), ("b", None, 2), ("c", None, 2)}


def test_uncommitted_version_is_not_read(spark):
    path = shared_path(spark, "half_written")
    table = st.VersionedTable(spark, path)
    table.write_version(spark.createDataFrame([("a", 1)], "id string, v long"), 1)
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        table.write_version(spark.createDataFrame([("a", 2)], "id string, v long"), 2)
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert table.versions() == [1] and table.read().first().v == 1
