"""Bad rows become data: JSON lines that are no record, prompts that a model call fails on."""

import json

import pytest
from pyspark.sql import types as T

from quarry.operators import infer
from quarry.sources import json_records


def test_record_lines_keep_bad_lines(spark, tmp_path):
    lines = ['{"id": "a", "text": "one", "seq": 1}', '', '   ', '{"id": "b", "text": "cut', '[{"id": "c"}]', '7', 'null', '"text"',
             '{"id": "d"} {"id": "e"}', '{"id": "f"}, {"id": "g"}', '﻿{"id": "h"} ', 'not json', '{}', '{"id": "i", "text": null}']
    (tmp_path / "records.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = json_records.read_record_lines(spark, str(tmp_path)).collect()
    bad = [r["_line"] for r in rows if r["_reason"] == "bad_line"]
    assert sorted(bad) == sorted([lines[i] for i in (3, 4, 5, 6, 7, 8, 9, 11)])
    good = [(r["id"], r["text"], r["seq"]) for r in rows if r["_reason"] is None]
    assert sorted(good, key=str) == sorted([("a", "one", 1), ("h", None, None), (None, None, None), ("i", None, None)], key=str)
    assert all(r["_line"] is None for r in rows if r["_reason"] is None)


def test_record_lines_of_no_lines(spark):
    empty = spark.createDataFrame([], "value string")
    assert json_records.parse_record_lines(empty).count() == 0


class FailsOn:
    """Replies in upper case; a request that holds a bad prompt fails, or gets too few replies."""

    def __init__(self, bad, short=False):
        self.bad, self.short, self.requests = bad, short, []

    def __call__(self, prompts):
        self.requests.append(list(prompts))
        if self.bad.intersection(prompts):
            if self.short:
                return []
            raise ValueError("bad prompt")
        return [p.upper() for p in prompts]


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("bad", [set(), {"p0"}, {"p7"}, {"p3", "p4"}, {f"p{i}" for i in range(9)}])
def test_failing_prompts_stand_alone(bad, short):
    prompts = [f"p{i}" for i in range(9)]
    backend = FailsOn(bad, short)
    rows = infer.call_each(backend, prompts, retries=2, backoff=0.0, sleep=lambda s: None)
    assert [r for r, _, _ in rows] == [None if p in bad else p.upper() for p in prompts]
    assert [e is not None for _, _, e in rows] == [p in bad for p in prompts]
    assert [a for _, a, _ in rows] == [sum(p in request for request in backend.requests) for p in prompts]


def test_a_group_that_recovers_is_not_halved():
    calls = []

    def backend(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise TimeoutError("later")
        return prompts
    rows = infer.call_each(backend, ["a", "b"], retries=2, backoff=0.0, sleep=lambda s: None)
    assert calls == [2, 2, 2] and rows == [("a", 3, None), ("b", 3, None)]
    assert infer.call_each(backend, [], 2, 0.0) == []


def test_job_carries_errors_as_data(spark):
    def factory():                                   # defined here: workers don't import the tests
        def backend(prompts):
            if {"p3", "p20"}.intersection(prompts):
                raise ValueError("bad prompt")
            return [p.upper() for p in prompts]
        return backend
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("prompt", T.StringType())])
    df = spark.createDataFrame([(i, None if i == 5 else f"p{i}") for i in range(40)], schema).coalesce(1)
    out = infer.call_model(df, factory, batch_rows=16, retries=1, backoff=0.0).collect()
    assert {r["id"] for r in out if r["error"]} == {3, 20} and len(out) == 40
    assert all(r["reply"] == (r["prompt"] or "").upper() for r in out if r["id"] not in (3, 20))
    assert json.dumps([r["error"] for r in out if r["id"] == 3]) == '["ValueError: bad prompt"]'
