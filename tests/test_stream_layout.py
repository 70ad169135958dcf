"""R1 and R2 as streams give the batch results on a log in files of any size and order."""

import pytest

from quarry.plans.registry import load_all

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def uneven(spark, tmp_path_factory):
    """The events in six files with uneven shares of every time."""
    folder = tmp_path_factory.mktemp("uneven")
    events = spark.read.parquet(f"{SF}/events.parquet")
    parts = events.randomSplit([1.0, 8.0, 2.0, 0.5, 5.0, 3.0], seed=5)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize(("stream", "batch"), [("r1_stream_rate_limit", "r1_rate_limit"), ("r2_stream_breaker", "r2_breaker")])
def test_stream_equals_batch(spark, uneven, stream, batch):
    queries = load_all()
    got = queries[stream][0](spark, uneven)
    want = queries[batch][0](spark, SF).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
