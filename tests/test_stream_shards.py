"""R1 and R2 as streams: a call handles a shard of clients, and waiting rows are read only when their timer fires."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.streaming import jobs as sj

CLIENTS = [None, -5, *range(2**60, 2**60 + 30)]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Three parts of 40 rows a client, out of order, and a row far ahead that lets the watermark pass them."""
    path = str(tmp_path_factory.mktemp("log"))
    start = int(datetime(2024, 1, 1).timestamp()) * 1_000_000
    rows = [(c, start + ((i * 37) % 120) * 20_000_000, i * 100 + n, (i * 7 + n) % 3 > 0)
            for n, c in enumerate(CLIENTS) for i in range(120)]
    schema = "client BIGINT, ts_us BIGINT, event_id BIGINT, failed BOOLEAN"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 100 % 3 == part], schema).coalesce(1).write.parquet(f"{path}/chunk={part}")
    far = start + int(timedelta(days=30).total_seconds()) * 1_000_000
    spark.createDataFrame([(-1, far, -1, False)], schema).write.parquet(f"{path}/chunk=9")
    return path, schema, rows


def replay(spark, log, processor, folder, n_shards):
    path, schema, _rows = log
    sj.use_rocksdb(spark)
    out = sj.stateful_decisions(sj.log_stream(spark, path, schema), processor, "8 days", n_shards)
    sj.run_available(out, sj.append_batches(f"{folder}/out"), f"{folder}/ckpt")
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").drop("batch").where(~F.col("client").eqNullSafe(-1)).collect()]


@pytest.mark.parametrize("n_shards", [1, 8])
def test_many_clients_in_a_shard(spark, log, tmp_path, n_shards):
    for processor in (sj.RateLimitProcessor(600, 3), sj.BreakerProcessor(3, 60)):
        want = []
        for client in CLIENTS:
            mine = sorted(r[1:] for r in log[2] if r[0] == client)
            want += [(client, *d) for d in processor.decide(mine, None)[0]]
        got = replay(spark, log, processor, str(tmp_path / type(processor).__name__), n_shards)
        assert sorted(map(repr, got)) == sorted(map(repr, want))
