"""R1/R2 against a sequential replay on small random logs (and a hot client)."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import reqlog as rl


def replay_rate(rows, w_us, limit):
    out, state = {}, {}
    for client, ts, eid, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        start, cnt = state.get(client, (None, 0))
        if start is None or ts >= start + w_us:
            start, cnt = ts, 1
        else:
            cnt += 1
        state[client] = (start, cnt)
        out[eid] = (start, cnt, cnt <= limit)
    return out


def replay_breaker(rows, thr, t_us):
    out, state = {}, {}
    for client, ts, eid, failed in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        f, last, is_open = state.get(client, (0, 0, False))
        if is_open and not (ts - last > t_us):
            out[eid] = "rejected"
            continue
        if not failed:
            f, is_open, o = 0, False, "accepted"
        else:
            f, last = f + 1, ts
            is_open = f >= thr
            o = "opened" if is_open else "accepted"
        state[client] = (f, last, is_open)
        out[eid] = o
    return out


def make_rows(seed, n=400, clients=4, span_us=5_000_000, ties=True):
    rnd = random.Random(seed)
    rows = []
    for eid in range(n):
        c = 0 if rnd.random() < 0.4 else rnd.randrange(clients)  # one hot client
        ts = rnd.randrange(span_us)
        if ties and rnd.random() < 0.1:
            ts = ts - ts % 250_000
        rows.append((c, ts, eid, rnd.random() < 0.45))
    return rows


def log_df(spark, rows):
    return spark.createDataFrame(rows, "client long, ts_us long, event_id long, failed boolean")


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_limit_matches_replay(spark, seed):
    rows = make_rows(seed)
    w_us, limit = 500_000, 3
    want = replay_rate(rows, w_us, limit)
    got = {r.event_id: (r.window_start_us, r.n_in_window, r.allowed)
           for r in rl.rate_limit(log_df(spark, rows), w_us / 1e6, limit).collect()}
    assert got == want


def test_rate_limit_exact_boundary(spark):
    # second request exactly one window after the first opens a new window
    rows = [(1, 0, 1, False), (1, 60_000_000, 2, False), (1, 60_000_001, 3, False)]
    got = {r.event_id: (r.window_start_us, r.n_in_window)
           for r in rl.rate_limit(log_df(spark, rows), 60, 100).collect()}
    assert got == {1: (0, 1), 2: (60_000_000, 1), 3: (60_000_000, 2)}
    many = [(1, i, i, False) for i in range(101)]
    dec = {r.event_id: r.allowed for r in rl.rate_limit(log_df(spark, many), 60, 100).collect()}
    assert dec[99] is True and dec[100] is False


@pytest.mark.parametrize("seed", [3, 4])
def test_breaker_matches_replay(spark, seed):
    rows = make_rows(seed)
    thr, t_us = 3, 400_000
    want = replay_breaker(rows, thr, t_us)
    got = {r.event_id: r.outcome for r in rl.breaker(log_df(spark, rows), thr, t_us / 1e6).collect()}
    assert got == want


def test_breaker_timeout_boundary(spark):
    t = 30_000_000
    rows = [(1, 0, 1, True), (1, 1, 2, True), (1, 2, 3, True),      # opens at 2
            (1, 2 + t, 4, False),                                     # exactly at timeout: rejected
            (1, 3 + t, 5, True),                                      # half-open failure: re-opens
            (1, 4 + 2 * t, 6, False),                                 # half-open success: closes
            (1, 5 + 2 * t, 7, True)]
    got = {r.event_id: r.outcome for r in rl.breaker(log_df(spark, rows), 3, 30).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "opened", 4: "rejected", 5: "opened",
                   6: "accepted", 7: "accepted"}


def test_percentiles_match_numpy(spark):
    import numpy as np
    rnd = random.Random(5)
    vals = [round(rnd.random() * 100, 2) for _ in range(501)] + [None]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, v double")
    out = rl.exact_percentiles(df, "g", "v").first()
    arr = np.array([v for v in vals if v is not None])
    for q, name in [(0.5, "p50"), (0.95, "p95"), (0.99, "p99")]:
        assert abs(out[name] - float(np.quantile(arr, q))) < 1e-6
    assert df.filter(F.col("v").isNull()).count() == 1
