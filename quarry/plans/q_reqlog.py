"""Request-log queries: R1-R3 (batch), checked against recursive-CTE replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.operators import reqlog as rl
from quarry.plans.registry import register
from quarry.sources.tables import table

# Parameters of the checked replays: a 6-hour window with 3 requests makes
# windows hold several requests on this event rate (150 clients over 30 days);
# the service defaults (60 s, 100) are checked too.
WIDE_WINDOW_S, WIDE_LIMIT = 21600, 3
BREAKER_THRESHOLD, BREAKER_TIMEOUT_S = 3, 21600


def _log(spark, sf):
    e = table(spark, sf, "events")
    return rl.request_log(e, "user_id", "ts", "event_id", F.col("event_type") == F.lit("error"))


_EV_SQL = """ev AS (SELECT user_id, epoch_us(ts) AS t, event_type = 'error' AS fail,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""


def _r1_sql(window_s: int, limit: int) -> str:
    w = window_s * 1_000_000
    return f"""WITH RECURSIVE {_EV_SQL},
win(user_id, rn, t, wstart, cnt) AS (
  SELECT user_id, rn, t, t, 1 FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.t,
         CASE WHEN e.t >= w.wstart + {w} THEN e.t ELSE w.wstart END,
         CASE WHEN e.t >= w.wstart + {w} THEN 1 ELSE w.cnt + 1 END
  FROM win w JOIN ev e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id AS client, wstart AS window_start_us, count(*) AS n_requests,
       count(*) FILTER (WHERE cnt <= {limit}) AS n_allowed,
       count(*) FILTER (WHERE cnt > {limit}) AS n_rejected
FROM win GROUP BY 1, 2"""


@register("r1_rate_limit", _r1_sql(WIDE_WINDOW_S, WIDE_LIMIT), headline=True)
def r1_rate_limit(spark, sf):
    return rl.rate_limit_windows(rl.rate_limit(_log(spark, sf), WIDE_WINDOW_S, WIDE_LIMIT))


@register("r1_rate_limit_default", _r1_sql(K.RATE_WINDOW_SECONDS, K.RATE_LIMIT))
def r1_rate_limit_default(spark, sf):
    return rl.rate_limit_windows(rl.rate_limit(_log(spark, sf)))


def _r2_sql(threshold: int, timeout_s: int) -> str:
    t = timeout_s * 1_000_000
    rej = f"(r.state = 'OPEN' AND NOT (e.t - r.last_t > {t}))"
    return f"""WITH RECURSIVE {_EV_SQL},
r(user_id, rn, t, fail, f, last_t, state, rejected, opened) AS (
  SELECT user_id, rn, t, fail, CASE WHEN fail THEN 1 ELSE 0 END, CASE WHEN fail THEN t ELSE 0 END,
         CASE WHEN fail AND 1 >= {threshold} THEN 'OPEN' ELSE 'CLOSED' END,
         false, fail AND 1 >= {threshold}
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.t, e.fail,
    CASE WHEN {rej} THEN r.f WHEN NOT e.fail THEN 0 ELSE r.f + 1 END,
    CASE WHEN {rej} THEN r.last_t WHEN e.fail THEN e.t ELSE r.last_t END,
    CASE WHEN {rej} THEN 'OPEN' WHEN NOT e.fail THEN 'CLOSED'
         WHEN r.f + 1 >= {threshold} THEN 'OPEN' ELSE 'CLOSED' END,
    {rej},
    NOT {rej} AND e.fail AND r.f + 1 >= {threshold}
  FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id AS client, count(*) AS n_calls, count(*) FILTER (WHERE fail) AS n_failures,
       count(*) FILTER (WHERE opened) AS n_opens, count(*) FILTER (WHERE rejected) AS n_rejected
FROM r GROUP BY 1"""


@register("r2_breaker", _r2_sql(BREAKER_THRESHOLD, BREAKER_TIMEOUT_S), headline=True)
def r2_breaker(spark, sf):
    return rl.breaker_summary(rl.breaker(_log(spark, sf), BREAKER_THRESHOLD, BREAKER_TIMEOUT_S))


@register("r2_failure_runs", f"""WITH {_EV_SQL},
i AS (SELECT *, coalesce(max(CASE WHEN NOT fail THEN rn END)
                 OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS island FROM ev)
SELECT user_id AS client, min(t) AS run_start_us, max(t) AS run_end_us, count(*) AS length
FROM i WHERE fail GROUP BY user_id, island HAVING count(*) >= 3""")
def r2_failure_runs(spark, sf):
    return rl.failure_runs(_log(spark, sf), 3)


@register("r3_latency_summary", """
SELECT event_type AS client, count(*) AS n_calls, round(avg(value), 6) AS avg_ms,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
       round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY event_type""")
def r3_latency_summary(spark, sf):
    e = table(spark, sf, "events")
    return rl.latency_summary(rl.request_log(e, "event_type", "ts", "event_id"))


@register("r3_latency_windows", """
SELECT epoch_us(date_trunc('hour', ts)) AS window_start_us, event_type AS client,
       count(*) AS n_calls, round(avg(value), 6) AS avg_ms, max(value) AS max_ms
FROM events GROUP BY 1, 2""")
def r3_latency_windows(spark, sf):
    e = table(spark, sf, "events")
    return rl.latency_windows(rl.request_log(e, "event_type", "ts", "event_id"))
