"""Registered queries on run events derived from events, and their DuckDB twins."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..streaming import runs
from .corpus import table

_SECONDS = 1704067200
_UNTIL = 4000
#: Three runs a user; about every second gap between their events is longer than a lease.
_EVENTS = """
SELECT run_id, seq, cast(seq * 60 + event_id % 110 AS bigint) AS sec, concat('t', cast(event_id % 2 AS varchar(3))) AS token,
  CASE WHEN event_id % 43 = 0 THEN 'superseded' ELSE CASE event_type WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'claimed' WHEN 'signup' THEN 'heartbeat' WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'refused' ELSE 'error' END ELSE CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'heartbeat' END END END AS kind
FROM (SELECT event_id, event_type, user_id * 3 + event_id % 3 AS run_id, row_number() OVER (PARTITION BY user_id * 3 + event_id % 3 ORDER BY ts, event_id) AS seq FROM events) AS numbered
"""


def _outcomes(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    events = spark.sql(_EVENTS).withColumn("at", F.timestamp_seconds(F.lit(_SECONDS) + F.col("sec")))
    until = datetime.datetime.fromtimestamp(_SECONDS + _UNTIL, datetime.UTC).replace(tzinfo=None)
    return runs.replay_runs(events, until)


def run_attempts(spark, sf_dir):
    return runs.attempts_of(_outcomes(spark, sf_dir))


def run_transitions(spark, sf_dir):
    out = _outcomes(spark, sf_dir)
    return out.groupBy("kind", "applied", "status", "attempts").agg(F.count("*").alias("n"))


_RUNS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sec, seq) AS k FROM ({_EVENTS}) AS events_of_runs),
st AS (
SELECT run_id, 0 AS k, CAST(0 AS BIGINT) AS sec, 'start' AS kind, true AS applied, false AS ended, 'queued' AS status, 0 AS attempts, 'queued' AS between_status, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS BIGINT) AS lease, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS ended_at FROM (SELECT DISTINCT run_id FROM e)
UNION ALL
SELECT run_id, k, sec, kind, new IS NOT NULL, ended, coalesce(new, b), CASE WHEN new = 'running' AND kind = 'claimed' THEN attempts + 1 ELSE attempts END, b,
  CASE WHEN new = 'running' THEN CASE WHEN kind = 'claimed' THEN token ELSE own END WHEN new IS NULL THEN own END,
  CASE WHEN new = 'running' THEN sec + 90 WHEN new IS NULL AND b = 'running' THEN lease END,
  CASE WHEN new IS NULL THEN CASE WHEN ended THEN CASE WHEN b = 'failed' THEN 'attempts_exhausted' END ELSE error END WHEN kind IN ('error', 'refused') THEN kind WHEN kind = 'claimed' AND new = 'failed' THEN 'attempts_exhausted' END,
  CASE WHEN ended THEN lease END
FROM (SELECT *, CASE WHEN b IN ('completed', 'failed', 'superseded') THEN NULL
    WHEN kind = 'claimed' THEN CASE WHEN b = 'queued' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'running' END END
    WHEN kind = 'superseded' THEN 'superseded'
    WHEN b = 'running' AND token = own THEN CASE kind WHEN 'heartbeat' THEN 'running' WHEN 'completed' THEN 'completed' WHEN 'refused' THEN 'failed' WHEN 'error' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END END END AS new
  FROM (SELECT *, CASE WHEN ended THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS b, CASE WHEN ended THEN NULL ELSE owner END AS own
    FROM (SELECT s.run_id, e.k, e.sec, e.kind, e.token, s.status, s.attempts, s.owner, s.lease, s.error, s.status = 'running' AND s.lease <= e.sec AS ended FROM st s JOIN e ON e.run_id = s.run_id AND e.k = s.k + 1) AS met) AS after_lease) AS judged),
last AS (SELECT *, status = 'running' AND lease <= {_UNTIL} AS over FROM st QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k DESC) = 1)
"""
_ENDS = "CASE WHEN over THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END"

ORACLES = {
    "run_attempts": _RUNS + f"""SELECT last.run_id, {_ENDS} AS status, last.attempts, CASE WHEN over THEN CASE WHEN attempts >= 3 THEN 'attempts_exhausted' END ELSE error END AS error, t.ended + CASE WHEN over THEN 1 ELSE 0 END AS ended_leases, t.ignored
FROM last JOIN (SELECT run_id, count(*) FILTER (ended) AS ended, count(*) FILTER (NOT applied) AS ignored FROM st GROUP BY run_id) t USING (run_id)""",
    "run_transitions": _RUNS + f"""SELECT kind, applied, status, attempts, count(*) AS n FROM (SELECT kind, applied, status, attempts FROM st WHERE k > 0
  UNION ALL SELECT 'lease_ended', true, st.between_status, before.attempts FROM st JOIN st before ON before.run_id = st.run_id AND before.k = st.k - 1 WHERE st.ended
  UNION ALL SELECT 'lease_ended', true, {_ENDS}, attempts FROM last WHERE over) GROUP BY ALL""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
