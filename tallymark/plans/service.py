"""Registered queries on runs, reservations and requests, on tables that lack rows on either side, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import service
from .corpus import sql_with, table, view
from .queries import NOW

_AMOUNT = 32768


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Runs, and an outbox that lacks every fifth and knows some that no run has."""
    runs = view(spark, sf_dir, "c9")
    known = runs.where("run_id % 5 > 0").select("run_id", "dispatched_at")
    odd = runs.where("run_id % 50 = 1").select((-F.col("run_id")).alias("run_id"), "dispatched_at")
    return runs.where("run_id % 7 > 0"), known.unionByName(odd)


def service_metrics(spark, sf_dir):
    runs, outbox = _runs(spark, sf_dir)
    cases = view(spark, sf_dir, "c1").select("case_id", (F.col("confidence_pct") < 80).alias("needs_review"))
    out = service.service_metrics(runs, outbox, cases, F.expr(NOW))
    return out.withColumn("review_rate", F.round("review_rate", 9))


def run_recovery(spark, sf_dir):
    runs, outbox = _runs(spark, sf_dir)
    return service.recover(runs, outbox, F.expr(NOW))


def lost_dispatches(spark, sf_dir):
    return service.lost_dispatches(*_runs(spark, sf_dir))


def reservation_settlement(spark, sf_dir):
    rows = view(spark, sf_dir, "c10")
    purpose = F.expr("CASE WHEN reservation_id % 31 = 0 THEN 'other' ELSE purpose END")
    rate = F.expr("CASE WHEN reservation_id % 37 = 0 THEN -in_rate ELSE in_rate END")
    reservations = rows.where("reservation_id % 11 > 0").select("reservation_id", purpose.alias("purpose"), "amount", rate.alias("in_rate"), "out_rate")
    usage = rows.where("reservation_id % 13 > 0").select("reservation_id", "input_tokens", "output_tokens")
    ledger = spark.createDataFrame([("demo", 10**9), ("development", _AMOUNT - 1)], "purpose string, held long")
    return service.settle_reservations(reservations, usage, ledger)


_WORDS = "concat('Ref AB', cast(1000 + o_custkey AS varchar(12)), ' and ', cast(100000 + o_orderkey AS varchar(12)), ' no 12')"
#: Two blocks a side; every 50th body is too long, some text is read badly from images.
_TEXTS = f"SELECT o_orderkey AS case_id, role, {_WORDS} AS text, CASE WHEN role = 'BL' AND o_orderkey % 6 = 0 THEN concat('zz', cast(o_orderkey AS varchar(12))) END AS other, o_orderkey % 7 AS k FROM orders CROSS JOIN (SELECT 'SI' AS role UNION ALL SELECT 'BL') AS sides"


def pair_requests(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("orders")
    body = F.when(F.col("o_orderkey") % 50 == 3, F.repeat(F.lit("long "), F.lit(20000))).otherwise("short")
    cases = orders.select(F.col("o_orderkey").alias("case_id"), F.lit("s").alias("subject"), body.alias("body"), (F.col("o_orderkey") % 9 == 0).alias("blocked"))
    rows = spark.sql(_TEXTS)
    method = F.when(F.col("k").isin(1, 2) & (F.col("role") == "BL"), "ocr").otherwise("native")
    blocks = rows.select("case_id", "role", F.lit(1).alias("block"), "text", method.alias("method"), F.when(F.col("k") == 1, 0.95).when(F.col("k") == 2, 0.5).alias("ocr"))
    more = rows.select("case_id", "role", F.lit(2).alias("block"), F.col("other").alias("text"), F.lit("native").alias("method"), F.lit(None).cast("double").alias("ocr"))
    out = service.pair_requests(cases, blocks.unionByName(more), "policy-1")
    return out.select("case_id", "n_shared", (F.col("n_bytes") > service.MOST_REQUEST_BYTES).alias("too_long"), F.col("request").isNotNull().alias("asked"), (F.char_length("fingerprint") == 64).alias("named"))


_OUT = sql_with("c9") + ", r AS (SELECT * FROM c9 WHERE run_id % 7 > 0), o AS (SELECT run_id, dispatched_at FROM c9 WHERE run_id % 5 > 0 UNION ALL SELECT -run_id, dispatched_at FROM c9 WHERE run_id % 50 = 1)"

ORACLES = {
    "service_metrics": _OUT + "," + sql_with("c1").removeprefix("WITH ") + f""" SELECT a.*, b.undispatched, c.* FROM (SELECT CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (attempts > 1) AS retried, greatest(0, CAST(floor(epoch({NOW})) - floor(epoch(min(created_at) FILTER (status = 'queued'))) AS BIGINT)) AS oldest_queued_seconds FROM r) a,
(SELECT count(*) FILTER (dispatched_at IS NULL) AS undispatched FROM o) b, (SELECT count(*) AS cases, count(*) FILTER (confidence_pct < 80) AS needs_review, round(count(*) FILTER (confidence_pct < 80) / count(*), 9) AS review_rate FROM c1) c""",
    "run_recovery": _OUT + f""" SELECT r.run_id, CASE WHEN attempts >= 3 THEN 'fail' WHEN o.run_id IS NULL THEN 'enter' ELSE 'send_again' END AS action FROM r LEFT JOIN o ON o.run_id = r.run_id
WHERE (status = 'queued' OR status = 'running' AND (lease_until IS NULL OR lease_until <= {NOW})) AND (attempts >= 3 OR o.dispatched_at IS NULL OR o.dispatched_at <= {NOW} - INTERVAL 15 MINUTE)""",
    "lost_dispatches": _OUT + " SELECT coalesce(r.run_id, o.run_id) AS run_id, CASE WHEN r.run_id IS NULL THEN 'no_run' ELSE 'no_outbox' END AS problem FROM r FULL JOIN o ON o.run_id = r.run_id WHERE r.run_id IS NULL OR (o.run_id IS NULL AND status = 'queued')",
    "reservation_settlement": sql_with("c10") + f""", v AS (SELECT reservation_id, CASE WHEN reservation_id % 31 = 0 THEN 'other' ELSE purpose END AS purpose, amount, CASE WHEN reservation_id % 37 = 0 THEN -in_rate ELSE in_rate END AS in_rate, out_rate FROM c10 WHERE reservation_id % 11 > 0),
u AS (SELECT reservation_id, input_tokens, output_tokens, true AS told FROM c10 WHERE reservation_id % 13 > 0),
j AS (SELECT coalesce(v.reservation_id, u.reservation_id) AS reservation_id, purpose, amount, in_rate, input_tokens, output_tokens, told, CAST(ceil(CAST(input_tokens AS DECIMAL(18,0)) * in_rate + CAST(output_tokens AS DECIMAL(18,0)) * out_rate) AS BIGINT) AS actual FROM v FULL JOIN u ON u.reservation_id = v.reservation_id),
s AS (SELECT *, CASE WHEN amount IS NULL THEN 'unknown_reservation' WHEN told IS NULL THEN NULL WHEN input_tokens IS NULL OR output_tokens IS NULL THEN 'invalid_usage' WHEN in_rate < 0 THEN 'bad_rate' WHEN actual > amount THEN 'over_reservation' WHEN purpose = 'other' THEN 'unknown_purpose' WHEN purpose = 'development' THEN 'low_ledger' ELSE 'settled' END AS state FROM j)
SELECT reservation_id, purpose, state, CASE WHEN state = 'settled' THEN actual ELSE coalesce(amount, 0) END AS charged FROM s""",
    "pair_requests": "SELECT o_orderkey AS case_id, CAST(2 AS INT) AS n_shared, o_orderkey % 50 = 3 AS too_long, o_orderkey % 50 <> 3 AS asked, CASE WHEN o_orderkey % 50 <> 3 THEN true END AS named FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 7 <> 2",
}
QUERIES = {name: globals()[name] for name in ORACLES}
