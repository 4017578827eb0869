"""Run monitoring, retries, and the cost ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS = 3


def retry_delay(attempts: Column) -> Column:
    """Seconds before the next attempt: 5, 10, 20 ... at most 60."""
    return F.when(attempts > 0, F.least(F.lit(60), F.lit(5) * F.pow(F.lit(2), attempts - 1)).cast("int")).otherwise(0)


def recoverable(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that are queued or whose lease is over, and exhausted, never dispatched or older than 15 minutes."""
    idle = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < now))
    stuck = (F.col("attempts") >= MOST_ATTEMPTS) | F.col("dispatched_at").isNull() | (F.col("created_at") < now - F.expr("INTERVAL 15 MINUTES"))
    return runs.where(idle & stuck)


def eligible(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that may be picked up: dispatched, attempts left, lease over and backoff elapsed."""
    waited = F.col("created_at") + F.make_dt_interval(secs=retry_delay(F.col("attempts"))) <= now
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < now))
    return runs.where(free & (F.col("attempts") < MOST_ATTEMPTS) & F.col("dispatched_at").isNotNull() & waited)


def metrics(runs: DataFrame) -> DataFrame:
    """One row: runs, attempts, retried, undispatched, oldest queued."""
    return runs.agg(
        F.count("*").alias("n_runs"),
        F.sum("attempts").cast("long").alias("attempts"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
        F.count_if((F.col("status") == "queued") & F.col("dispatched_at").isNull()).alias("undispatched"),
        F.min(F.when(F.col("status") == "queued", F.col("created_at"))).alias("oldest_queued"),
    )


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Micro-USD, rounded up."""
    return F.ceil(tokens_in * rate_in + tokens_out * rate_out).cast("long")


def settle(usage: DataFrame) -> DataFrame:
    """Adds settled_amount and state: unreported usage keeps its reservation, usage above it is an overage."""
    actual = cost(F.col("input_tokens"), F.col("output_tokens"), F.col("in_rate"), F.col("out_rate"))
    state = F.when(F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), "invalid_usage").when((F.col("in_rate") < 0) | (F.col("out_rate") < 0), "bad_rate").when(actual > F.col("amount"), "over_reservation").otherwise("settled")
    out = usage.withColumn("state", state)
    return out.withColumn("settled_amount", F.when(F.col("state") == "settled", actual).otherwise(F.col("amount")))


def ledger(settled: DataFrame) -> DataFrame:
    """Per purpose: reservations, what they hold, and whether an overage blocks new ones."""
    return settled.groupBy("purpose").agg(F.count("*").alias("n"), F.sum("settled_amount").alias("held"), F.count_if(F.col("state") == "settled").alias("n_settled"), F.coalesce(F.bool_or(F.col("state") == "over_reservation"), F.lit(False)).alias("blocked"))
