"""Runs with their outbox, reservations with reported usage, and requests about pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operations import MOST_ATTEMPTS, cost
from .references import tokens

# Fixed values.
PURPOSES = ("demo", "development")
STALE = "INTERVAL 15 MINUTES"
MOST_SHARED, MOST_REQUEST_BYTES, LEAST_OCR = 32, 80_000, 0.9


def service_metrics(runs: DataFrame, outbox: DataFrame, cases: DataFrame, now: Column) -> DataFrame:
    """One row: attempts, retried, oldest_queued_seconds, undispatched, cases, needs_review, review_rate.

    ``runs``: run_id, status, attempts, created_at; ``outbox``: run_id,
    dispatched_at; ``cases``: case_id, needs_review.  Nothing to count is 0.
    """
    oldest = F.min(F.when(F.col("status") == "queued", F.col("created_at")))
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("oldest"))
    own = runs.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.count_if(F.col("attempts") > 1).alias("retried"), oldest.alias("oldest"))
    own = own.select("attempts", "retried", F.coalesce(age, F.lit(0)).alias("oldest_queued_seconds"))
    waiting = outbox.agg(F.count_if(F.col("dispatched_at").isNull()).alias("undispatched"))
    held = cases.agg(F.count("*").alias("cases"), F.count_if("needs_review").alias("needs_review"))
    held = held.withColumn("review_rate", F.when(F.col("cases") > 0, F.col("needs_review") / F.col("cases")).otherwise(0.0))
    rows = own.unionByName(waiting, True).unionByName(held, True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def recover(runs: DataFrame, outbox: DataFrame, now: Column) -> DataFrame:
    """run_id, action of runs that need one: ``fail`` after the last attempt, ``enter`` those that no outbox knows, ``send_again`` the others.

    A run is looked at if it is queued, or its lease is unknown or over, and it
    is exhausted, not dispatched, or was dispatched a quarter of an hour ago.
    """
    idle = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now)))
    spent = F.col("attempts") >= MOST_ATTEMPTS
    known = outbox.select("run_id", "dispatched_at", F.lit(True).alias("known"))
    out = runs.where(idle).select("run_id", "attempts").join(known, "run_id", "left")
    out = out.where(spent | F.col("dispatched_at").isNull() | (F.col("dispatched_at") <= now - F.expr(STALE)))
    action = F.when(spent, "fail").when(F.col("known").isNull(), "enter").otherwise("send_again")
    return out.select("run_id", action.alias("action"))


def lost_dispatches(runs: DataFrame, outbox: DataFrame) -> DataFrame:
    """run_id, problem where one side lacks the other: outbox rows without a run, waiting runs without an outbox row."""
    both = runs.select("run_id", "status").join(outbox.select("run_id", F.lit(True).alias("sent")), "run_id", "full")
    problem = F.when(F.col("status").isNull(), "no_run").when(F.col("sent").isNull() & (F.col("status") == "queued"), "no_outbox")
    return both.select("run_id", problem.alias("problem")).where("problem is not null")


def settle_reservations(reservations: DataFrame, usage: DataFrame, ledger: DataFrame) -> DataFrame:
    """reservation_id, purpose, state, charged: reservations met with reported usage, in full.

    ``reservations``: reservation_id, purpose, amount, in_rate, out_rate;
    ``usage``: reservation_id, input_tokens, output_tokens, one row a report
    (the first settles, so the least counts); ``ledger``: purpose, held.  Usage
    of no reservation is ``unknown_reservation``; a reservation without usage
    keeps its amount and has no state.
    """
    reports = usage.groupBy("reservation_id").agg(F.min(F.struct("input_tokens", "output_tokens")).alias("report"))
    held = ledger.select("purpose", "held")
    met = reservations.join(reports, "reservation_id", "full").join(held, "purpose", "left")
    counts = (F.col("report.input_tokens") >= 0) & (F.col("report.output_tokens") >= 0)
    rates = (F.col("in_rate") >= 0) & (F.col("out_rate") >= 0)
    actual = cost(F.col("report.input_tokens"), F.col("report.output_tokens"), F.col("in_rate"), F.col("out_rate"))
    state = (
        F.when(F.col("amount").isNull(), "unknown_reservation")
        .when(F.col("report").isNull(), None)
        .when(~F.coalesce(counts, F.lit(False)), "invalid_usage")
        .when(~F.coalesce(rates, F.lit(False)), "bad_rate")
        .when(actual > F.col("amount"), "over_reservation")
        .when(~F.coalesce(F.col("purpose").isin(*PURPOSES), F.lit(False)), "unknown_purpose")
        .when(F.coalesce("held", F.lit(0)) < F.col("amount"), "low_ledger")
        .otherwise("settled")
    )
    out = met.withColumn("state", state)
    return out.select("reservation_id", "purpose", "state", F.when(F.col("state") == "settled", actual).otherwise(F.coalesce("amount", F.lit(0))).alias("charged"))


def pair_requests(cases: DataFrame, blocks: DataFrame, policy: str) -> DataFrame:
    """case_id, n_shared, n_bytes, request (null beyond the bounds), fingerprint.

    ``cases``: case_id, subject, body, blocked (a blocking issue or a conflict);
    ``blocks``: case_id, role, block, text, method, ocr (0 to 1).  A case asks
    about the identifier-like tokens that both sides hold, 1 to 32 of them, in
    at most 80,000 bytes; text that a reader of images was unsure of gives no
    token.  The fingerprint names the request and the policy.  A subject and
    body beyond the bound are measured where they stand and never shuffled or
    broadcast; only their number of bytes goes on.
    """
    sure = (F.col("method") != "ocr") | (F.coalesce("ocr", F.lit(0.0)) >= LEAST_OCR)
    found = blocks.where(sure).select("case_id", "role", F.explode(F.array_distinct(F.transform(tokens(F.col("text")), F.upper))).alias("token"))
    shared = found.groupBy("case_id", "token").agg(F.count_distinct("role").alias("sides")).where("sides = 2")
    shared = shared.groupBy("case_id").agg(F.array_sort(F.collect_list("token")).alias("candidates"))
    confidence = F.when(F.col("method") == "ocr", F.coalesce("ocr", F.lit(0.0))).otherwise(1.0).alias("confidence")
    side = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("block", F.coalesce("text", F.lit("")).alias("text"), confidence)))).alias(role.lower())
    texts = blocks.groupBy("case_id").agg(side("SI"), side("BL"))
    as_json = lambda *names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    heads = cases.where(~F.coalesce("blocked", F.lit(True))).select("case_id", as_json("subject", "body").alias("head")).withColumn("head_bytes", F.octet_length("head"))
    heads = heads.withColumn("head", F.when(F.col("head_bytes") <= MOST_REQUEST_BYTES, F.col("head")))
    # Spark can't estimate texts that are made up on the way, so it is told not to broadcast them
    out = heads.hint("merge").join(shared, "case_id").join(texts.hint("merge"), "case_id")
    out = out.withColumn("n_shared", F.size("candidates")).withColumn("tail", as_json("si", "bl", "candidates"))
    out = out.withColumn("n_bytes", F.col("head_bytes") + F.octet_length("tail") - 1)
    asked = F.concat(F.expr("substring(head, 1, char_length(head) - 1)"), F.lit(","), F.expr("substring(tail, 2)"))
    fits = F.col("n_shared").between(1, MOST_SHARED) & (F.col("n_bytes") <= MOST_REQUEST_BYTES)
    out = out.withColumn("request", F.when(fits, asked))
    return out.select("case_id", "n_shared", "n_bytes", "request", F.when(fits, F.sha2(F.concat_ws("\n", F.lit(policy), "request"), 256)).alias("fingerprint"))
