"""Manifests of evaluations: their rows, their policy, and the cases behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the splits of an evaluation
SPLITS = ("development", "holdout")


def manifest_rows(records: DataFrame) -> DataFrame:
    """``records`` (source_id, split, ...) with reason: missing_id, duplicate_id (every row of a repeated id) or bad_split; null where a row is good."""
    often = records.where("source_id <> ''").groupBy("source_id").agg(F.count("*").alias("_n")).where("_n > 1")
    marked = records.join(often, "source_id", "left")
    reason = F.when(F.coalesce("source_id", F.lit("")) == "", "missing_id").when(F.col("_n").isNotNull(), "duplicate_id").when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "bad_split")
    return marked.withColumn("reason", reason).drop("_n")


def manifest_differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """source_id, split, n_ours, n_theirs of rows that two manifests hold in unlike numbers; none, if they select the same."""
    sides = ours.select("source_id", "split", F.lit(1).alias("o"), F.lit(0).alias("t")).unionByName(theirs.select("source_id", "split", F.lit(0).alias("o"), F.lit(1).alias("t")))
    return sides.groupBy("source_id", "split").agg(F.sum("o").alias("n_ours"), F.sum("t").alias("n_theirs")).where("n_ours <> n_theirs")


def policy_fits(frozen: Column, current: Column, names: list[str]) -> Column:
    """Whether the named parts of a frozen policy equal those in force; two nulls are equal."""
    out = F.lit(True)
    for name in names:
        out = out & frozen[name].eqNullSafe(current[name])
    return out


def manifest_cases(records: DataFrame, cases: DataFrame) -> DataFrame:
    """source_id, case_id, state: case_missing unless the case exists in the record's workspace; ``cases``: case_id, workspace_id."""
    held = cases.select("case_id", "workspace_id").distinct().withColumn("_held", F.lit(True))
    found = records.select("source_id", "case_id", "workspace_id").join(held, ["case_id", "workspace_id"], "left")
    return found.select("source_id", "case_id", F.when(F.col("_held"), "present").otherwise("case_missing").alias("state"))
