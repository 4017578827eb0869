"""Registered queries on manifests derived from orders, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import manifests
from .corpus import table

_SPLIT = "CASE WHEN o_orderkey % 19 = 0 THEN 'test' WHEN o_orderkey % 4 = 0 THEN 'holdout' ELSE 'development' END"
_ID = "CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN CAST(o_custkey AS VARCHAR(20)) ELSE concat('e', CAST(o_orderkey AS VARCHAR(20))) END"
_RECORDS = f"SELECT {_ID} AS source_id, {_SPLIT} AS split, o_orderkey AS case_id, o_custkey % 5 AS workspace_id, o_orderkey FROM orders"


def _records(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.expr(_ID.replace("VARCHAR(20)", "STRING")).alias("source_id"), F.expr(_SPLIT).alias("split"), F.col("o_orderkey").alias("case_id"), F.expr("o_custkey % 5").alias("workspace_id"), "o_orderkey")


def manifest_reasons(spark, sf_dir):
    return manifests.manifest_rows(_records(spark, sf_dir)).select(F.col("case_id").alias("record"), "source_id", "split", "reason")


def manifest_changes(spark, sf_dir):
    """Against a manifest that lacks some rows and has others in another split."""
    ours = _records(spark, sf_dir)
    theirs = ours.where("o_orderkey % 31 <> 0").withColumn("split", F.expr("CASE WHEN o_orderkey % 37 = 0 THEN 'holdout' ELSE split END"))
    return manifests.manifest_differences(ours, theirs)


def manifest_presence(spark, sf_dir):
    records = _records(spark, sf_dir)
    cases = records.where("o_orderkey % 7 <> 0").select("case_id", F.expr("CASE WHEN o_orderkey % 11 = 0 THEN workspace_id + 1 ELSE workspace_id END").alias("workspace_id"))
    return manifests.manifest_cases(records, cases)


def manifest_policies(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    frozen = F.struct(F.expr("o_orderkey % 3").alias("version"), F.expr("CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 2 END").alias("model"))
    current = F.struct(F.lit(1).alias("version"), F.expr("CASE WHEN o_orderkey % 10 > 0 THEN 1 END").alias("model"))
    rows = orders.select("o_orderkey", frozen.alias("frozen"), current.alias("current"))
    return rows.select("o_orderkey", manifests.policy_fits(F.col("frozen"), F.col("current"), ["version", "model"]).alias("fits"))


ORACLES = {
    "manifest_reasons": f"""WITH r AS ({_RECORDS}), n AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM r)
SELECT case_id AS record, source_id, split, CASE WHEN source_id = '' THEN 'missing_id' WHEN n > 1 THEN 'duplicate_id' WHEN split NOT IN ('development', 'holdout') THEN 'bad_split' END AS reason FROM n""",
    "manifest_changes": f"""WITH r AS ({_RECORDS}), o AS (SELECT source_id, split, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT source_id, split, count(*) AS n FROM (SELECT source_id, CASE WHEN o_orderkey % 37 = 0 THEN 'holdout' ELSE split END AS split FROM r WHERE o_orderkey % 31 <> 0) GROUP BY ALL)
SELECT source_id, split, coalesce(o.n, 0) AS n_ours, coalesce(t.n, 0) AS n_theirs FROM o FULL JOIN t USING (source_id, split) WHERE coalesce(o.n, 0) <> coalesce(t.n, 0)""",
    "manifest_presence": f"WITH r AS ({_RECORDS}) SELECT source_id, case_id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'present' ELSE 'case_missing' END AS state FROM r",
    "manifest_policies": "SELECT o_orderkey, o_orderkey % 3 = 1 AND (CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 2 END) IS NOT DISTINCT FROM (CASE WHEN o_orderkey % 10 > 0 THEN 1 END) AS fits FROM orders",
}
QUERIES = {name: globals()[name] for name in ORACLES}
