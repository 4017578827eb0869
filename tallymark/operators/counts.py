"""Totals and small counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intake import basename


def pages_of(total: Column, size: int) -> Column:
    """Number of pages, one at least."""
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def total_and_pages(cases: DataFrame, size: int = 25) -> DataFrame:
    return cases.agg(F.count("*").alias("total")).withColumn("pages", pages_of(F.col("total"), size))


def outcomes(results: DataFrame, failures: DataFrame) -> DataFrame:
    """outcome, n of imported rows and of rows that could not be parsed."""
    return results.select("outcome").unionByName(failures.select(F.lit("failed").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


def attachment_limits(attachments: DataFrame, *, most_files: int = 8, most_bytes: int = 20_000_000) -> DataFrame:
    """email_id, n_files, n_bytes, within."""
    out = attachments.groupBy("email_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    return out.withColumn("within", (F.col("n_files") <= most_files) & (F.col("n_bytes") <= most_bytes))


def suffixes(paths: DataFrame) -> DataFrame:
    """suffix, n: files of each kind, lower case; a name without a dot has an empty suffix."""
    return paths.groupBy(F.lower(F.regexp_extract(basename(F.col("path")), r"[^.](\.[^.]*)$", 1)).alias("suffix")).agg(F.count("*").alias("n"))


def selection(candidates: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    """key, state: candidates are selected, or excluded if they are asked to be; other exclusions are unknown."""
    asked = exclusions.select(key).distinct().withColumn("_asked", F.lit(True))
    there = candidates.select(key).distinct().withColumn("_there", F.lit(True))
    state = F.when(F.col("_there").isNull(), "unknown").when(F.col("_asked"), "excluded").otherwise("selected")
    return there.join(asked, key, "full").select(key, state.alias("state"))


def first_in_order(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)


def chunks(rows: DataFrame, order: str, size: int = 100) -> DataFrame:
    """``rows`` with chunk: groups of ``size`` in order.

    Ranges of the order are numbered apart and a prefix sum over one row for each
    says where they begin, so no task sees all rows.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id())
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return numbered.join(bases, "_part").withColumn("chunk", F.floor((F.col("_base") + F.col("_at") - 1) / size)).drop("_part", "_at", "_base")


def changed_flags(cases: DataFrame, recomputed: DataFrame, flags: list[str]) -> DataFrame:
    """One row: how many cases a recomputation of their flags would change."""
    new = recomputed.select("case_id", *(F.col(f).alias(f"_{f}") for f in flags))
    same = F.lit(True)
    for f in flags:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return cases.join(new, "case_id").agg(F.count("*").alias("checked"), F.count_if(~same).alias("changed"))


def stable_attachments(attachments: DataFrame) -> DataFrame:
    """email_id, files: distinct (filename, sha256) in a fixed order, so a digest of them does not depend on the order of arrival."""
    return attachments.groupBy("email_id").agg(F.sort_array(F.collect_set(F.struct("filename", "sha256"))).alias("files"))


def suite_summary(cases: DataFrame) -> DataFrame:
    """One row over a synthetic suite (correct, clear, has_defect, caught, review): its headline counts."""
    return cases.agg(
        F.count("*").alias("n"), F.count_if("correct").alias("complete_correct"), F.count_if(F.col("clear") & F.col("has_defect")).alias("false_clear"),
        F.count_if("has_defect").alias("defects"), F.count_if(F.col("has_defect") & F.col("caught")).alias("defects_caught"), F.count_if("review").alias("review_required"),
    )


def stage_times(events: DataFrame) -> DataFrame:
    """run_id, path, calls, total_ms, own_ms: a stage's own time is without that of its direct children (``a/b`` is a child of ``a``)."""
    total = events.groupBy("run_id", "path").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"))
    inner = total.where(F.instr("path", "/") > 0).groupBy("run_id", F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.sum("total_ms").alias("_inner"))
    out = total.join(inner, ["run_id", "path"], "left")
    return out.select("run_id", "path", "calls", "total_ms", (F.col("total_ms") - F.coalesce("_inner", F.lit(0))).alias("own_ms"))
