"""Export decisions and scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cases import CATEGORIES

# Reading issues by what they mean for an exported row.
MISSING_ISSUES = ("missing_value",)
SELECTION_ISSUES = ("low_field_confidence", "low_ocr_confidence", "provider_disagreement")


def decide(cases: DataFrame) -> DataFrame:
    """Adds status, review_reason, has_defect, defect_fields and blocker (exactly one of status and blocker is null).

    ``cases``: accepted, processing, report_present, report_current, pair_valid,
    complete, mismatches, unresolved, issues (of unresolved readings), and for
    cases without a report either ``no_report_reason`` (``issues.reason_without_report``;
    null where the pair should have been compared) or just n_attachments.
    """
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    issues = F.coalesce("issues", F.array().cast("array<string>"))
    mismatch, unresolved = some("mismatches"), some("unresolved")
    missing = F.exists(issues, lambda x: x.isin(*MISSING_ISSUES))
    unreadable = F.array_contains(issues, "low_ocr_confidence") & ~mismatch
    odd = F.exists(issues, lambda x: ~x.isin(*MISSING_ISSUES) & ~((x == "low_ocr_confidence") & ~mismatch))
    soft = F.forall(issues, lambda x: x.isin(*SELECTION_ISSUES)) & (F.size(issues) > 0)
    known = "no_report_reason" in cases.columns
    alone = F.col("no_report_reason") if known else F.when(F.col("n_attachments") == 0, "missing_attachment")
    compare = F.col("accepted") == "BL_COMPARISON"
    blocker = (
        F.when(F.col("processing") != "completed", "processing_incomplete")
        .when(F.col("accepted").isNull(), "category_unresolved")
        .when(~compare, None)
        .when(~F.col("report_present"), F.when(alone.isNull(), "comparison_missing"))
        .when(~F.col("pair_valid"), "pairing_unresolved")
        .when(~F.col("report_current"), "comparison_missing")
        .when(~F.col("complete"), "report_incomplete")
        .when(mismatch & unresolved & ~(missing & ~odd) & (missing | ~soft), "mixed_outcomes_unrepresentable")
        .when(~mismatch & unresolved & odd, "review_reason_unrepresentable")
        .when(~mismatch & missing & unreadable, "multiple_review_reasons_unrepresentable")
    )
    reason = F.when(blocker.isNull() & compare, F.when(~F.col("report_present"), alone).when(missing, "missing_value").when(unreadable, "unreadable"))
    defect = blocker.isNull() & compare & F.col("report_present") & reason.isNull() & mismatch
    status = F.when(blocker.isNull(), F.when(reason.isNotNull(), "NEEDS_REVIEW").when(defect, "MISMATCH").otherwise("OK"))
    out = cases.withColumn("blocker", blocker).withColumn("review_reason", reason).withColumn("status", status)
    return out.withColumn("has_defect", F.when(blocker.isNull(), defect)).withColumn("defect_fields", F.when(defect, F.col("mismatches")).otherwise(F.array().cast("array<string>")))


def incoherent(category: Column, status: Column, reason: Column, has_defect: Column, fields: Column) -> Column:
    """True for a row that the five rules of a prediction refuse."""
    ok = (
        (has_defect == (F.size(fields) > 0))
        & ((status == "MISMATCH") == has_defect)
        & ((status == "NEEDS_REVIEW") == reason.isNotNull())
        & ((category == "BL_COMPARISON") | (status == "OK"))
        & (F.size(F.array_distinct(fields)) == F.size(fields))
    )
    return ~F.coalesce(ok, F.lit(False))


def ratio(count: Column, total: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(total > 0, count / total)


def confusion(rows: DataFrame) -> DataFrame:
    """truth and a count for each predicted category (truth, predicted)."""
    return rows.groupBy("truth").pivot("predicted", list(CATEGORIES)).count().na.fill(0)


def class_scores(rows: DataFrame) -> DataFrame:
    """tp, fp, fn and f1 of each category in one shuffle; a category without support has f1 0."""
    votes = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("category"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("predicted")).cast("int").alias("hit")), F.struct(F.col("predicted").alias("category"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("v")).select("v.*")
    found = votes.groupBy("category").agg(F.sum("hit").alias("tp"), (F.sum("p") - F.sum("hit")).alias("fp"), (F.sum("t") - F.sum("hit")).alias("fn"))
    every = rows.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    full = every.join(found, "category", "left").na.fill(0)
    return full.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def macro_f1(rows: DataFrame) -> DataFrame:
    return class_scores(rows).agg(F.avg("f1").alias("macro_f1"))


def final_score(stage1: Column, stage3: Column, end_to_end: Column) -> Column:
    return 0.3 * stage1 + 0.2 * stage3 + 0.5 * end_to_end


def split_of(source_id: Column) -> Column:
    """holdout for one id in five, by a hash of the id."""
    return F.when(F.conv(F.substring(F.sha2(source_id, 256), 1, 8), 16, 10).cast("long") % 5 == 0, "holdout").otherwise("development")
