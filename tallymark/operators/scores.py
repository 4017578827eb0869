"""Scores of exported rows against labels.

Rows carry ``case_id``; a prediction's columns are category, status,
review_reason, has_defect, defect_fields, the label's the same with ``t_`` before
them.  ``status`` is null for a case without a prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .export import ratio

# fixed values
TERMINAL_PROCESSING = ("completed", "failed")
TERMINAL_RUNS = ("completed", "failed", "superseded")


def signature(prefix: str = "") -> Column:
    """What makes two rows the same: four values and the defect fields in any order."""
    own = [F.col(prefix + c) for c in ("category", "status", "review_reason", "has_defect")]
    return F.struct(*own, F.array_sort(prefix + "defect_fields"))


def exported(rows: DataFrame) -> DataFrame:
    """Rows with a prediction, with decided (automatic or reviewer_assisted) and exact."""
    decided = F.when(F.col("reviewer_assisted"), "reviewer_assisted").otherwise("automatic")
    return rows.where("status is not null").withColumn("decided", decided).withColumn("exact", signature() == signature("t_"))


def blocked_but_predicted(rows: DataFrame) -> DataFrame:
    """Rows that break the rule that a blocked case has no prediction."""
    return rows.where(F.col("status").isNotNull() & (F.size("blockers") > 0))


def blocker_counts(rows: DataFrame) -> DataFrame:
    """blocker, n: a case without blockers and without a prediction counts as prediction_missing."""
    held = F.when(F.size("blockers") > 0, F.col("blockers")).when(F.col("status").isNull(), F.array(F.lit("prediction_missing")))
    return rows.select(F.explode(held).alias("blocker")).groupBy("blocker").agg(F.count("*").alias("n"))


def export_rates(rows: DataFrame) -> DataFrame:
    """One row: how many cases were exported by whom, and their share of all."""
    there, assisted = F.col("status").isNotNull(), F.col("reviewer_assisted")
    out = rows.agg(
        F.count("*").alias("selected"), F.count_if(there & ~assisted).alias("automatic"), F.count_if(assisted).alias("assisted_selected"),
        F.count_if(there & assisted).alias("assisted"), F.count_if(~there & assisted).alias("assisted_abstained"), F.count_if(~there).alias("abstained"),
    )
    return out.withColumn("automatic_coverage", ratio(F.col("automatic"), F.col("selected"))).withColumn("assisted_coverage", ratio(F.col("assisted"), F.col("selected")))


def exact_rows(rows: DataFrame) -> DataFrame:
    """decided (all, automatic, reviewer_assisted), correct, n, accuracy."""
    found = exported(rows).rollup("decided").agg(F.count_if("exact").alias("correct"), F.count("*").alias("n"))
    return found.select(F.coalesce("decided", F.lit("all")).alias("decided"), "correct", "n", ratio(F.col("correct"), F.col("n")).alias("accuracy"))


def wrong_rows(rows: DataFrame) -> DataFrame:
    """Ids of exported rows that differ from their label."""
    return exported(rows).where(~F.coalesce("exact", F.lit(False))).select("case_id")


def _rates(tp: Column, predicted: Column, actual: Column) -> list[Column]:
    """precision, recall and f1; 0 where there is nothing to divide by."""
    f1 = F.when(predicted + actual > 0, 2 * tp / (predicted + actual)).otherwise(0.0)
    return [F.coalesce(ratio(tp, predicted), F.lit(0.0)).alias("precision"), F.coalesce(ratio(tp, actual), F.lit(0.0)).alias("recall"), f1.alias("f1")]


def defect_scores(rows: DataFrame) -> DataFrame:
    """tp, predicted, actual, precision, recall, f1 of has_defect."""
    said, true = F.coalesce("has_defect", F.lit(False)), F.coalesce("t_has_defect", F.lit(False))
    out = rows.agg(F.count_if(said & true).alias("tp"), F.count_if(said).alias("predicted"), F.count_if(true).alias("actual"))
    return out.select("tp", "predicted", "actual", *_rates(F.col("tp"), F.col("predicted"), F.col("actual")))


def end_to_end(rows: DataFrame) -> DataFrame:
    """caught, planted, rate: labelled defects whose exported row is right in full."""
    planted = rows.where("t_has_defect")
    out = planted.agg(F.count_if(F.col("status").isNotNull() & (signature() == signature("t_"))).alias("caught"), F.count("*").alias("planted"))
    return out.withColumn("rate", F.coalesce(ratio(F.col("caught"), F.col("planted")), F.lit(0.0)))


def escalation(rows: DataFrame) -> DataFrame:
    """t_reason (each labelled review reason, and all), caught, labelled; for all also predicted, precision, recall, f1."""
    said, due = F.coalesce(F.col("status") == "NEEDS_REVIEW", F.lit(False)), F.coalesce(F.col("t_status") == "NEEDS_REVIEW", F.lit(False))
    flags = rows.select(F.when(due, F.coalesce("t_review_reason", F.lit("unknown"))).alias("t_reason"), said.alias("said"), due.alias("due"))
    each = flags.where("due").groupBy("t_reason").agg(F.count_if("said").alias("caught"), F.count("*").alias("labelled"))
    every = flags.agg(F.count_if(F.col("said") & F.col("due")).alias("caught"), F.count_if("due").alias("labelled"), F.count_if("said").alias("predicted"))
    rates = _rates(F.col("caught"), F.col("predicted"), F.col("labelled"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("predicted", "long"), ("precision", "double"), ("recall", "double"), ("f1", "double"))]
    return each.select("t_reason", "caught", "labelled", *nothing).unionByName(every.select(F.lit("all").alias("t_reason"), "caught", "labelled", "predicted", *rates))


def processing_metrics(rows: DataFrame) -> DataFrame:
    """terminal, failed, incomplete by ``processing`` and ``run_status``; a failed run overrides the case."""
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    terminal = known("processing", TERMINAL_PROCESSING) | known("run_status", TERMINAL_RUNS)
    failed = known("processing", ("failed",)) | known("run_status", ("failed",))
    return rows.agg(F.count_if(terminal).alias("terminal"), F.count_if(failed).alias("failed"), F.count_if(~terminal).alias("incomplete"))


def comparison_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """decided (all, automatic, reviewer_assisted), representable, exact, n_match, n_mismatch, n_unresolved, correct, n_fields, accuracy.

    ``found``: case_id, field, outcome.  ``truth``: case_id, t_defect_fields and
    reviewer_assisted (null without a diagnostic: such a case counts in all only).
    A case takes part if it has each of the seven fields once.
    """
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    fields = F.sort_array(F.collect_list("field"))
    mismatched = F.collect_list(F.when(F.col("outcome") == "mismatch", F.col("field")))
    matched = F.collect_list(F.when(F.col("outcome") == "match", F.col("field")))
    cases = found.groupBy("case_id").agg(fields.alias("fields"), mismatched.alias("mm"), matched.alias("m"), *(count(o).alias(f"n_{o}") for o in ("match", "mismatch", "unresolved")))
    whole = cases.where(F.col("fields") == F.array(*map(F.lit, sorted(L.FIELDS)))).join(truth, "case_id")
    correct = F.size(F.array_intersect("mm", "t_defect_fields")) + F.size(F.array_except("m", "t_defect_fields"))
    rows = whole.withColumn("correct", correct)
    decided = F.when(F.col("reviewer_assisted"), "reviewer_assisted").when(~F.col("reviewer_assisted"), "automatic")
    kinds = F.explode(F.array_compact(F.array(F.lit("all"), decided))).alias("decided")
    sums = [F.sum(c).alias(c) for c in ("n_match", "n_mismatch", "n_unresolved", "correct")]
    out = rows.select(kinds, "correct", "n_match", "n_mismatch", "n_unresolved").groupBy("decided").agg(F.count("*").alias("representable"), F.count_if(F.col("correct") == len(L.FIELDS)).alias("exact"), *sums)
    return out.withColumn("n_fields", F.col("representable") * len(L.FIELDS)).withColumn("accuracy", ratio(F.col("correct"), F.col("n_fields")))


def micro_f1(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, predicted, actual, precision, recall, f1 over pairs of case and field."""
    said = found.where("outcome = 'mismatch'").select("case_id", "field", F.lit(True).alias("said")).distinct()
    true = truth.select("case_id", F.explode("t_defect_fields").alias("field"), F.lit(True).alias("true")).distinct()
    out = said.join(true, ["case_id", "field"], "full").agg(F.count_if(F.col("said") & F.col("true")).alias("tp"), F.count("said").alias("predicted"), F.count("true").alias("actual"))
    return out.select("tp", "predicted", "actual", *_rates(F.col("tp"), F.col("predicted"), F.col("actual")))
