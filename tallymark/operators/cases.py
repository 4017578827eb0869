"""Case status: classification policy, assessment, summary, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY", "GENERAL", "SPAM")  # fixed values
PAGE_LIMIT = 100


def accepted_category(suggested: Column, confidence: Column, *, least: float = 0.80, least_spam: float = 0.95) -> Column:
    """The suggestion if it is confident enough, else null."""
    return F.when(~F.isnan(confidence.cast("double")) & (confidence >= F.when(suggested == "SPAM", least_spam).otherwise(least)), suggested)


def distribution_error(selected: Column, confidence: Column, probabilities: Column, allowed: Column) -> Column:
    """Null for a sound choice: allowed keys exactly, finite 0..1, sum 1 within 0.02, the selected one the largest."""
    values = F.map_values(probabilities)
    finite = F.forall(values, lambda x: (~F.isnan(x)) & x.between(0.0, 1.0))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(F.array_sort(F.map_keys(probabilities)) != F.array_sort(allowed), "keys")
        .when(~finite | F.isnan(confidence) | ~confidence.between(0.0, 1.0), "range")
        .when(F.abs(total - 1) > 0.02, "sum")
        .when(F.try_element_at(probabilities, selected) < F.array_max(values), "not_largest")
    )


def is_spam(accepted: Column, suggested: Column, source: Column) -> Column:
    """Accepted as spam, or suggested by other than a human and undecided; never null."""
    return F.coalesce(accepted == "SPAM", F.lit(False)) | F.coalesce(accepted.isNull() & (suggested == "SPAM") & (source != "human"), F.lit(False))


def spam_status(accepted: Column, suggested: Column, source: Column) -> Column:
    return F.when(F.coalesce(accepted == "SPAM", F.lit(False)), "confirmed").when(is_spam(accepted, suggested, source), "suspected")


def assess(cases: DataFrame) -> DataFrame:
    """Adds can_be_clear and needs_review.

    ``cases``: accepted, processing, report_present, report_current, pair_valid,
    complete, mismatches, unresolved, blocking (arrays), unused_warnings, review_reasons.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    sound = yes("report_present") & yes("report_current") & yes("complete") & yes("pair_valid")
    clear = F.coalesce(F.col("accepted") == "BL_COMPARISON", F.lit(False)) & sound & ~some("mismatches") & ~some("unresolved") & ~some("blocking")
    stopped = some("blocking") | some("review_reasons") | (F.col("processing") == "failed")
    other = F.col("accepted").isNotNull() & (F.col("accepted") != "BL_COMPARISON")
    review = F.when(other, stopped).otherwise(stopped | some("unused_warnings") | ~sound | some("unresolved") | some("mismatches") | F.col("accepted").isNull())
    return cases.withColumn("can_be_clear", clear).withColumn("needs_review", review)


def summary_kind(cases: DataFrame) -> Column:
    """One of eleven kinds, for rows that went through ``assess``."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = spam_status(F.col("accepted"), F.col("suggested"), F.col("source"))
    blocked = ~yes("pair_valid") | ~yes("report_current") | some("blocking") | some("unused_warnings") | ~yes("complete") | some("unresolved")
    return (
        F.when(status == "confirmed", "spam")
        .when(status == "suspected", "suspected_spam")
        .when(F.col("processing") != "completed", F.col("processing"))
        .when(F.col("suggested").isNull() & F.col("accepted").isNull(), "unclassified")
        .when(F.col("accepted").isNull(), "needs_review")
        .when(F.col("accepted") != "BL_COMPARISON", F.when(F.col("needs_review"), "needs_review").otherwise("categorized"))
        .when(~yes("report_present"), "needs_review")
        .when(some("mismatches"), F.when(blocked, "mismatch_review").otherwise("mismatch"))
        .otherwise(F.when(blocked, "needs_review").otherwise("match"))
    )


def outstanding(spam: Column, needs_review: Column, has_mismatch: Column, workflow: Column) -> Column:
    return ~spam & (needs_review | has_mismatch) & (workflow == "open")


def queue(cases: DataFrame, view: str = "all", *, workspace_id=None, query: str | None = None, category: str | None = None, assignee: str | None = None) -> DataFrame:
    """Cases of a view; ``cases`` has spam, needs_review, has_mismatch, workflow, accepted, suggested, subject."""
    spam = F.col("spam")
    views = {
        "all": F.lit(True),
        "mismatches": ~spam & F.col("has_mismatch"),
        "spam": spam,
        "review": outstanding(spam, F.col("needs_review"), F.col("has_mismatch"), F.col("workflow")),
        "waiting": ~spam & (F.col("workflow") == "waiting"),
        "completed": ~spam & (F.col("workflow") == "completed"),
    }
    if view not in views:
        raise ValueError(f"view {view!r} is none of {sorted(views)}")
    out = cases.where(views[view])
    if workspace_id is not None:
        out = out.where(F.col("workspace_id") == workspace_id)
    if query:
        if len(query) > 200:
            raise ValueError("a query has at most 200 characters")
        out = out.where(F.col("subject").ilike(f"%{query}%"))
    if category:
        out = out.where(spam if category == "SPAM" else F.coalesce("accepted", "suggested") == category)
    return out.where(F.col("assignee") == assignee) if assignee else out


def page(cases: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """Newest first; ties by case."""
    if number < 1 or not 1 <= size <= PAGE_LIMIT:
        raise ValueError(f"number >= 1, 1 <= size <= {PAGE_LIMIT}")
    return cases.orderBy(F.desc("received_at"), "case_id").offset((number - 1) * size).limit(size)


def counts(cases: DataFrame) -> DataFrame:
    """Spam and outstanding reviews of each workspace in one pass."""
    review = outstanding(F.col("spam"), F.col("needs_review"), F.col("has_mismatch"), F.col("workflow"))
    return cases.groupBy("workspace_id").agg(F.count("*").alias("n_cases"), F.count_if("spam").alias("n_spam"), F.count_if(review).alias("n_review"))
