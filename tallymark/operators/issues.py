"""Issues of documents and reports: reading, scope, blocking, and the reasons that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: reviewer actions that make a result assisted, and what a failure is called
REVIEW_ACTIONS = ("category", "pair", "correct")
FAILURES = {"BudgetUnavailable": "budget_unavailable", "MissingDocument": "source_unavailable", "InvalidCheckpoint": "checkpoint_invalid"}
#: Type of a structured issue.
ISSUE = "struct<code:string,detail:string,scope:string,blocking:boolean>"
_NONE = "array<string>"


def parse_issue(text: Column) -> Column:
    """``code:detail`` as a blocking issue of unknown scope; an empty text or code is unknown_issue."""
    code = F.trim(F.substring_index(text, ":", 1))
    detail = F.when(F.instr(text, ":") > 0, F.trim(F.regexp_replace(text, r"(?s)^[^:]*:", ""))).otherwise("")
    return F.struct(F.when(F.coalesce(code, F.lit("")) == "", "unknown_issue").otherwise(code).alias("code"), F.coalesce(detail, F.lit("")).alias("detail"), F.lit("unknown").alias("scope"), F.lit(True).alias("blocking"))


def issue_text(issue: Column) -> Column:
    return F.when(F.coalesce(issue["detail"], F.lit("")) != "", F.concat(issue["code"], F.lit(":"), issue["detail"])).otherwise(issue["code"])


def scoped(issues: Column, selected: Column) -> Column:
    """Issues of a document, marked by whether the document belongs to the compared pair."""
    scope = F.when(selected, "selected_pair").otherwise("unused_attachment")
    return F.transform(issues, lambda x: F.struct(x["code"].alias("code"), x["detail"].alias("detail"), scope.alias("scope"), x["blocking"].alias("blocking")))


def blocking(cases: DataFrame) -> DataFrame:
    """Adds blocking and unused_warnings (sorted, distinct texts).

    ``cases``: pair_issues and report_issues (arrays of issues), review_reasons
    (texts).  Issues of unused attachments are warnings, others that block are
    blocking, and so is every reason.
    """
    every = F.concat(F.coalesce("pair_issues", F.array().cast(f"array<{ISSUE}>")), F.coalesce("report_issues", F.array().cast(f"array<{ISSUE}>")))
    unused = F.filter(every, lambda x: x["scope"] == "unused_attachment")
    stops = F.filter(every, lambda x: (x["scope"] != "unused_attachment") & x["blocking"])
    ordered = lambda texts: F.array_sort(F.array_distinct(texts))
    reasons = F.coalesce("review_reasons", F.array().cast(_NONE))
    out = cases.withColumn("blocking", ordered(F.concat(F.transform(stops, issue_text), reasons)))
    return out.withColumn("unused_warnings", ordered(F.transform(unused, issue_text)))


def reasons_of_report(report_issues: Column, unresolved_issues: Column) -> Column:
    """Review reasons after a report: its issues and those of its unresolved readings."""
    return F.array_union(F.coalesce(report_issues, F.array().cast(_NONE)), F.coalesce(unresolved_issues, F.array().cast(_NONE)))


def roles(attachments: DataFrame) -> DataFrame:
    """case_id, n_current, n_si, n_bl, n_unreadable, si_id, bl_id (the explicit pair: one readable SI and one readable BL, else null).

    ``attachments``: case_id, attachment_id, role, superseded, has_evidence, n_blocks, n_issues.
    """
    current = attachments.where("not superseded")
    usable = lambda role: (F.col("role") == role) & F.col("has_evidence")
    unreadable = ~F.col("has_evidence") | (F.col("n_blocks") == 0) | (F.col("n_issues") > 0)
    one = lambda role: F.max(F.when(usable(role), F.col("attachment_id")))
    out = current.groupBy("case_id").agg(
        F.count("*").alias("n_current"), F.count_if(F.col("role") == "SI").alias("n_si"), F.count_if(F.col("role") == "BL").alias("n_bl"), F.count_if(unreadable).alias("n_unreadable"),
        F.count_if(usable("SI")).alias("_si"), F.count_if(usable("BL")).alias("_bl"), one("SI").alias("si_id"), one("BL").alias("bl_id"),
    )
    pair = (F.col("_si") == 1) & (F.col("_bl") == 1)
    return out.withColumn("si_id", F.when(pair, F.col("si_id"))).withColumn("bl_id", F.when(pair, F.col("bl_id"))).drop("_si", "_bl")


def reason_without_report(cases: DataFrame) -> Column:
    """Why a case of ``roles`` has no report; null if its pair should have been compared."""
    return F.when(F.coalesce("n_current", F.lit(0)) < 2, "missing_attachment").when(F.col("n_unreadable") > 0, "unreadable").when((F.col("n_si") != 1) | (F.col("n_bl") != 1), "wrong_doc_type")


def pair_selection_reason(n_documents: Column, n_unread: Column, n_si: Column, n_bl: Column) -> Column:
    """What a reviewer should do about a pair that can't be chosen, as a code."""
    missing = F.when(n_si == 1, "bl_missing").when(n_bl == 1, "si_missing").otherwise("both_missing")
    return F.when(n_documents == 0, "waiting_for_documents").when(n_unread > 0, "document_unreadable").when((n_si > 1) | (n_bl > 1), "several_documents").otherwise(missing)


def reviewer_assisted(history: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, actions (sorted), reviewer_assisted.

    ``history``: case_id, action, actor.  ``cases``: case_id, source (of the
    category) and human_reading (a reading that no machine made).
    """
    done = history.where(F.col("action").isin(*REVIEW_ACTIONS) & (F.col("actor") != "Processing")).groupBy("case_id").agg(F.collect_set("action").alias("_done"))
    out = cases.join(done, "case_id", "left")
    own = F.when(F.coalesce(F.col("source") == "human", F.lit(False)), F.array(F.lit("category"))).otherwise(F.array().cast(_NONE))
    actions = F.array_sort(F.array_union(F.coalesce("_done", F.array().cast(_NONE)), own))
    return out.select("case_id", actions.alias("actions"), ((F.size(actions) > 0) | F.coalesce("human_reading", F.lit(False))).alias("reviewer_assisted"))


def failure_stage(error: Column) -> Column:
    out = F.lit("processing_failed")
    for kind, name in FAILURES.items():
        out = F.when(error == kind, name).otherwise(out)
    return out


def request_bounds(payload_bytes: Column, questions: Column) -> tuple[Column, Column]:
    """Upper bounds of input and output tokens; null outside 0..100000 bytes and 1..10 questions."""
    ok = payload_bytes.between(0, 100_000) & questions.between(1, 10)
    return F.when(ok, payload_bytes * (questions + 1) * 2 + 32768), F.when(ok, F.lit(32768))
