"""What outside readers propose, and when it is taken.

Proposals enter as tables; everything here is a column expression or an
aggregate that combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .cases import distribution_error

MOST_PREVIEWS = 4  # fixed value
LEAST_ROLE, LEAST_PAIR = 0.80, 0.95  # fixed values


def role_of(role: Column, confidence: Column, paired_as: Column) -> Column:
    """The role of an explicit pair, else the proposed one if it is confident enough, else UNKNOWN."""
    sure = ~F.isnan(confidence.cast("double")) & (confidence >= LEAST_ROLE)
    return F.coalesce(paired_as, F.when(sure, role), F.lit("UNKNOWN"))


def cascade_step(accepted: Column, suggested: Column, n_files: Column, accepted_by_names: Column, n_previews: Column, has_empty: Column) -> Column:
    """Which of three proposals counts: that on text, on names of files too, or on previews of files too.

    A decided text other than GENERAL stands, and so does a decision on names.
    Previews are for at most four documents, none of them empty; with no
    previews at hand (null count) the text stands.
    """
    alone = (n_files == 0) | F.coalesce(accepted.isNotNull() & (suggested != "GENERAL"), F.lit(False))
    seen = n_files.between(1, MOST_PREVIEWS) & (n_previews > 0) & ~has_empty
    return F.when(alone, "text").when(accepted_by_names.isNotNull(), "names").when(n_previews.isNull(), "text").when(seen, "previews").otherwise("names")


def combine_readers(first: Column, first_issue: Column, second: Column, second_issue: Column) -> Column:
    """Struct (normalized, issue, reader): a sound first reading stays, a different sound second one is a disagreement, gaps are filled."""
    sound = first.isNotNull() & first_issue.isNull()
    other = second.isNotNull() & second_issue.isNull()
    kept = F.struct(first.alias("normalized"), F.when(sound & other & (first != second), "provider_disagreement").otherwise(first_issue).alias("issue"), F.lit("first").alias("reader"))
    return F.when(~sound & other, F.struct(second.alias("normalized"), second_issue.alias("issue"), F.lit("second").alias("reader"))).otherwise(kept)


def selection_error(status: Column, ids: Column, known: Column) -> Column:
    """Null for a sound selection of sources: no id twice, all of the document, some if the value is said to be present."""
    return (
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_source")
        .when(F.size(F.array_except(ids, known)) > 0, "unknown_source")
        .when((status == "present") & (F.size(ids) == 0), "no_source")
    )


def selected_reading(status: Column, normalized: Column, issue: Column) -> Column:
    """Struct (normalized, issue): only what is said to be present keeps its value."""
    value = F.when(status == "present", normalized)
    return F.struct(value.alias("normalized"), F.when(status == "present", issue).when(status == "uncertain", "model_uncertain").otherwise("missing_value").alias("issue"))


def extraction_errors(rows: DataFrame, *, known: Column) -> DataFrame:
    """document, error of proposals (document, field, selected, confidence); null where the seven fields are there once each and sound."""
    sure = F.coalesce(~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0), F.lit(False))
    fields = F.count_if(F.col("field").isin(*L.FIELDS))
    out = rows.groupBy("document").agg(F.count("*").alias("n"), fields.alias("own"), F.count_distinct("field").alias("kinds"), F.bool_and(F.coalesce(known, F.lit(False))).alias("known"), F.bool_and(sure).alias("sure"))
    seven = (F.col("n") == len(L.FIELDS)) & (F.col("own") == F.col("n")) & (F.col("kinds") == F.col("n"))
    return out.select("document", F.when(F.col("document").isNull(), "no_document").when(~seven, "fields").when(~F.col("known"), "reference").when(~F.col("sure"), "confidence").alias("error"))


def pair_verdict(selected: Column, confidence: Column, probabilities: Column, offered: Column, current: Column) -> Column:
    """accepted, unsure, or what is wrong; ``offered`` are the candidates proposed from, ``current`` those of today's sources."""
    allowed = F.array_append(offered, F.lit("NONE"))
    return (
        F.when(~F.coalesce(F.array_contains(allowed, selected), F.lit(False)), "unknown_reference")
        .when(distribution_error(selected, confidence, probabilities, allowed).isNotNull(), "bad_distribution")
        .when((selected == "NONE") | (confidence < LEAST_PAIR), "unsure")
        .when(~F.coalesce(offered == current, F.lit(False)), "stale")
        .otherwise("accepted")
    )


def mark_reusable(inputs: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """``inputs`` with ``reused``: whether a result was saved for the same keys (id, version, profile, fingerprint); null keys never match."""
    have = saved.select(*keys).distinct().withColumn("_have", F.lit(True))
    return inputs.join(have, keys, "left").withColumn("reused", F.coalesce("_have", F.lit(False))).drop("_have")


def fence_results(results: DataFrame, states: DataFrame) -> DataFrame:
    """``results`` (case_id, run_id, input_revision) with ``state``: published only if the case still rests on that revision and run.

    ``states``: case_id, current_revision, active_run (null: any run).
    """
    same = (F.col("input_revision") == F.col("current_revision")) & F.coalesce(F.col("active_run") == F.col("run_id"), F.col("active_run").isNull())
    out = results.join(states.select("case_id", "current_revision", "active_run"), "case_id", "left")
    return out.withColumn("state", F.when(F.coalesce(same, F.lit(False)), "published").otherwise("superseded")).drop("current_revision", "active_run")
