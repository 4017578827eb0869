"""Readings of two sides, their alignment and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.values import canonical_text, normalize, source_issue, value_of, weight_unit_source


def read_values(texts: DataFrame) -> DataFrame:
    """case_id, role, field, text -> also canonical, normalized, unit_source, issue.

    A reading rests on field and text alone, and names, ports and figures recur, so equal ones are read once.
    """
    read = _read(texts.select("field", "text").distinct()).withColumnsRenamed({"field": "_of_field", "text": "_of_text"})
    return texts.join(read, F.col("field").eqNullSafe(F.col("_of_field")) & F.col("text").eqNullSafe(F.col("_of_text"))).drop("_of_field", "_of_text")


def _read(texts: DataFrame) -> DataFrame:
    field, text, value = F.col("field"), F.col("canonical"), F.col("value")
    out = canonical_text(texts)
    out = out.withColumn("value", value_of(field, text)).withColumn("low", F.lower("value"))
    out = normalize(out).withColumn("issue", source_issue(field, text, value, F.col("low"))).drop("value", "low")
    unit = F.when((field == "gross_weight_kg") & F.col("normalized").isNotNull(), weight_unit_source(text))
    return out.withColumn("issue", F.coalesce("issue", F.when(F.col("normalized").isNull(), "missing_value"))).withColumn("unit_source", unit)


def quality_issue(method: Column, ocr: Column, confidence: Column, *, least: float = 0.8) -> Column:
    """The first quality problem of a reading: unknown or low OCR confidence, then low field confidence."""
    return F.when((method == "ocr") & ocr.isNull(), "ocr_confidence_unavailable").when((method == "ocr") & (ocr < least), "low_ocr_confidence").when(confidence < least, "low_field_confidence")


def findings(readings: DataFrame, *, pair_valid: Column | None = None) -> DataFrame:
    """Seven rows a case: case_id, field, si_value, bl_value, si_issue, bl_issue, outcome, provisional_outcome.

    One shuffle: the at most 14 readings of a case become an array, and the seven
    fields are looked up in it.  More than one reading of a side and field has
    no value and the issue ``ambiguous_reading``.  ``readings`` may carry
    ``code`` (a resolved port).
    """
    if "code" not in readings.columns:
        readings = readings.withColumn("code", F.lit(None).cast("string"))
    entry = F.struct(F.concat_ws(":", "role", "field").alias("k"), F.struct("normalized", "issue", "code").alias("v"))
    cases = readings.groupBy("case_id").agg(F.collect_list(entry).alias("list")).withColumn("keys", F.transform("list", lambda x: x["k"]))
    first = lambda k, i: F.array_position("keys", k) == i + 1
    twice = F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.filter("keys", lambda k, i: ~first(k, i)))
    cases = cases.select("case_id", "list", "keys", twice.alias("twice"))
    rows = cases.select("case_id", "list", "keys", "twice", F.explode(F.array(*map(F.lit, L.FIELDS))).alias("field"))

    def side(role: str) -> Column:
        key = F.concat(F.lit(f"{role}:"), F.col("field"))
        none = F.lit(None).cast("string")
        unclear = F.struct(none.alias("normalized"), F.lit("ambiguous_reading").alias("issue"), none.alias("code"))
        return F.when(F.coalesce(F.array_contains("twice", key), F.lit(False)), unclear).otherwise(F.get("list", (F.array_position("keys", key) - 1).cast("int"))["v"])

    rows = rows.select("case_id", "field", side("SI").alias("si"), side("BL").alias("bl"))
    unknown = F.col("si.issue").isNotNull() | F.col("bl.issue").isNotNull() | F.col("si.normalized").isNull() | F.col("bl.normalized").isNull()
    same = (F.col("si.normalized") == F.col("bl.normalized")) | F.coalesce(F.col("si.code") == F.col("bl.code"), F.lit(False))
    rows = rows.withColumn("provisional_outcome", F.when(unknown, "unresolved").when(same, "match").otherwise("mismatch"))
    outcome = F.col("provisional_outcome") if pair_valid is None else F.when(pair_valid, F.col("provisional_outcome")).otherwise("unresolved")
    return rows.select("case_id", "field", F.col("si.normalized").alias("si_value"), F.col("bl.normalized").alias("bl_value"), F.col("si.issue").alias("si_issue"), F.col("bl.issue").alias("bl_issue"), outcome.alias("outcome"), "provisional_outcome")


def in_order(flag: Column) -> Column:
    """Aggregate: the flagged fields of a case in official order."""
    ordinal = F.array_position(F.array(*map(F.lit, L.FIELDS)), F.col("field"))
    held = F.sort_array(F.collect_list(F.when(flag, F.struct(ordinal.alias("o"), F.col("field").alias("f")))))
    return F.transform(held, lambda x: x["f"])


def in_one_row(rows: DataFrame, *names: str) -> DataFrame:
    """A row per case: each column's values of the fields in official order, between bars, a dash for none."""
    ordinal = F.array_position(F.array(*map(F.lit, L.FIELDS)), F.col("field"))
    held = lambda name: F.sort_array(F.collect_list(F.struct(ordinal.alias("o"), F.coalesce(name, F.lit("-")).alias("v"))))
    return rows.groupBy("case_id").agg(*(F.array_join(F.transform(held(name), lambda x: x["v"]), "|").alias(name) for name in names))


def report_facts(found: DataFrame, **more: Column) -> DataFrame:
    """Per case: mismatches, unresolved (official order), whether the seven fields are complete and unique, and ``more`` aggregates of its findings."""
    seen = [F.count_if(F.col("field") == name) == 1 for name in L.FIELDS]
    complete = reduce(lambda a, b: a & b, seen, F.count("*") == len(L.FIELDS))
    return found.groupBy("case_id").agg(in_order(F.col("outcome") == "mismatch").alias("mismatches"), in_order(F.col("outcome") == "unresolved").alias("unresolved"), complete.alias("complete"), *(x.alias(name) for name, x in more.items()))
