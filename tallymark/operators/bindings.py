"""Numbers that a reader selects by their place in the text, bound to what stands there.

A selection is taken only if it is exactly the place of a candidate number (and
of its unit); a span join tells what else it touches.  The value comes from the
text, never from the reader, and a weight needs its unit in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import numeric_candidates
from ..functions.values import normalize

# Fixed values.
NUMERIC = ("container_count", "gross_weight_kg")
REPAIRABLE = ("missing_value", "missing_or_ambiguous_value", "source_field_mismatch", "ambiguous_source_fields")
LEAST = 0.8


def can_repair(field: Column, issue: Column, provenance: Column, confidence: Column, native_pdf: Column, *, least: float = LEAST) -> Column:
    """Whether a reading may be repaired: a sure machine selection of a number that could not be read, in a native PDF."""
    sure = confidence.isNotNull() & ~F.isnan(confidence.cast("double")) & (confidence >= least)
    return F.coalesce(field.isin(*NUMERIC) & issue.isin(*REPAIRABLE) & (provenance == "machine") & sure & native_pdf, F.lit(False))


def native_pdfs(blocks: DataFrame) -> DataFrame:
    """doc_id, native_pdf: whether all blocks (method, kinds of their places) are native text of a PDF."""
    fits = (F.col("method") == "native") & (F.size("kinds") > 0) & F.forall("kinds", lambda k: k == "pdf")
    return blocks.groupBy("doc_id").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("native_pdf"))


def bind_numbers(blocks: DataFrame, selections: DataFrame, *, least: float = LEAST) -> DataFrame:
    """doc_id, field, value (as it stands), normalized, unit_source, issue, error of ``selections``.

    ``blocks``: doc_id, block, method, text, kinds; ``selections``: doc_id,
    field, block, start, end, unit_start, confidence, one per document and field.
    """
    numbers = numeric_candidates(blocks, keys=["doc_id"]).select("doc_id", "block", F.col("start").alias("s"), F.col("end").alias("e"), F.col("unit_start").alias("u"), F.col("value").alias("v"), "unit")
    place = blocks.select("doc_id", "block", (F.forall("kinds", lambda k: k == "pdf") & (F.size("kinds") > 0)).alias("pdf"))
    same_block = [F.col("q.doc_id") == F.col("c.doc_id"), F.col("q.block") == F.col("c.block")]
    touching = (F.col("c.s") < F.col("q.end")) & (F.col("q.start") < F.col("c.e"))
    met = selections.alias("q").join(numbers.alias("c"), [*same_block, touching], "left")
    exact = (F.col("c.s") == F.col("q.start")) & (F.col("c.e") == F.col("q.end")) & F.col("c.u").eqNullSafe(F.col("q.unit_start"))
    own = [F.col(f"q.{x}").alias(x) for x in ("doc_id", "field", "block", "start", "end", "unit_start", "confidence")]
    found = met.groupBy(*own).agg(F.count("c.s").alias("touched"), F.max(F.when(exact, F.struct(F.col("c.v").alias("value"), F.col("c.unit").alias("unit")))).alias("hit"))
    found = found.join(place, ["doc_id", "block"], "left")
    error = (
        F.when(~F.col("field").isin(*NUMERIC), "not_numeric")
        .when(F.col("hit").isNull(), F.when(F.col("touched") == 0, "no_number").when(F.col("touched") == 1, "not_the_span").otherwise("several_numbers"))
        .when(~F.coalesce("pdf", F.lit(False)), "not_a_pdf")
    )
    said = F.concat_ws(" ", "hit.value", "hit.unit")
    found = found.withColumn("error", error).withColumn("said", said)
    weight = F.col("field") == "gross_weight_kg"
    found = normalize(found.withColumn("value", F.col("said")), "said")
    found = found.withColumn("normalized", F.when(F.col("error").isNull() & ~(weight & F.col("hit.unit").isNull()), F.col("normalized")))
    unsure = F.col("confidence").isNull() | (F.col("confidence") < least)
    issue = F.when(F.col("error").isNull(), F.when(F.col("normalized").isNull(), "missing_value").when(unsure, "low_field_confidence"))
    return found.select("doc_id", "field", F.when(F.col("error").isNull(), F.col("hit.value")).alias("value"), "normalized", F.when(weight & F.col("normalized").isNotNull(), "explicit").alias("unit_source"), issue.alias("issue"), "error")
