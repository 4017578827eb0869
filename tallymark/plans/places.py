"""Registered queries on OCR lines, selected numbers and kept flags, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import bindings, layout, segment, selector
from ..streaming import refresh
from .corpus import sql_with, table, view
from .regions import _BLOCKS

_SCALE = 2


def ocr_blocks(spark, sf_dir):
    """Lines of documents in two paragraphs each, as a reader of images gives them."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    rows = spark.sql(f"SELECT *, block % 2 AS paragraph, cast(top % 120 AS double) AS confidence FROM ({_BLOCKS}) AS blocks")
    lines = rows.select("doc_id", "paragraph", F.lit(0).alias("at"), "text", F.col("x0").cast("double").alias("x0"), F.col("top").cast("double").alias("top"), (F.col("x0") + 100.0).alias("x1"), (F.col("top") + 10.0).alias("bottom"), "confidence")
    out = layout.ocr_blocks(lines, scale=_SCALE)
    boxes = F.array_join(F.transform("boxes", lambda b: F.concat_ws(" ", *(b[k].cast("long") for k in ("x0", "top", "x1", "bottom")))), ",")
    return out.select("doc_id", F.col("paragraph").cast("int").alias("paragraph"), F.col("block").cast("int").alias("block"), "text", boxes.alias("boxes"), F.round("confidence", 4).alias("confidence"), *(F.col(k).cast("long").alias(k) for k in ("x0", "top", "x1", "bottom")))


#: One text a shipment in six forms, with the place that a reader names in it.
_NUMBERS = """
SELECT doc_id, k, field, text, n, m, lead + CASE WHEN k = 5 THEN 1 ELSE 0 END AS a, lead + CASE WHEN k = 1 THEN length(n) + 4 + length(m) ELSE length(n) END AS z,
  CASE k WHEN 0 THEN lead + length(n) + 1 WHEN 1 THEN lead + length(n) + length(m) + 5 WHEN 5 THEN lead + length(n) + 1 END AS u, confidence_pct, method_k
FROM (SELECT *, CASE k WHEN 0 THEN concat('Gross ', n, ' kg') WHEN 1 THEN concat('No ', n, ' of ', m, ' kg') WHEN 2 THEN concat('Total ', n) WHEN 3 THEN concat('x', n) WHEN 4 THEN concat(n, ' kg ', m, ' mt') ELSE concat('Net ', n, ' kg') END AS text,
    CASE k WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 4 END AS lead
  FROM (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS k, cast(1000 + o_custkey AS varchar(12)) AS n, cast(2000 + o_custkey AS varchar(12)) AS m,
      CASE WHEN o_custkey % 3 = 0 THEN 'container_count' WHEN o_custkey % 17 = 1 THEN 'shipper' ELSE 'gross_weight_kg' END AS field, o_orderkey * 7 % 100 AS confidence_pct, o_orderkey % 19 AS method_k FROM orders) AS raw) AS texts
"""


def bound_numbers(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(_NUMBERS)
    kinds = F.when(F.col("method_k") == 1, F.array(F.lit("docx"))).when(F.col("method_k") == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("pdf")))
    blocks = rows.select("doc_id", F.lit(1).alias("block"), F.lit("native").alias("method"), "text", kinds.alias("kinds"))
    picks = rows.select("doc_id", "field", F.lit(1).alias("block"), F.col("a").alias("start"), F.col("z").alias("end"), F.col("u").alias("unit_start"), (F.col("confidence_pct") / 100).alias("confidence"))
    return bindings.bind_numbers(blocks, picks)


def flag_changes(spark, sf_dir):
    """Kept flags, some outdated, missing or of cases that are gone, against those of the cases."""
    cases = view(spark, sf_dir, "c1")
    desired = cases.select("case_id", (F.col("confidence_pct") >= 80).alias("accepted"), "workflow")
    kept = desired.where("case_id % 13 <> 0").select("case_id", F.expr("CASE WHEN case_id % 7 = 0 THEN NOT accepted ELSE accepted END").alias("accepted"), F.expr("CASE WHEN case_id % 11 = 0 THEN NULL ELSE workflow END").alias("workflow"))
    gone = cases.where("case_id % 17 = 0").select((-F.col("case_id") - 1).alias("case_id"), F.lit(True).alias("accepted"), "workflow")
    return refresh.differing(kept.unionByName(gone), desired, ["case_id"])


def label_selections(spark, sf_dir):
    """The texts of a side as one document, cut into blocks, and the block of each field chosen by its label."""
    rows = view(spark, sf_dir, "b")
    order = F.array_position(F.array(*map(F.lit, L.FIELDS)), F.col("field"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "text"))), lambda x: x["text"]), "\n")
    sides = rows.groupBy((F.col("case_id") * 2 + (F.col("role") == "BL").cast("int")).alias("doc_id")).agg(text.alias("text"))
    out = selector.blocks_by_field(segment.text_blocks(sides))
    return out.select("doc_id", *(F.concat(selector.status_of(F.col(f)), F.lit(" "), F.array_join(selector.numbers_of(F.col(f)), ",")).alias(f) for f in L.FIELDS))


ORACLES = {
    "ocr_blocks": f"""WITH l AS (SELECT *, CAST(block % 2 AS INT) AS paragraph, top % 120 AS conf, row_number() OVER (PARTITION BY doc_id, block % 2 ORDER BY top, x0, text) AS line FROM ({_BLOCKS}) AS blocks),
g AS (SELECT *, CAST(sum(CASE WHEN k IN (0, 3, 4) OR line = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, paragraph ORDER BY line) AS INT) AS b FROM l)
SELECT doc_id, paragraph, b AS block, string_agg(text, chr(10) ORDER BY line) AS text, string_agg(concat_ws(' ', x0 // {_SCALE}, top // {_SCALE}, (x0 + 100) // {_SCALE}, (top + 10) // {_SCALE}), ',' ORDER BY line) AS boxes,
  CASE WHEN max(conf) <= 100 THEN round(min(conf) / 100.0, 4)::DOUBLE END AS confidence, min(x0 // {_SCALE}) AS x0, min(top // {_SCALE}) AS top, max((x0 + 100) // {_SCALE}) AS x1, max((top + 10) // {_SCALE}) AS bottom FROM g GROUP BY doc_id, paragraph, b""",
    "bound_numbers": f"""WITH r AS ({_NUMBERS}), e AS (SELECT *, CASE WHEN field = 'shipper' THEN 'not_numeric' WHEN k = 3 THEN 'no_number' WHEN k = 1 THEN 'several_numbers' WHEN k = 5 THEN 'not_the_span' WHEN method_k IN (1, 2) THEN 'not_a_pdf' END AS error FROM r),
v AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN field = 'container_count' THEN CASE WHEN k IN (2, 4) THEN n END WHEN k = 0 THEN n END END AS normalized FROM e)
SELECT doc_id, field, CASE WHEN error IS NULL THEN n END AS value, normalized, CASE WHEN field = 'gross_weight_kg' AND normalized IS NOT NULL THEN 'explicit' END AS unit_source,
  CASE WHEN error IS NULL THEN CASE WHEN normalized IS NULL THEN 'missing_value' WHEN confidence_pct < 80 THEN 'low_field_confidence' END END AS issue, error FROM v""",
    "label_selections": sql_with("b") + ", s AS (SELECT DISTINCT case_id, k, role FROM b) SELECT case_id * 2 + CASE WHEN role = 'BL' THEN 1 ELSE 0 END AS doc_id, " + ", ".join({"consignee": "CASE WHEN role = 'BL' AND k = 11 THEN 'uncertain 2,3' ELSE 'present 2' END", "notify_party": "CASE WHEN role = 'BL' AND k = 11 THEN 'missing ' ELSE 'present 3' END"}.get(f, f"'present {n}'") + f" AS {f}" for n, f in enumerate(L.FIELDS, 1)) + " FROM s",
    "flag_changes": sql_with("c1") + """, d AS (SELECT case_id, confidence_pct >= 80 AS accepted, workflow FROM c1)
SELECT case_id, CASE WHEN case_id % 13 = 0 THEN 'added' ELSE 'changed' END AS change FROM d WHERE case_id % 13 = 0 OR case_id % 7 = 0 OR case_id % 11 = 0 UNION ALL SELECT -case_id - 1, 'removed' FROM c1 WHERE case_id % 17 = 0""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
