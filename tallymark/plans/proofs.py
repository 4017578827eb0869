"""Registered queries on proofs of pairs and on exports of cases without a report, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export, issues, references
from .corpus import sql_with, table, view

#: Two documents an order: sheets of a template with one fault or none, or texts with identifiers.
_BLOCKS = """
SELECT o_orderkey AS case_id, concat(role, cast(o_orderkey AS varchar(12))) AS doc_id, role, r, k,
  CASE WHEN k < 8 THEN CASE r WHEN 3 THEN concat(heading, ': ', cast(100000 + o_custkey + CASE WHEN role = 'BL' AND k = 1 THEN 1 ELSE 0 END AS varchar(12)))
      WHEN 13 THEN CASE WHEN k = 2 AND role = 'SI' THEN 'HS CODE: none' ELSE 'HS CODE: 12' END WHEN 15 THEN 'FREIGHT: PREPAID' ELSE concat('ROW: ', cast(r AS varchar(3))) END
    ELSE CASE r WHEN 3 THEN concat('Booking No. BK-', cast(5000 + o_custkey + CASE WHEN role = 'BL' AND k = 9 THEN 1 ELSE 0 END AS varchar(12))) WHEN 4 THEN CASE WHEN k IN (10, 13) THEN concat('B/LNo.: AB', cast(1000 + o_custkey + CASE WHEN role = 'BL' AND k = 13 THEN 1 ELSE 0 END AS varchar(12))) ELSE 'words' END
      WHEN 5 THEN CASE WHEN k = 11 THEN 'Booking Ref: BK-0000' WHEN k = 12 AND role = 'SI' THEN 'Order No. A-1 and Order No. B-2000' WHEN k = 12 THEN 'Order No. A-1000' ELSE 'more' END ELSE concat('row ', cast(r AS varchar(3))) END END AS text,
  CASE WHEN k = 3 AND role = 'BL' AND r = 7 THEN 'ocr' ELSE 'native' END AS method, CASE WHEN k = 4 AND r = 9 THEN 'Other' ELSE sheet END AS sheet,
  CASE WHEN k = 5 AND r = 8 THEN 20 WHEN k = 6 AND r = 8 THEN 9 ELSE r END AS row_no, NOT (k = 7 AND role = 'SI') AS readable, o_orderkey % 5 = 0 AS human
FROM (SELECT *, o_orderkey % 14 AS k FROM orders) AS o CROSS JOIN (SELECT 'SI' AS role, 'S.I.' AS sheet, 'BL INSTRUCTION' AS heading UNION ALL SELECT 'BL', 'BL', 'BILL OF LADING') AS sides
CROSS JOIN (SELECT 3 AS r UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11 UNION ALL SELECT 12 UNION ALL SELECT 13 UNION ALL SELECT 14 UNION ALL SELECT 15) AS lines
"""


def pair_proofs(spark, sf_dir):
    """Fourteen kinds of pairs; the first eight hold sheets, the others texts."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(_BLOCKS)
    kind = F.when(F.col("k") < 8, "xlsx").otherwise("pdf")
    place = lambda column: F.struct(kind.alias("kind"), F.when(F.col("k") < 8, F.col("sheet")).alias("sheet"), F.when(F.col("k") < 8, F.concat(F.lit(column), F.col("row_no").cast("string"))).alias("cell"))
    blocks = rows.select("doc_id", "text", "method", F.array(place("A"), place("B")).alias("locations"), "readable")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("SI"), F.col("o_orderkey").cast("string")).alias("si_id"), F.concat(F.when(F.col("o_orderkey") % 29 == 0, "SI").otherwise("BL"), F.col("o_orderkey").cast("string")).alias("bl_id"), (F.col("o_orderkey") % 5 == 0).alias("human_selected"))
    return references.pair_proofs(pairs, blocks)


def exports_without_report(spark, sf_dir):
    """Cases whose documents are missing, unreadable, of a wrong kind, or should have been compared."""
    cases = view(spark, sf_dir, "c1")
    files = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("file")
    papers = cases.select("case_id", files).where("file < case_id % 5")
    attachments = papers.select(
        "case_id", F.concat_ws("-", "case_id", "file").alias("attachment_id"), F.expr("CASE WHEN file = 0 THEN 'SI' WHEN file = 1 AND case_id % 3 > 0 THEN 'BL' WHEN file = 1 THEN 'SI' ELSE 'unknown' END").alias("role"),
        F.expr("file = 3").alias("superseded"), F.expr("case_id % 11 > 0 OR file <> 1").alias("has_evidence"), F.expr("CASE WHEN case_id % 13 = 0 AND file = 0 THEN 0 ELSE 4 END").alias("n_blocks"), F.lit(0).alias("n_issues"),
    )
    none = F.lit(None).cast("array<string>")
    accepted = F.when(F.col("confidence_pct") >= 30, F.when(F.col("case_id") % 2 == 0, "BL_COMPARISON").otherwise(F.col("truth")))
    rows = cases.select("case_id", "processing", accepted.alias("accepted")).join(issues.roles(attachments), "case_id", "left")
    rows = rows.withColumn("no_report_reason", issues.reason_without_report(rows)).select("case_id", "processing", "accepted", "no_report_reason", F.lit(False).alias("report_present"), F.lit(False).alias("report_current"), F.lit(False).alias("pair_valid"), F.lit(False).alias("complete"), none.alias("mismatches"), none.alias("unresolved"), none.alias("issues"))
    return export.decide(rows).select("case_id", "status", "review_reason", "blocker", "has_defect")


ORACLES = {
    "pair_proofs": f"""WITH b AS ({_BLOCKS}), o AS (SELECT o_orderkey AS case_id, o_orderkey % 14 AS k, o_orderkey % 5 = 0 AS human, o_orderkey % 29 = 0 AS same FROM orders),
ids AS (SELECT case_id, role, list_sort(list_distinct(flatten(list(regexp_extract_all(text, 'Booking (?:No\\.|Ref:) (\\S+)', 1))))) AS booking, list_sort(list_distinct(flatten(list(regexp_extract_all(text, 'B/LNo\\.: (\\S+)', 1))))) AS bill,
  list_sort(list_distinct(flatten(list(regexp_extract_all(text, 'Order No\\. (\\S\\S\\S\\S\\S*)', 1))))) AS orders FROM b GROUP BY case_id, role),
sheets AS (SELECT case_id, role, regexp_extract(max(CASE WHEN r = 3 THEN text END), '([0-9]{{6,}})$', 1) AS ref FROM b WHERE k < 8 GROUP BY case_id, role
  HAVING bool_and(readable AND method = 'native' AND sheet <> 'Other') AND count(DISTINCT row_no) = 13 AND max(row_no) = 15 AND bool_or(text = 'HS CODE: 12')),
j AS (SELECT o.*, s.booking AS sb, s.bill AS si_bill, s.orders AS so, t.booking AS tb, t.bill AS bl_bill, t.orders AS to_, x.ref AS sr, y.ref AS br FROM o
  JOIN ids s ON s.case_id = o.case_id AND s.role = 'SI' JOIN ids t ON t.case_id = o.case_id AND t.role = CASE WHEN same THEN 'SI' ELSE 'BL' END
  LEFT JOIN sheets x ON x.case_id = o.case_id AND x.role = 'SI' LEFT JOIN sheets y ON y.case_id = o.case_id AND y.role = 'BL' AND NOT same),
v AS (SELECT case_id, human, same OR (len(sb) > 0 AND len(tb) > 0 AND sb <> tb) OR (len(si_bill) > 0 AND len(bl_bill) > 0 AND (si_bill <> bl_bill OR len(si_bill) > 1)) OR (len(so) > 0 AND len(to_) > 0 AND (so <> to_ OR len(so) > 1)) OR coalesce(sr <> br, false) AS conflict,
  (len(sb) > 0 AND len(tb) > 0 AND sb = tb) OR coalesce(sr = br, false) AS shared FROM j)
SELECT case_id, conflict, shared, NOT conflict AND (human OR shared) AS valid FROM v""",
    "exports_without_report": sql_with("c1") + """, e AS (SELECT case_id, processing, CASE WHEN confidence_pct >= 30 THEN CASE WHEN case_id % 2 = 0 THEN 'BL_COMPARISON' ELSE truth END END AS accepted, least(case_id % 5, 3) AS n,
  CASE WHEN least(case_id % 5, 3) < 2 THEN 'missing_attachment' WHEN case_id % 11 = 0 OR case_id % 13 = 0 THEN 'unreadable' WHEN case_id % 3 = 0 THEN 'wrong_doc_type' END AS why FROM c1),
f AS (SELECT *, CASE WHEN processing <> 'completed' THEN 'processing_incomplete' WHEN accepted IS NULL THEN 'category_unresolved' WHEN accepted = 'BL_COMPARISON' AND why IS NULL THEN 'comparison_missing' END AS blocker FROM e)
SELECT case_id, CASE WHEN blocker IS NULL THEN CASE WHEN accepted = 'BL_COMPARISON' THEN 'NEEDS_REVIEW' ELSE 'OK' END END AS status, CASE WHEN blocker IS NULL AND accepted = 'BL_COMPARISON' THEN why END AS review_reason, blocker, CASE WHEN blocker IS NULL THEN false END AS has_defect FROM f""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
