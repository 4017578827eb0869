"""Registered queries over scores, issues, evidence and counts, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts, evidence, intake, issues, references, scores
from .corpus import VIEWS, sql_with, table, view
from .queries import _READ, _findings

VIEWS["c13"] = """
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'BL_COMPARISON' ELSE 'GENERAL' END AS t_category,
  CASE WHEN o_orderkey % 6 = 0 THEN 'MISMATCH' WHEN o_orderkey % 14 = 2 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS t_status,
  CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 14 = 2 THEN CASE o_custkey % 3 WHEN 0 THEN 'wrong_doc_type' WHEN 1 THEN 'unreadable' ELSE 'missing_value' END END AS t_review_reason,
  o_orderkey % 6 = 0 AS t_has_defect, CASE WHEN o_orderkey % 12 = 0 THEN 'shipper,consignee' WHEN o_orderkey % 6 = 0 THEN 'container_count' ELSE '' END AS t_fields,
  CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 41 = 0 THEN 'BL_COMPARISON' ELSE 'GENERAL' END AS category,
  CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 26 = 0 THEN 'NEEDS_REVIEW' WHEN o_orderkey % 6 = 0 THEN 'MISMATCH' WHEN o_orderkey % 14 = 2 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status,
  CASE WHEN o_orderkey % 26 = 0 THEN 'missing_value' WHEN o_orderkey % 6 <> 0 AND o_orderkey % 14 = 2 THEN CASE o_custkey % 3 WHEN 0 THEN 'wrong_doc_type' WHEN 1 THEN 'unreadable' ELSE 'missing_value' END END AS review_reason,
  o_orderkey % 6 = 0 AND o_orderkey % 26 <> 0 AS has_defect,
  CASE WHEN o_orderkey % 26 = 0 THEN '' WHEN o_orderkey % 12 = 0 THEN 'consignee,shipper' WHEN o_orderkey % 18 = 0 THEN 'shipper' WHEN o_orderkey % 6 = 0 THEN 'container_count' ELSE '' END AS fields,
  o_orderkey % 7 = 0 AS reviewer_assisted, CASE WHEN o_orderkey % 11 = 0 THEN 'pairing_unresolved' ELSE '' END AS blocker,
  CASE WHEN o_orderkey % 61 = 0 THEN 'failed' WHEN o_orderkey % 67 = 0 THEN 'running' WHEN o_orderkey % 71 = 0 THEN NULL ELSE 'completed' END AS processing,
  CASE WHEN o_orderkey % 73 = 0 THEN 'failed' WHEN o_orderkey % 67 = 1 THEN 'running' WHEN o_orderkey % 134 = 0 THEN 'superseded' END AS run_status
FROM orders
"""
VIEWS["c14"] = """
SELECT l_orderkey AS case_id, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS attachment_id,
  CASE WHEN l_partkey % 5 < 2 THEN 'SI' WHEN l_partkey % 5 < 4 THEN 'BL' ELSE 'unknown' END AS role, l_suppkey % 6 = 0 AS superseded,
  l_partkey % 17 <> 0 AS has_evidence, CASE WHEN l_partkey % 19 = 0 THEN 0 ELSE 3 END AS n_blocks, CASE WHEN l_suppkey % 23 = 0 THEN 1 ELSE 0 END AS n_issues, l_partkey * 1000 AS size
FROM lineitem
"""
VIEWS["c15"] = """
SELECT user_id AS case_id, event_id, CASE event_type WHEN 'click' THEN 'category' WHEN 'error' THEN 'pair' WHEN 'purchase' THEN 'assign' WHEN 'signup' THEN 'correct' ELSE 'workflow' END AS action,
  CASE WHEN event_id % 3 = 0 THEN 'Processing' ELSE 'reviewer' END AS actor FROM events
"""
VIEWS["c16"] = """
SELECT l_orderkey AS doc_no, l_linenumber AS ordinal, concat('b', cast(l_linenumber AS varchar(9))) AS block_id, CASE WHEN l_partkey % 29 = 0 THEN ' ' ELSE concat('line ', cast(l_partkey AS varchar(9))) END AS text,
  CASE WHEN l_suppkey % 31 = 0 THEN 0 ELSE 1 END AS n_locations, CASE WHEN l_suppkey % 2 = 0 THEN 'docx' ELSE 'pdf' END AS kind, CASE WHEN l_partkey % 37 = 0 OR l_suppkey % 2 = 1 THEN 1 END AS page,
  CASE WHEN l_partkey % 3 = 0 THEN 'ocr' ELSE 'native' END AS method, CASE WHEN l_partkey % 6 = 0 THEN 70 WHEN l_partkey % 9 = 0 THEN NULL ELSE 95 END AS ocr_pct, l_orderkey % 13 = 0 AS blocked
FROM lineitem
"""
VIEWS["c17"] = """
SELECT CASE WHEN n_nationkey % 7 = 6 THEN 'X' END AS marker, concat('R', chr(cast(65 + n_regionkey AS int))) AS country, concat('L', chr(cast(65 + n_nationkey AS int)), 'X') AS location, CASE WHEN n_nationkey < 6 THEN 'Twin Bay' ELSE n_name END AS name,
  lower(n_name) AS plain_name, CASE WHEN n_nationkey % 5 = 4 THEN '3----' ELSE '1-3--' END AS function, CASE WHEN n_nationkey % 11 = 10 THEN 'QQ' ELSE 'AI' END AS status FROM nation
UNION ALL SELECT NULL, concat('R', chr(cast(65 + r_regionkey AS int))), NULL, concat('.', r_name), NULL, NULL, NULL FROM region
"""
VIEWS["c18"] = """
SELECT c_custkey AS case_id, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN concat('twin bay, ', lower(r_name)) WHEN 2 THEN concat(n_name, ' (R', chr(cast(65 + r_regionkey AS int)), 'L', chr(cast(65 + n_nationkey AS int)), 'X)') ELSE concat('R', chr(cast(65 + r_regionkey AS int)), 'L', chr(cast(65 + n_nationkey AS int)), 'X') END AS place
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
"""
VIEWS["c19"] = """
SELECT o_orderkey AS case_id, 'SI' AS role, concat('Order No: PO-', cast(o_custkey AS varchar(12)), '00') AS text FROM orders
UNION ALL SELECT o_orderkey, 'BL', CASE WHEN o_orderkey % 9 = 0 THEN concat('Order Reference PO-', cast(o_custkey + 1 AS varchar(12)), '00') WHEN o_orderkey % 9 = 1 THEN 'goods in good order' ELSE concat('order number # po-', cast(o_custkey AS varchar(12)), '00') END FROM orders
UNION ALL SELECT o_orderkey, 'BL', CASE WHEN o_orderkey % 13 = 0 THEN concat('Order no. PX-', cast(o_orderkey AS varchar(12)), '00') ELSE 'B/L No.: none' END FROM orders
"""
_EMPTY = "array<string>"
_SCORED = sql_with("c13") + """,
r AS (SELECT *, status IS NOT NULL AND category = t_category AND status = t_status AND coalesce(review_reason, '') = coalesce(t_review_reason, '') AND has_defect = t_has_defect
  AND list_sort(string_split(fields, ',')) = list_sort(string_split(t_fields, ',')) AS exact FROM c13)
"""


def _rows(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "c13")
    listed = lambda c: F.when(F.col(c) != "", F.split(c, ",")).otherwise(F.array().cast(_EMPTY))
    return rows.withColumn("defect_fields", listed("fields")).withColumn("t_defect_fields", listed("t_fields")).withColumn("blockers", listed("blocker"))


def exact_row_accuracy(spark, sf_dir):
    return scores.exact_rows(_rows(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


def wrong_exports(spark, sf_dir):
    return scores.wrong_rows(_rows(spark, sf_dir))


def blocker_histogram(spark, sf_dir):
    return scores.blocker_counts(_rows(spark, sf_dir))


def export_rates(spark, sf_dir):
    out = scores.export_rates(_rows(spark, sf_dir))
    return out.withColumn("automatic_coverage", F.round("automatic_coverage", 9)).withColumn("assisted_coverage", F.round("assisted_coverage", 9))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def defect_scores(spark, sf_dir):
    return _rounded(scores.defect_scores(_rows(spark, sf_dir)))


def planted_defects(spark, sf_dir):
    return _rounded(scores.end_to_end(_rows(spark, sf_dir)))


def escalation_scores(spark, sf_dir):
    return _rounded(scores.escalation(_rows(spark, sf_dir)))


def processing_state(spark, sf_dir):
    return scores.processing_metrics(_rows(spark, sf_dir))


def comparison_metrics(spark, sf_dir):
    truth = view(spark, sf_dir, "c2").selectExpr("case_id", "CASE WHEN case_id % 20 = 0 THEN array('container_count') WHEN case_id % 20 = 1 THEN array('gross_weight_kg', 'shipper') ELSE CAST(array() AS array<string>) END AS t_defect_fields", "CASE WHEN case_id % 9 <> 0 THEN has_override END AS reviewer_assisted")
    return _rounded(scores.comparison_metrics(_findings(spark, sf_dir), truth))


def field_micro_f1(spark, sf_dir):
    truth = view(spark, sf_dir, "c2").selectExpr("case_id", "CASE WHEN case_id % 20 = 0 THEN array('container_count') WHEN case_id % 20 = 1 THEN array('gross_weight_kg', 'shipper') ELSE CAST(array() AS array<string>) END AS t_defect_fields")
    return _rounded(scores.micro_f1(_findings(spark, sf_dir), truth))


def attachment_roles(spark, sf_dir):
    out = issues.roles(view(spark, sf_dir, "c14"))
    return out.withColumn("reason", issues.reason_without_report(out))


def pair_selection(spark, sf_dir):
    out = issues.roles(view(spark, sf_dir, "c14"))
    return out.groupBy(issues.pair_selection_reason(F.col("n_current"), F.col("n_unreadable"), F.col("n_si"), F.col("n_bl")).alias("reason")).agg(F.count("*").alias("n"))


def assisted_cases(spark, sf_dir):
    cases = view(spark, sf_dir, "c15").groupBy("case_id").agg(F.lit(0).alias("z")).select("case_id", F.when(F.col("case_id") % 10 == 0, "human").otherwise("model").alias("source"), (F.col("case_id") % 7 == 0).alias("human_reading"))
    out = issues.reviewer_assisted(view(spark, sf_dir, "c15"), cases)
    return out.select("case_id", F.array_join("actions", ",").alias("actions"), "reviewer_assisted")


def blocking_issues(spark, sf_dir):
    """Issues of each order's current attachments, those of unused ones as warnings."""
    rows = view(spark, sf_dir, "c14").where("not superseded and (n_issues > 0 or n_blocks = 0)")
    text = F.when(F.col("n_blocks") == 0, "document_has_no_readable_text").otherwise(F.concat(F.lit(" scan_unclear : page "), F.col("role")))
    held = rows.select("case_id", issues.scoped(F.array(issues.parse_issue(text)), F.col("role") != "unknown").alias("own")).groupBy("case_id").agg(F.flatten(F.collect_list("own")).alias("pair_issues"))
    cases = held.withColumn("report_issues", F.array().cast(f"array<{issues.ISSUE}>")).withColumn("review_reasons", F.when(F.col("case_id") % 4 == 0, F.array(F.lit("asked"))))
    out = issues.blocking(cases)
    return out.select("case_id", F.array_join("blocking", ";").alias("blocking"), F.array_join("unused_warnings", ";").alias("warnings"))


def evidence_problems(spark, sf_dir):
    blocks = view(spark, sf_dir, "c16").withColumn("document_id", F.col("doc_no").cast("string"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), (F.col("o_orderkey") % 2).alias("n_issues"))
    return evidence.problems(blocks, docs).select("document_id", F.array_join("problems", ";").alias("problems"))


def document_previews(spark, sf_dir):
    blocks = view(spark, sf_dir, "c16").withColumn("ocr_confidence", F.col("ocr_pct") / 100).groupBy("doc_no", "ordinal").agg(*(F.max(c).alias(c) for c in ("text", "method", "ocr_confidence", "blocked")))
    return evidence.previews(blocks.withColumnRenamed("doc_no", "document_id"))


def block_capacity(spark, sf_dir):
    return evidence.within_capacity(view(spark, sf_dir, "c16").withColumnRenamed("doc_no", "document_id"))


def ocr_pages(spark, sf_dir):
    pages = view(spark, sf_dir, "c16").select(F.col("doc_no").alias("document_id"), F.col("ordinal").cast("int").alias("page"), F.char_length("text").alias("n_readable"), (F.col("ocr_pct") / 100).alias("image_share")).groupBy("document_id", "page").agg(F.max("n_readable").alias("n_readable"), F.max("image_share").alias("image_share"))
    return evidence.pages_for_ocr(pages.withColumn("image_share", F.coalesce("image_share", F.lit(0.0))), most_ocr=2)


def queue_pages(spark, sf_dir):
    return counts.total_and_pages(view(spark, sf_dir, "c1").where("workflow = 'open'"), 25)


def attachment_limits(spark, sf_dir):
    return counts.attachment_limits(view(spark, sf_dir, "c14").withColumnRenamed("case_id", "email_id"), most_files=5, most_bytes=600_000)


def path_suffixes(spark, sf_dir):
    return counts.suffixes(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")))


def case_selection(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").where("l_partkey % 10 = 0").select((F.col("l_orderkey") * 2).alias("case_id"))
    return counts.selection(view(spark, sf_dir, "c1").select("case_id"), asked, "case_id").groupBy("state").agg(F.count("*").alias("n"))


def evaluation_chunks(spark, sf_dir):
    return counts.chunks(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def rebuilt_flags(spark, sf_dir):
    old = view(spark, sf_dir, "c1").select("case_id", (F.col("processing") == "failed").alias("needs_review"), F.when(F.col("case_id") % 3 > 0, F.lit(False)).alias("has_mismatch"))
    new = old.select("case_id", (F.col("needs_review") | (F.col("case_id") % 50 == 0)).alias("needs_review"), F.lit(False).alias("has_mismatch"))
    return counts.changed_flags(old, new, ["needs_review", "has_mismatch"])


def stage_times(spark, sf_dir):
    stages = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("run_id"), F.when(F.col("event_type") == "click", "read").when(F.col("event_type") == "error", "read/ocr").otherwise("read/parse").alias("path"), (F.col("user_id") % 90).alias("ms"))
    return counts.stage_times(stages)


def suite_summary(spark, sf_dir):
    return counts.suite_summary(_rows(spark, sf_dir).select((scores.signature() == scores.signature("t_")).alias("correct"), (F.col("status") == "OK").alias("clear"), F.col("t_has_defect").alias("has_defect"), F.col("has_defect").alias("caught"), (F.col("status") == "NEEDS_REVIEW").alias("review")))


def failure_stages(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("BudgetUnavailable", "MissingDocument", "InvalidCheckpoint", "ValueError"))), (F.col("run_id") % 4 + 1).cast("int"))
    bounds = issues.request_bounds(F.col("run_id") * 10, F.col("run_id") % 12)
    return view(spark, sf_dir, "c9").select("run_id", issues.failure_stage(kind).alias("stage"), bounds[0].alias("input_bound"))


def directory_ports(spark, sf_dir):
    names, codes, countries = references.port_directory(view(spark, sf_dir, "c17"))
    return names.groupBy(F.lit("names").alias("kind")).agg(F.count("*").alias("n")).unionByName(codes.groupBy(F.lit("codes").alias("kind")).agg(F.count("*").alias("n"))).unionByName(countries.groupBy(F.lit("countries").alias("kind")).agg(F.count("*").alias("n")))


def port_by_country(spark, sf_dir):
    names, codes, countries = references.port_directory(view(spark, sf_dir, "c17"))
    return references.resolve_ports(view(spark, sf_dir, "c18"), names, codes, countries, text="place").select("case_id", "code")


def further_conflicts(spark, sf_dir):
    return references.further_conflict(view(spark, sf_dir, "c19"))


def latest_versions(spark, sf_dir):
    out = intake.latest(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS case_id", "l_linenumber AS slot", "l_partkey * 1000 + l_suppkey AS version"), ["case_id", "slot"], "version")
    return out.groupBy("superseded").agg(F.count("*").alias("n"), F.max("version").alias("newest"))


_TRUTH = "g AS (SELECT f.case_id, f.field, f.provisional_outcome AS outcome, (f.case_id % 20 = 0 AND f.field = 'container_count') OR (f.case_id % 20 = 1 AND f.field IN ('gross_weight_kg', 'shipper')) AS planted, CASE WHEN f.case_id % 9 <> 0 THEN f.case_id % 23 = 0 END AS assisted FROM findings f)"
_ROLES = sql_with("c14") + """, cur AS (SELECT *, coalesce(has_evidence, false) AS ev FROM c14 WHERE NOT superseded),
g AS (SELECT case_id, count(*) AS n_current, count(*) FILTER (role = 'SI') AS n_si, count(*) FILTER (role = 'BL') AS n_bl, count(*) FILTER (NOT ev OR n_blocks = 0 OR n_issues > 0) AS n_unreadable,
  count(*) FILTER (role = 'SI' AND ev) AS s, count(*) FILTER (role = 'BL' AND ev) AS b, max(attachment_id) FILTER (role = 'SI' AND ev) AS si, max(attachment_id) FILTER (role = 'BL' AND ev) AS bl FROM cur GROUP BY 1)
"""
ORACLES: dict[str, str] = {
    "directory_ports": "SELECT 'names' AS kind, (SELECT count(*) FROM nation WHERE n_nationkey >= 6) + 2 * (SELECT count(*) FROM nation WHERE n_nationkey < 6) AS n UNION ALL SELECT 'codes', count(*) FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 11 <> 10 AND n_nationkey % 7 <> 6 UNION ALL SELECT 'countries', count(*) * 2 FROM region",
    "port_by_country": """WITH n AS (SELECT *, concat('R', chr(CAST(65 + n_regionkey AS INT)), 'L', chr(CAST(65 + n_nationkey AS INT)), 'X') AS code, n_nationkey % 5 <> 4 AND n_nationkey % 11 <> 10 AND n_nationkey % 7 <> 6 AS port FROM nation),
 t AS (SELECT n_regionkey AS rk, count(*) AS k, min(code) AS code, min(port) AS port FROM n WHERE n_nationkey < 6 GROUP BY 1)
 SELECT c_custkey AS case_id, CASE WHEN c_custkey % 4 = 1 THEN CASE WHEN t.k = 1 AND t.port THEN t.code END WHEN n.port THEN n.code END AS code FROM customer JOIN n ON n_nationkey = c_nationkey LEFT JOIN t ON rk = n_regionkey""",
    "further_conflicts": "SELECT o_orderkey AS case_id, o_orderkey % 9 = 0 OR o_orderkey % 13 = 0 AS further_conflict FROM orders",
    "latest_versions": "WITH r AS (SELECT l_partkey * 1000 + l_suppkey AS version, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey * 1000 + l_suppkey DESC) > 1 AS superseded FROM lineitem) SELECT superseded, count(*) AS n, max(version) AS newest FROM r GROUP BY 1",
    "exact_row_accuracy": _SCORED + """, x AS (SELECT 'all' AS decided, exact FROM r WHERE status IS NOT NULL UNION ALL SELECT CASE WHEN reviewer_assisted THEN 'reviewer_assisted' ELSE 'automatic' END, exact FROM r WHERE status IS NOT NULL)
 SELECT decided, count(*) FILTER (exact) AS correct, count(*) AS n, round(count(*) FILTER (exact) / count(*)::DOUBLE, 9) AS accuracy FROM x GROUP BY 1""",
    "wrong_exports": _SCORED + "SELECT case_id FROM r WHERE status IS NOT NULL AND NOT exact",
    "blocker_histogram": _SCORED + "SELECT CASE WHEN blocker <> '' THEN blocker ELSE 'prediction_missing' END AS blocker, count(*) AS n FROM r WHERE blocker <> '' OR status IS NULL GROUP BY 1",
    "export_rates": _SCORED + """SELECT count(*) AS selected, count(*) FILTER (status IS NOT NULL AND NOT reviewer_assisted) AS automatic, count(*) FILTER (reviewer_assisted) AS assisted_selected, count(*) FILTER (status IS NOT NULL AND reviewer_assisted) AS assisted,
 count(*) FILTER (status IS NULL AND reviewer_assisted) AS assisted_abstained, count(*) FILTER (status IS NULL) AS abstained, round(count(*) FILTER (status IS NOT NULL AND NOT reviewer_assisted) / count(*)::DOUBLE, 9) AS automatic_coverage,
 round(count(*) FILTER (status IS NOT NULL AND reviewer_assisted) / count(*)::DOUBLE, 9) AS assisted_coverage FROM r""",
    "defect_scores": _SCORED + ", s AS (SELECT count(*) FILTER (has_defect AND t_has_defect) AS tp, count(*) FILTER (has_defect) AS predicted, count(*) FILTER (t_has_defect) AS actual FROM r) SELECT *, round(tp / predicted::DOUBLE, 9) AS precision, round(tp / actual::DOUBLE, 9) AS recall, round(2 * tp / (predicted + actual)::DOUBLE, 9) AS f1 FROM s",
    "planted_defects": _SCORED + "SELECT count(*) FILTER (exact) AS caught, count(*) AS planted, round(count(*) FILTER (exact) / count(*)::DOUBLE, 9) AS rate FROM r WHERE t_has_defect",
    "escalation_scores": _SCORED + """, s AS (SELECT coalesce(status = 'NEEDS_REVIEW', false) AS said, t_status = 'NEEDS_REVIEW' AS due, t_review_reason FROM r),
 a AS (SELECT count(*) FILTER (said AND due) AS caught, count(*) FILTER (due) AS labelled, count(*) FILTER (said) AS predicted FROM s)
 SELECT t_review_reason AS t_reason, count(*) FILTER (said) AS caught, count(*) AS labelled, CAST(NULL AS BIGINT) AS predicted, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS f1 FROM s WHERE due GROUP BY 1
 UNION ALL SELECT 'all', caught, labelled, predicted, round(caught / predicted::DOUBLE, 9), round(caught / labelled::DOUBLE, 9), round(2 * caught / (predicted + labelled)::DOUBLE, 9) FROM a""",
    "processing_state": sql_with("c13") + ", s AS (SELECT coalesce(processing IN ('completed', 'failed'), false) OR coalesce(run_status IN ('completed', 'failed', 'superseded'), false) AS done, coalesce(processing, '') = 'failed' OR coalesce(run_status, '') = 'failed' AS bad FROM c13) SELECT count(*) FILTER (done) AS terminal, count(*) FILTER (bad) AS failed, count(*) FILTER (NOT done) AS incomplete FROM s",
    "comparison_metrics": _READ + "," + _TRUTH + """, c AS (SELECT case_id, any_value(assisted) AS assisted, count(*) FILTER (outcome = 'match') AS n_match, count(*) FILTER (outcome = 'mismatch') AS n_mismatch, count(*) FILTER (outcome = 'unresolved') AS n_unresolved,
   count(*) FILTER (outcome = CASE WHEN planted THEN 'mismatch' ELSE 'match' END) AS correct FROM g GROUP BY 1),
 k AS (SELECT 'all' AS decided, * FROM c UNION ALL SELECT CASE WHEN assisted THEN 'reviewer_assisted' ELSE 'automatic' END, * FROM c WHERE assisted IS NOT NULL)
 SELECT decided, count(*) AS representable, count(*) FILTER (correct = 7) AS exact, CAST(sum(n_match) AS BIGINT) AS n_match, CAST(sum(n_mismatch) AS BIGINT) AS n_mismatch, CAST(sum(n_unresolved) AS BIGINT) AS n_unresolved, CAST(sum(correct) AS BIGINT) AS correct, count(*) * 7 AS n_fields, round(sum(correct) / (count(*) * 7)::DOUBLE, 9) AS accuracy FROM k GROUP BY 1""",
    "field_micro_f1": _READ + ", t AS (SELECT o_orderkey AS case_id, unnest(CASE WHEN o_orderkey % 20 = 0 THEN ['container_count'] WHEN o_orderkey % 20 = 1 THEN ['gross_weight_kg', 'shipper'] ELSE [] END) AS field FROM orders), s AS (SELECT (SELECT count(*) FROM t JOIN findings f USING (case_id, field) WHERE f.provisional_outcome = 'mismatch') AS tp, (SELECT count(*) FROM findings WHERE provisional_outcome = 'mismatch') AS predicted, (SELECT count(*) FROM t) AS actual) SELECT *, round(tp / predicted::DOUBLE, 9) AS precision, round(tp / actual::DOUBLE, 9) AS recall, round(2 * tp / (predicted + actual)::DOUBLE, 9) AS f1 FROM s",
    "attachment_roles": _ROLES + "SELECT case_id, n_current, n_si, n_bl, n_unreadable, CASE WHEN s = 1 AND b = 1 THEN si END AS si_id, CASE WHEN s = 1 AND b = 1 THEN bl END AS bl_id, CASE WHEN n_current < 2 THEN 'missing_attachment' WHEN n_unreadable > 0 THEN 'unreadable' WHEN n_si <> 1 OR n_bl <> 1 THEN 'wrong_doc_type' END AS reason FROM g",
    "pair_selection": _ROLES + "SELECT CASE WHEN n_unreadable > 0 THEN 'document_unreadable' WHEN n_si > 1 OR n_bl > 1 THEN 'several_documents' WHEN n_si = 1 THEN 'bl_missing' WHEN n_bl = 1 THEN 'si_missing' ELSE 'both_missing' END AS reason, count(*) AS n FROM g GROUP BY 1",
    "assisted_cases": sql_with("c15") + ", a AS (SELECT case_id, action FROM c15 WHERE action IN ('category', 'pair', 'correct') AND actor <> 'Processing' UNION SELECT case_id, 'category' FROM c15 WHERE case_id % 10 = 0), c AS (SELECT DISTINCT case_id FROM c15) SELECT case_id, coalesce(string_agg(DISTINCT action, ',' ORDER BY action), '') AS actions, count(action) > 0 OR case_id % 7 = 0 AS reviewer_assisted FROM c LEFT JOIN a USING (case_id) GROUP BY case_id",
    "blocking_issues": sql_with("c14") + """, i AS (SELECT case_id, role, CASE WHEN n_blocks = 0 THEN 'document_has_no_readable_text' ELSE concat('scan_unclear:page ', role) END AS t FROM c14 WHERE NOT superseded AND (n_issues > 0 OR n_blocks = 0)),
 b AS (SELECT case_id, t FROM i WHERE role <> 'unknown' UNION SELECT case_id, 'asked' FROM i WHERE case_id % 4 = 0) SELECT case_id, coalesce((SELECT string_agg(DISTINCT t, ';' ORDER BY t) FROM b WHERE b.case_id = c.case_id), '') AS blocking, coalesce((SELECT string_agg(DISTINCT t, ';' ORDER BY t) FROM i WHERE i.case_id = c.case_id AND role = 'unknown'), '') AS warnings FROM (SELECT DISTINCT case_id FROM i) c""",
    "evidence_problems": sql_with("c16") + """, g AS (SELECT doc_no, block_id, count(*) AS n, bool_or(trim(text) = '') AS e, bool_or(n_locations = 0) AS l, bool_or(kind = 'docx' AND page IS NOT NULL) AS p FROM c16 GROUP BY 1, 2),
 q AS (SELECT doc_no, concat('duplicate_evidence_id:', block_id) AS t FROM g WHERE n > 1 UNION ALL SELECT doc_no, concat('empty_evidence_text:', block_id) FROM g WHERE e UNION ALL SELECT doc_no, concat('missing_location:', block_id) FROM g WHERE l UNION ALL SELECT doc_no, concat('invented_docx_page:', block_id) FROM g WHERE p
   UNION ALL SELECT o_orderkey, 'empty_reading_without_issue' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT doc_no FROM c16))
 SELECT CAST(o_orderkey AS VARCHAR) AS document_id, coalesce(string_agg(t, ';' ORDER BY t), '') AS problems FROM orders LEFT JOIN q ON doc_no = o_orderkey GROUP BY o_orderkey""",
    "document_previews": sql_with("c16") + """, g AS (SELECT doc_no, ordinal, max(text) AS text, max(method) AS method, max(ocr_pct) AS pct, bool_or(blocked) AS blocked FROM c16 GROUP BY 1, 2),
 h AS (SELECT doc_no, coalesce(string_agg(text, chr(10) ORDER BY ordinal) FILTER (method <> 'ocr' OR coalesce(pct >= 80, false)), '') AS t, count(*) AS n, count(*) FILTER (method <> 'ocr' OR coalesce(pct >= 80, false)) AS k, bool_or(blocked) AS blocked FROM g GROUP BY 1)
 SELECT doc_no AS document_id, CASE WHEN blocked THEN '' ELSE substr(t, 1, 2000) END AS preview, blocked OR length(t) > 2000 OR k <> n AS truncated FROM h""",
    "block_capacity": sql_with("c16") + " SELECT doc_no AS document_id, count(*) AS n_blocks, count(*) <= 240 AS fits FROM c16 GROUP BY 1",
    "ocr_pages": sql_with("c16") + """, g AS (SELECT doc_no AS document_id, CAST(ordinal AS INTEGER) AS page, max(length(text)) AS r, coalesce(max(ocr_pct) / 100.0::DOUBLE, 0) AS s FROM c16 GROUP BY 1, 2), w AS (SELECT *, r < 4 OR (s > 0.25 AND r < 200) AS wanted FROM g WHERE page <= 20)
 SELECT document_id, page, wanted, wanted AND row_number() OVER (PARTITION BY document_id, wanted ORDER BY page) <= 2 AS read FROM w""",
    "queue_pages": sql_with("c1") + " SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS pages FROM c1 WHERE workflow = 'open'",
    "attachment_limits": sql_with("c14") + " SELECT case_id AS email_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, count(*) <= 5 AND sum(size) <= 600000 AS within FROM c14 GROUP BY 1",
    "path_suffixes": r"SELECT lower(regexp_extract(split_part(regexp_extract(url, '://([^?#]*)', 1), '/', -1), '[^.](\.[^.]*)$', 1)) AS suffix, count(*) AS n FROM pages GROUP BY 1",
    "case_selection": "WITH x AS (SELECT DISTINCT l_orderkey * 2 AS id FROM lineitem WHERE l_partkey % 10 = 0) SELECT CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN id IS NOT NULL THEN 'excluded' ELSE 'selected' END AS state, count(*) AS n FROM orders FULL JOIN x ON id = o_orderkey GROUP BY 1",
    "evaluation_chunks": "SELECT (row_number - 1) // 100 AS chunk, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders) GROUP BY 1",
    "rebuilt_flags": sql_with("c1") + " SELECT count(*) AS checked, count(*) FILTER ((processing <> 'failed' AND case_id % 50 = 0) OR case_id % 3 = 0) AS changed FROM c1",
    "stage_times": "WITH e AS (SELECT event_id % 500 AS run_id, CASE event_type WHEN 'click' THEN 'read' WHEN 'error' THEN 'read/ocr' ELSE 'read/parse' END AS path, user_id % 90 AS ms FROM events), t AS (SELECT run_id, path, count(*) AS calls, CAST(sum(ms) AS BIGINT) AS total_ms FROM e GROUP BY 1, 2) SELECT *, total_ms - CASE WHEN path = 'read' THEN CAST(coalesce((SELECT sum(total_ms) FROM t u WHERE u.run_id = t.run_id AND u.path <> 'read'), 0) AS BIGINT) ELSE 0 END AS own_ms FROM t",
    "suite_summary": _SCORED + "SELECT count(*) AS n, count(*) FILTER (exact) AS complete_correct, count(*) FILTER (status = 'OK' AND t_has_defect) AS false_clear, count(*) FILTER (t_has_defect) AS defects, count(*) FILTER (t_has_defect AND has_defect) AS defects_caught, count(*) FILTER (status = 'NEEDS_REVIEW') AS review_required FROM r",
    "failure_stages": sql_with("c9") + " SELECT run_id, CASE run_id % 4 WHEN 0 THEN 'budget_unavailable' WHEN 1 THEN 'source_unavailable' WHEN 2 THEN 'checkpoint_invalid' ELSE 'processing_failed' END AS stage, CASE WHEN run_id * 10 <= 100000 AND run_id % 12 BETWEEN 1 AND 10 THEN run_id * 10 * (run_id % 12 + 1) * 2 + 32768 END AS input_bound FROM c9",
}
QUERIES = {name: f for name, f in list(globals().items()) if name in ORACLES}
