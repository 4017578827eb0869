"""Registered queries over the derived corpora, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import cases, compare, export, intake, operations, references, segment
from ..streaming import replay_actions
from .corpus import sql_with, table, view

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_ORDINAL = "CASE field " + " ".join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(L.FIELDS)) + " END"

# What the rules say about the corpus, in SQL: label, value, issue, verdict.
_READ = sql_with("b") + r""",
cut AS (SELECT *, trim(regexp_replace(text, '^\s*(shipper/exporter|shipper|consignee|party to notify|notify party|port of loading|pol|port of discharge|pod|no\. of containers|container count|containers|gross weight|gross wt)\s*(\([^()]*\))*\s*:\s*', '', 'i')) AS value FROM b),
val AS (SELECT *, lower(regexp_replace(value, '\s+', ' ', 'g')) AS folded,
  CASE WHEN field <> 'consignee' AND text ILIKE 'consignee:%' THEN 'source_field_mismatch' END AS issue0 FROM cut),
num AS (SELECT *, CASE
   WHEN issue0 IS NOT NULL THEN lower(regexp_replace(text, '\s+', ' ', 'g'))
   WHEN folded IN ('n/a', 'none', 'unknown', '-') THEN NULL
   WHEN field = 'container_count' THEN regexp_extract(value, '^(\d+)', 1)
   WHEN field = 'gross_weight_kg' THEN CASE WHEN folded LIKE '% tons' THEN NULL
      WHEN folded LIKE '% mt' THEN CAST(CAST(CAST(regexp_extract(value, '^([\d.]+)', 1) AS DECIMAL(18,3)) * 1000 AS BIGINT) AS VARCHAR) ELSE regexp_extract(value, '^(\d+)', 1) END
   ELSE folded END AS normalized FROM val),
readings AS (SELECT case_id, k, role, field, text, normalized, coalesce(issue0, CASE WHEN normalized IS NULL THEN 'missing_value' END) AS issue,
   CASE WHEN field = 'gross_weight_kg' AND normalized IS NOT NULL THEN CASE WHEN regexp_matches(text, '(?i)(^|[^a-z])(kgs?|mt)([^a-z]|$)') THEN 'explicit' ELSE 'default_kg' END END AS unit_source FROM num),
findings AS (SELECT s.case_id, s.field, s.normalized AS si_value, b.normalized AS bl_value, s.issue AS si_issue, b.issue AS bl_issue,
   CASE WHEN s.issue IS NOT NULL OR b.issue IS NOT NULL OR s.normalized IS NULL OR b.normalized IS NULL THEN 'unresolved' WHEN s.normalized = b.normalized THEN 'match' ELSE 'mismatch' END AS provisional_outcome
   FROM readings s JOIN readings b ON s.case_id = b.case_id AND s.field = b.field AND s.role = 'SI' AND b.role = 'BL')
"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.read_values(view(spark, sf_dir, "b"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.findings(_readings(spark, sf_dir))


def recon_findings(spark, sf_dir):
    """All findings, the seven of a case in one row."""
    return compare.in_one_row(_findings(spark, sf_dir), "si_value", "bl_value", "outcome", "provisional_outcome")


def recon_outcomes_by_field(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("field", "outcome").agg(F.count("*").alias("n"))


def case_report_facts(spark, sf_dir):
    out = compare.report_facts(_findings(spark, sf_dir))
    return out.select("case_id", F.array_join("mismatches", ",").alias("mismatches"), F.array_join("unresolved", ",").alias("unresolved"), "complete")


_FACTS = f"""facts AS (SELECT case_id, coalesce(string_agg(field, ',' ORDER BY {_ORDINAL}) FILTER (provisional_outcome = 'mismatch'), '') AS mismatches,
  coalesce(string_agg(field, ',' ORDER BY {_ORDINAL}) FILTER (provisional_outcome = 'unresolved'), '') AS unresolved, count(DISTINCT field) = 7 AS complete FROM findings GROUP BY case_id)"""


def weight_units(spark, sf_dir):
    rows = _readings(spark, sf_dir).where("field = 'gross_weight_kg'")
    return rows.select("case_id", "role", F.col("normalized").alias("kg"), "unit_source")


def container_equipment(spark, sf_dir):
    return _readings(spark, sf_dir).where("field = 'container_count'").select("case_id", "role", F.col("normalized").alias("containers"))


def missing_markers(spark, sf_dir):
    return _readings(spark, sf_dir).where("normalized is null").groupBy("role", "field").agg(F.count("*").alias("n"))


def source_field_check(spark, sf_dir):
    return _readings(spark, sf_dir).groupBy("role", "field", F.coalesce("issue", F.lit("none")).alias("issue")).agg(F.count("*").alias("n"))


def reading_issue_cascade(spark, sf_dir):
    own = _readings(spark, sf_dir).where("role = 'BL'").join(view(spark, sf_dir, "c2"), "case_id")
    quality = compare.quality_issue(F.col("method"), F.col("ocr_pct") / 100, F.col("field_pct") / 100)
    return own.select("case_id", "field", F.coalesce("issue", quality).alias("issue"))


def override_readings(spark, sf_dir):
    """A reviewer's value (the other side's) replaces the machine's for flagged cases."""
    rows = _readings(spark, sf_dir).join(view(spark, sf_dir, "c2").select("case_id", "has_override"), "case_id")
    si = F.max(F.when(F.col("role") == "SI", F.col("normalized")))
    bl = F.max(F.when(F.col("role") == "BL", F.col("normalized")))
    out = rows.where("field = 'container_count'").groupBy("case_id").agg(si.alias("si"), bl.alias("bl"), F.bool_or("has_override").alias("o"))
    return out.select("case_id", F.when(F.col("o"), F.col("si")).otherwise(F.col("bl")).alias("value"), F.when(F.col("o"), "human_verified").otherwise("machine").alias("provenance"))


def port_resolution(spark, sf_dir):
    ports = _readings(spark, sf_dir).where("field in ('port_of_loading', 'port_of_discharge')")
    out = references.resolve_ports(ports, view(spark, sf_dir, "c3_name"), view(spark, sf_dir, "c3_code"))
    return out.select("case_id", "role", "field", "code")


def reference_sets(spark, sf_dir):
    sets = references.reference_sets(view(spark, sf_dir, "c4"))
    return sets.select("case_id", "role", *(F.array_join(k, ",").alias(k) for k in ("shipment", "booking", "oc")))


def pair_validity(spark, sf_dir):
    return references.pair_validity(view(spark, sf_dir, "c4"))


def shared_tokens(spark, sf_dir):
    return references.shared_tokens(view(spark, sf_dir, "c4"))


_SETS = sql_with("c4") + r""",
ids AS (SELECT case_id, role, regexp_extract(text, 'Shipment (?:ID|Reference): (\S+)', 1) AS shipment, regexp_extract(text, 'Booking (?:Ref:|No\.) (\S+)', 1) AS booking, regexp_extract(text, 'OC No\.: (\S+)', 1) AS oc FROM c4)
"""


def _emails(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "c1").withColumn("confidence", F.col("confidence_pct") / 100)
    return rows.withColumn("accepted", F.when(F.col("source") == "human", F.col("suggested")).otherwise(cases.accepted_category(F.col("suggested"), F.col("confidence"))))


_EMAILS = sql_with("c1") + """,
e AS (SELECT *, CASE WHEN source = 'human' OR confidence_pct >= CASE WHEN suggested = 'SPAM' THEN 95 ELSE 80 END THEN suggested END AS accepted FROM c1),
q AS (SELECT *, coalesce(accepted = 'SPAM', false) OR coalesce(accepted IS NULL AND suggested = 'SPAM' AND source <> 'human', false) AS spam,
  accepted IS NULL OR processing = 'failed' AS needs_review, case_id % 20 IN (0, 1, 2) AS has_mismatch FROM e)
"""


def _queue(spark, sf_dir) -> DataFrame:
    e = _emails(spark, sf_dir)
    return e.withColumn("spam", cases.is_spam(F.col("accepted"), F.col("suggested"), F.col("source"))).withColumn("needs_review", F.col("accepted").isNull() | (F.col("processing") == "failed")).withColumn("has_mismatch", (F.col("case_id") % 20).isin(0, 1, 2)).withColumn("assignee", F.lit(None).cast("string"))


def accept_category(spark, sf_dir):
    return _emails(spark, sf_dir).select("case_id", "accepted")


def queue_views(spark, sf_dir):
    rows, out = _queue(spark, sf_dir), None
    for name in ("all", "mismatches", "spam", "review", "waiting", "completed"):
        part = cases.queue(rows, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def queue_page(spark, sf_dir):
    return cases.page(cases.queue(_queue(spark, sf_dir), "review", query="order 1"), 2, 25).select("case_id", "subject", "received_at")


def queue_counts(spark, sf_dir):
    return cases.counts(_queue(spark, sf_dir))


def _scored(spark, sf_dir) -> DataFrame:
    return _emails(spark, sf_dir).select("case_id", "truth", F.coalesce("accepted", F.lit("GENERAL")).alias("predicted"))


def confusion(spark, sf_dir):
    return export.confusion(_scored(spark, sf_dir))


def class_scores(spark, sf_dir):
    out = export.class_scores(_scored(spark, sf_dir))
    return out.select("category", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


def macro_f1(spark, sf_dir):
    return export.macro_f1(_scored(spark, sf_dir)).select(F.round("macro_f1", 9).alias("macro_f1"))


def category_accuracy(spark, sf_dir):
    e = _emails(spark, sf_dir)
    kinds = F.explode(F.array(F.struct(F.lit("accepted").alias("k"), F.col("accepted").alias("p")), F.struct(F.lit("suggested").alias("k"), F.col("suggested").alias("p")))).alias("v")
    rows = e.select("truth", kinds).select("truth", "v.k", "v.p").where("p is not null")
    out = rows.groupBy(F.col("k").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("truth")).alias("correct"))
    return out.select("kind", "n", "correct", F.round(export.ratio(F.col("correct"), F.col("n")), 9).alias("accuracy"))


def field_metrics(spark, sf_dir):
    """Outcome counts for all cases and by who decided the category, in one pass."""
    found = _findings(spark, sf_dir).join(view(spark, sf_dir, "c1").select("case_id", F.when(F.col("source") == "human", "assisted").otherwise("automatic").alias("decided")), "case_id")
    found.createOrReplaceTempView("_field_findings")
    return spark.sql("SELECT coalesce(decided, 'all') AS cases, field, count(*) AS n, count_if(outcome = 'match') AS n_match, count_if(outcome = 'mismatch') AS n_mismatch, count_if(outcome = 'unresolved') AS n_unresolved FROM _field_findings GROUP BY GROUPING SETS ((decided, field), (field))")


def _decided(spark, sf_dir) -> DataFrame:
    odd = F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("outcome") == "unresolved", F.array_compact(F.array("si_issue", "bl_issue")))))))
    facts = compare.report_facts(_findings(spark, sf_dir), issues=odd)
    valid = references.pair_validity(view(spark, sf_dir, "c4")).select("case_id", F.col("valid").alias("pair_valid"))
    rows = _emails(spark, sf_dir).select("case_id", "accepted", "suggested", "source", "processing").join(facts, "case_id", "left").join(valid, "case_id", "left")
    rows = rows.withColumn("report_present", F.col("complete").isNotNull()).withColumn("report_current", F.lit(True)).withColumn("n_attachments", F.when(F.col("report_present"), 2).otherwise(0))
    return rows.withColumn("complete", F.coalesce("complete", F.lit(False))).withColumn("pair_valid", F.coalesce("pair_valid", F.lit(False)))


def case_summary_kind(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = _decided(spark, sf_dir).withColumn("blocking", none).withColumn("unused_warnings", none).withColumn("review_reasons", none)
    out = cases.assess(rows)
    return out.select("case_id", cases.summary_kind(out).alias("kind"), "can_be_clear", "needs_review")


def export_rows(spark, sf_dir):
    out = export.decide(_decided(spark, sf_dir))
    return out.select("case_id", "status", "review_reason", "has_defect", F.array_join("defect_fields", ",").alias("defect_fields"), "blocker")


def export_blockers(spark, sf_dir):
    out = export.decide(_decided(spark, sf_dir))
    return out.where("blocker is not null").groupBy("blocker").agg(F.count("*").alias("n"))


def export_coverage(spark, sf_dir):
    out = export.decide(_decided(spark, sf_dir))
    return out.groupBy(F.coalesce("status", F.lit("BLOCKED")).alias("status")).agg(F.count("*").alias("n"))


_DECIDED = _EMAILS.replace("WITH c1 AS", "c1 AS", 1).strip()
_DECIDED = _READ + "," + _FACTS + "," + _DECIDED + "," + _SETS.replace("WITH c4 AS", "c4 AS", 1).strip() + """,
pairs AS (SELECT s.case_id, (s.shipment <> '' AND s.shipment = b.shipment OR s.booking <> '' AND s.booking = b.booking) AND NOT (s.shipment <> '' AND b.shipment <> '' AND s.shipment <> b.shipment)
  AND NOT (s.booking <> '' AND b.booking <> '' AND s.booking <> b.booking) AS valid FROM ids s JOIN ids b ON s.case_id = b.case_id AND s.role = 'SI' AND b.role = 'BL'),
iss AS (SELECT case_id, bool_or(coalesce(si_issue, '') = 'missing_value' OR coalesce(bl_issue, '') = 'missing_value') AS missing, bool_or(coalesce(si_issue, '') = 'source_field_mismatch' OR coalesce(bl_issue, '') = 'source_field_mismatch') AS odd FROM findings GROUP BY case_id),
d AS (SELECT e.case_id, e.accepted, e.suggested, e.source, e.processing, f.mismatches, f.unresolved, f.complete IS NOT NULL AS present, coalesce(p.valid, false) AS valid, i.missing, i.odd
  FROM e LEFT JOIN facts f USING (case_id) LEFT JOIN pairs p USING (case_id) LEFT JOIN iss i USING (case_id)),
x AS (SELECT *, CASE WHEN processing <> 'completed' THEN 'processing_incomplete' WHEN accepted IS NULL THEN 'category_unresolved' WHEN accepted <> 'BL_COMPARISON' THEN NULL WHEN NOT present THEN NULL
  WHEN NOT valid THEN 'pairing_unresolved' WHEN mismatches <> '' AND unresolved <> '' AND NOT (missing AND NOT odd) THEN 'mixed_outcomes_unrepresentable' WHEN mismatches = '' AND unresolved <> '' AND odd THEN 'review_reason_unrepresentable' END AS blocker FROM d),
y AS (SELECT *, CASE WHEN blocker IS NULL AND accepted = 'BL_COMPARISON' THEN CASE WHEN NOT present THEN 'missing_attachment' WHEN missing THEN 'missing_value' END END AS review_reason FROM x),
z AS (SELECT *, blocker IS NULL AND accepted = 'BL_COMPARISON' AND present AND review_reason IS NULL AND mismatches <> '' AS defect FROM y),
w AS (SELECT *, CASE WHEN blocker IS NULL THEN CASE WHEN review_reason IS NOT NULL THEN 'NEEDS_REVIEW' WHEN defect THEN 'MISMATCH' ELSE 'OK' END END AS status FROM z)
"""


def id_reconciliation(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    actual = view(spark, sf_dir, "b").select("case_id").distinct()
    return intake.only_expected(expected, actual, "case_id")


def holdout_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(export.split_of(F.col("o_orderkey").cast("string")).alias("split")).agg(F.count("*").alias("n"))


def import_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return intake.import_outcome(docs).select("doc_id", "outcome")


def attachment_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]+/([^?#]*)", 1).alias("path"))
    members = pages.where("page_id % 3 <> 0").select("path")
    ref = F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(intake.basename(F.col("path")))
    return intake.resolve(pages.select((F.col("page_id") % 100).alias("email_id"), ref.alias("ref")), members)


def sheet_rows(spark, sf_dir):
    return segment.sheet_rows(view(spark, sf_dir, "c7"))


def ocr_line_confidence(spark, sf_dir):
    """Words of documents set ten to a line; texts of one id are one page."""
    texts = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))

    def placed(word, pos):
        conf = F.when(pos % 170 == 0, None).otherwise(F.pmod(F.col("doc_id") * pos, F.lit(101)))
        return F.struct(F.floor(pos / 10).alias("line"), (pos % 10 * 30).alias("x0"), word.alias("word"), conf.alias("conf"))

    words = F.flatten(F.transform("texts", lambda t: F.transform(F.split(t, r"[\x20\x09-\x0D]+", -1), placed)))
    pages = texts.select("doc_id", F.filter(words, lambda w: w["word"] != "").alias("words"))
    return segment.ocr_lines(pages).select("doc_id", "line", "n", "confidence", F.md5("text").alias("text_md5"))


def text_blocks(spark, sf_dir):
    return segment.text_blocks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.max("line_end").alias("last_line"))


def script_route(spark, sf_dir):
    """Documents, some with words of other languages before them."""
    text = F.expr("CASE doc_id % 5 WHEN 1 THEN concat('收货人装货港 ', text) WHEN 2 THEN concat('收货人 ', text) WHEN 3 THEN concat('Berat dan tarikh ', text) WHEN 4 THEN concat('dan dan ', text) ELSE text END")
    return table(spark, sf_dir, "documents").groupBy("lang", segment.script_route(text).alias("route")).agg(F.count("*").alias("n"))


def run_status(spark, sf_dir):
    return view(spark, sf_dir, "c9").groupBy("status").agg(F.count("*").alias("n"))


def ops_metrics(spark, sf_dir):
    return operations.metrics(view(spark, sf_dir, "c9"))


def recoverable_runs(spark, sf_dir):
    return operations.recoverable(view(spark, sf_dir, "c9"), F.expr(NOW)).select("run_id", "status", F.col("attempts").cast("int").alias("attempts"), operations.retry_delay(F.col("attempts")).alias("delay_s"))


def oldest_runs(spark, sf_dir):
    return operations.eligible(view(spark, sf_dir, "c9"), F.expr(NOW)).orderBy("created_at", "run_id").limit(50).select("run_id", "created_at")


def settlement(spark, sf_dir):
    return operations.settle(view(spark, sf_dir, "c10")).select("reservation_id", "state", "settled_amount")


def ledger_rollup(spark, sf_dir):
    return operations.ledger(operations.settle(view(spark, sf_dir, "c10")))


def actions_replay(spark, sf_dir):
    """Stale actions name an outdated revision, the others take the current one."""
    log = view(spark, sf_dir, "c11").select("case_id", F.col("seq").cast("long").alias("seq"), "kind", F.when(F.col("stale"), F.lit(-1)).cast("long").alias("expected_revision"))
    return replay_actions(log).select("case_id", "seq", "applied", "revision", "input_revision")


_SETTLED = sql_with("c10") + """,
s AS (SELECT *, CAST(ceil(CAST(input_tokens AS DECIMAL(18,0)) * in_rate + CAST(output_tokens AS DECIMAL(18,0)) * out_rate) AS BIGINT) AS actual FROM c10),
t AS (SELECT reservation_id, purpose, CASE WHEN input_tokens IS NULL OR output_tokens IS NULL THEN 'invalid_usage' WHEN actual > amount THEN 'over_reservation' ELSE 'settled' END AS state,
  CASE WHEN input_tokens IS NOT NULL AND actual <= amount THEN actual ELSE amount END AS settled_amount FROM s)
"""
_CATS = ("BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY", "GENERAL", "SPAM")
_CLASS = _EMAILS + """,
r AS (SELECT truth, coalesce(accepted, 'GENERAL') AS predicted FROM e),
cs AS (SELECT c AS category, (SELECT count(*) FROM r WHERE truth = c AND predicted = c) AS tp, (SELECT count(*) FROM r WHERE truth <> c AND predicted = c) AS fp, (SELECT count(*) FROM r WHERE truth = c AND predicted <> c) AS fn
  FROM (SELECT unnest(['BL_COMPARISON', 'SI_REQUEST', 'INVOICE_QUERY', 'GENERAL', 'SPAM']) AS c))
"""
_PATHS = r"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]+/([^?#]*)', 1) AS path FROM pages), m AS (SELECT DISTINCT path FROM p WHERE page_id % 3 <> 0),
n AS (SELECT split_part(path, '/', -1) AS name, count(*) AS c, min(path) AS only_path FROM m GROUP BY 1),
r AS (SELECT DISTINCT page_id % 100 AS email_id, CASE WHEN page_id % 2 = 0 THEN path ELSE split_part(path, '/', -1) END AS ref FROM p)
SELECT email_id, ref, coalesce(m.path, CASE WHEN c = 1 THEN only_path END) AS member, CASE WHEN m.path IS NOT NULL THEN 'exact' WHEN c = 1 THEN 'by_name' WHEN c > 1 THEN 'ambiguous' ELSE 'missing' END AS state
FROM r LEFT JOIN m ON m.path = r.ref LEFT JOIN n ON n.name = split_part(r.ref, '/', -1)"""

ORACLES: dict[str, str] = {
    "recon_findings": _READ + "SELECT case_id, " + ", ".join(f"string_agg(coalesce({x}, '-'), '|' ORDER BY {_ORDINAL}) AS {name}" for x, name in (("si_value", "si_value"), ("bl_value", "bl_value"), ("provisional_outcome", "outcome"), ("provisional_outcome", "provisional_outcome"))) + " FROM findings GROUP BY case_id",
    "recon_outcomes_by_field": _READ + "SELECT field, provisional_outcome AS outcome, count(*) AS n FROM findings GROUP BY 1, 2",
    "case_report_facts": _READ + "," + _FACTS + " SELECT * FROM facts",
    "weight_units": _READ + "SELECT case_id, role, normalized AS kg, unit_source FROM readings WHERE field = 'gross_weight_kg'",
    "container_equipment": _READ + "SELECT case_id, role, normalized AS containers FROM readings WHERE field = 'container_count'",
    "missing_markers": _READ + "SELECT role, field, count(*) AS n FROM readings WHERE normalized IS NULL GROUP BY 1, 2",
    "source_field_check": _READ + "SELECT role, field, coalesce(issue, 'none') AS issue, count(*) AS n FROM readings GROUP BY 1, 2, 3",
    "reading_issue_cascade": _READ + ", c2 AS (" + sql_with("c2").removeprefix("WITH c2 AS (").removesuffix(")") + ") SELECT case_id, field, coalesce(issue, CASE WHEN method = 'ocr' AND ocr_pct IS NULL THEN 'ocr_confidence_unavailable' WHEN method = 'ocr' AND ocr_pct < 80 THEN 'low_ocr_confidence' WHEN field_pct < 80 THEN 'low_field_confidence' END) AS issue FROM readings JOIN c2 USING (case_id) WHERE role = 'BL'",
    "override_readings": _READ + "SELECT s.case_id, CASE WHEN s.case_id % 23 = 0 THEN s.normalized ELSE b.normalized END AS value, CASE WHEN s.case_id % 23 = 0 THEN 'human_verified' ELSE 'machine' END AS provenance FROM readings s JOIN readings b ON s.case_id = b.case_id AND s.field = 'container_count' AND b.field = 'container_count' AND s.role = 'SI' AND b.role = 'BL'",
    "port_resolution": _READ + ", nm AS (SELECT lower(n_name) AS alias, concat('N', chr(CAST(65 + n_nationkey AS INT)), 'PRT') AS code, n_nationkey AS nk FROM nation) SELECT r.case_id, r.role, r.field, CASE WHEN nk < 20 THEN code END AS code FROM readings r LEFT JOIN nm ON regexp_replace(r.normalized, ' \\([a-z]{5}\\)$', '') = nm.alias WHERE field IN ('port_of_loading', 'port_of_discharge')",
    "reference_sets": _SETS + "SELECT case_id, role, upper(shipment) AS shipment, upper(booking) AS booking, upper(oc) AS oc FROM ids",
    "pair_validity": _SETS + ", j AS (SELECT s.case_id, (s.shipment <> '' AND b.shipment <> '' AND s.shipment <> b.shipment) OR (s.booking <> '' AND b.booking <> '' AND s.booking <> b.booking) AS conflict, (s.shipment <> '' AND s.shipment = b.shipment) OR (s.booking <> '' AND s.booking = b.booking) AS shared FROM ids s JOIN ids b ON s.case_id = b.case_id AND s.role = 'SI' AND b.role = 'BL') SELECT case_id, conflict, shared, shared AND NOT conflict AS valid FROM j",
    "shared_tokens": _SETS + ", t AS (SELECT case_id, role, unnest([shipment, booking, oc]) AS token FROM ids), c AS (SELECT case_id, token FROM t WHERE token <> '' GROUP BY 1, 2 HAVING count(DISTINCT role) = 2) SELECT case_id, token, CAST(row_number() OVER (PARTITION BY case_id ORDER BY token) AS INTEGER) AS n FROM c",
    "accept_category": _EMAILS + "SELECT case_id, accepted FROM e",
    "queue_views": _EMAILS + "SELECT 'all' AS view, count(*) AS n FROM q UNION ALL SELECT 'mismatches', count(*) FROM q WHERE NOT spam AND has_mismatch UNION ALL SELECT 'spam', count(*) FROM q WHERE spam UNION ALL SELECT 'review', count(*) FROM q WHERE NOT spam AND (needs_review OR has_mismatch) AND workflow = 'open' UNION ALL SELECT 'waiting', count(*) FROM q WHERE NOT spam AND workflow = 'waiting' UNION ALL SELECT 'completed', count(*) FROM q WHERE NOT spam AND workflow = 'completed'",
    "queue_page": _EMAILS + "SELECT case_id, subject, received_at FROM q WHERE NOT spam AND (needs_review OR has_mismatch) AND workflow = 'open' AND subject ILIKE '%order 1%' ORDER BY received_at DESC, case_id LIMIT 25 OFFSET 25",
    "queue_counts": _EMAILS + "SELECT workspace_id, count(*) AS n_cases, count(*) FILTER (spam) AS n_spam, count(*) FILTER (NOT spam AND (needs_review OR has_mismatch) AND workflow = 'open') AS n_review FROM q GROUP BY 1",
    "confusion": _EMAILS + "SELECT truth, " + ", ".join(f"count(*) FILTER (coalesce(accepted, 'GENERAL') = '{c}') AS \"{c}\"" for c in _CATS) + " FROM e GROUP BY truth",
    "class_scores": _CLASS + "SELECT category, tp, fp, fn, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE, 9) AS f1 FROM cs",
    "macro_f1": _CLASS + "SELECT round(avg(CASE WHEN tp > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END), 9) AS macro_f1 FROM cs",
    "category_accuracy": _EMAILS + "SELECT kind, count(*) AS n, count(*) FILTER (p = truth) AS correct, round(count(*) FILTER (p = truth) / CAST(count(*) AS DOUBLE), 9) AS accuracy FROM (SELECT truth, 'accepted' AS kind, accepted AS p FROM e UNION ALL SELECT truth, 'suggested', suggested FROM e) WHERE p IS NOT NULL GROUP BY kind",
    "field_metrics": _READ + ", g AS (SELECT f.*, CASE WHEN case_id % 97 = 0 THEN 'assisted' ELSE 'automatic' END AS decided FROM findings f) SELECT coalesce(decided, 'all') AS cases, field, count(*) AS n, count(*) FILTER (provisional_outcome = 'match') AS n_match, count(*) FILTER (provisional_outcome = 'mismatch') AS n_mismatch, count(*) FILTER (provisional_outcome = 'unresolved') AS n_unresolved FROM g GROUP BY GROUPING SETS ((decided, field), (field))",
    "case_summary_kind": _DECIDED + """, s AS (SELECT *, coalesce(mismatches, '') <> '' AS mm, coalesce(unresolved, '') <> '' AS un, coalesce(accepted = 'SPAM', false) AS conf, coalesce(accepted IS NULL AND suggested = 'SPAM' AND source <> 'human', false) AS susp FROM w),
 t AS (SELECT *, coalesce(accepted = 'BL_COMPARISON', false) AND present AND valid AND NOT mm AND NOT un AS can_be_clear, CASE WHEN accepted IS NOT NULL AND accepted <> 'BL_COMPARISON' THEN processing = 'failed' ELSE processing = 'failed' OR NOT (present AND valid) OR un OR mm OR accepted IS NULL END AS needs_review FROM s)
 SELECT case_id, CASE WHEN conf THEN 'spam' WHEN susp THEN 'suspected_spam' WHEN processing <> 'completed' THEN processing WHEN accepted IS NULL THEN 'needs_review' WHEN accepted <> 'BL_COMPARISON' THEN CASE WHEN needs_review THEN 'needs_review' ELSE 'categorized' END
 WHEN NOT present THEN 'needs_review' WHEN mm THEN CASE WHEN NOT valid OR un THEN 'mismatch_review' ELSE 'mismatch' END WHEN NOT valid OR un THEN 'needs_review' ELSE 'match' END AS kind, can_be_clear, needs_review FROM t""",
    "export_rows": _DECIDED + "SELECT case_id, status, review_reason, CASE WHEN blocker IS NULL THEN defect END AS has_defect, CASE WHEN defect THEN mismatches ELSE '' END AS defect_fields, blocker FROM w",
    "export_blockers": _DECIDED + "SELECT blocker, count(*) AS n FROM w WHERE blocker IS NOT NULL GROUP BY 1",
    "export_coverage": _DECIDED + "SELECT coalesce(status, 'BLOCKED') AS status, count(*) AS n FROM w GROUP BY 1",
    "id_reconciliation": "SELECT o_orderkey AS case_id, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "holdout_split": "SELECT CASE WHEN CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0 THEN 'holdout' ELSE 'development' END AS split, count(*) AS n FROM orders GROUP BY 1",
    "import_dedupe": "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome FROM documents",
    "attachment_resolution": _PATHS,
    "sheet_rows": sql_with("c7") + ", g AS (SELECT sheet, row_no, bool_or(uncertain) AS uncertain, string_agg(value, ': ' ORDER BY col) AS text FROM c7 GROUP BY 1, 2) SELECT sheet, row_no, CASE WHEN NOT uncertain THEN text END AS text, uncertain FROM g",
    "ocr_line_confidence": r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS pos FROM s),
 v AS (SELECT *, CASE WHEN pos % 170 = 0 THEN NULL ELSE doc_id * pos % 101 END AS conf FROM u WHERE word <> '')
 SELECT doc_id, pos // 10 AS line, count(*) AS n, CASE WHEN count(*) FILTER (conf IS NULL) = 0 THEN min(conf) / 100.0::DOUBLE END AS confidence, md5(string_agg(word, ' ' ORDER BY pos)) AS text_md5 FROM v GROUP BY 1, 2""",
    "script_route": "SELECT lang, CASE WHEN text IS NULL THEN 'english' WHEN doc_id % 5 = 1 THEN 'chinese' WHEN doc_id % 5 = 3 THEN 'malay' ELSE 'english' END AS route, count(*) AS n FROM documents GROUP BY 1, 2",
    "run_status": sql_with("c9") + " SELECT status, count(*) AS n FROM c9 GROUP BY 1",
    "ops_metrics": sql_with("c9") + " SELECT count(*) AS n_runs, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (attempts > 1) AS retried, count(*) FILTER (status = 'queued' AND dispatched_at IS NULL) AS undispatched, min(created_at) FILTER (status = 'queued') AS oldest_queued FROM c9",
    "recoverable_runs": sql_with("c9") + f" SELECT run_id, status, attempts, CASE WHEN attempts > 0 THEN CAST(least(60, 5 * pow(2, attempts - 1)) AS INTEGER) ELSE 0 END AS delay_s FROM c9 WHERE (status = 'queued' OR (status = 'running' AND lease_until < {NOW})) AND (attempts >= 3 OR dispatched_at IS NULL OR created_at < {NOW} - INTERVAL 15 MINUTE)",
    "oldest_runs": sql_with("c9") + f" SELECT run_id, created_at FROM c9 WHERE (status = 'queued' OR (status = 'running' AND lease_until < {NOW})) AND attempts < 3 AND dispatched_at IS NOT NULL AND created_at + to_seconds(CASE WHEN attempts > 0 THEN CAST(least(60, 5 * pow(2, attempts - 1)) AS INTEGER) ELSE 0 END) <= {NOW} ORDER BY created_at, run_id LIMIT 50",
    "settlement": _SETTLED + "SELECT reservation_id, state, settled_amount FROM t",
    "ledger_rollup": _SETTLED + "SELECT purpose, count(*) AS n, CAST(sum(settled_amount) AS BIGINT) AS held, count(*) FILTER (state = 'settled') AS n_settled, bool_or(state = 'over_reservation') AS blocked FROM t GROUP BY 1",
    "actions_replay": sql_with("c11") + ", a AS (SELECT case_id, seq, NOT stale AS applied, CASE WHEN NOT stale THEN 1 ELSE 0 END AS one, CASE WHEN NOT stale AND kind IN ('category', 'not_spam') THEN 1 ELSE 0 END AS two FROM c11) SELECT case_id, seq, applied, CAST(sum(one) OVER w AS BIGINT) AS revision, CAST(1 + sum(two) OVER w AS BIGINT) AS input_revision FROM a WINDOW w AS (PARTITION BY case_id ORDER BY seq)",
}

QUERIES = {name: f for name, f in list(globals().items()) if name in ORACLES or name in ("text_blocks",)}
