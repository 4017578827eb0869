"""Scores, issues, evidence, ports and counts on hand-made rows."""

from pyspark.sql import functions as F

from tallymark.functions import labels as L
from tallymark.operators import compare, counts, evidence, export, intake, issues, references, scores, segment
from tallymark.sources import safe_path


def _text(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def test_issue_texts(spark):
    rows = _text(spark, ["code: a:b ", "bare", "  ", ":only detail", None]).select(issues.parse_issue(F.col("x")).alias("i")).select("i.*", issues.issue_text(F.col("i")).alias("t")).collect()
    assert [(r.code, r.detail, r.t) for r in rows] == [("code", "a:b", "code:a:b"), ("bare", "", "bare"), ("unknown_issue", "", "unknown_issue"), ("unknown_issue", "only detail", "unknown_issue:only detail"), ("unknown_issue", "", "unknown_issue")]
    assert all(r.blocking and r.scope == "unknown" for r in rows)


def test_blocking_and_warnings(spark):
    rows = spark.createDataFrame([(1, [("b", "", "selected_pair", True), ("a", "x", "unused_attachment", True), ("c", "", "selected_pair", False)], None, ["b", "r"]), (2, None, None, None)], f"case_id int, pair_issues array<{issues.ISSUE}>, report_issues array<{issues.ISSUE}>, review_reasons array<string>")
    out = {r.case_id: (r.blocking, r.unused_warnings) for r in issues.blocking(rows).collect()}
    assert out == {1: (["b", "r"], ["a:x"]), 2: ([], [])}
    both = rows.select(issues.reasons_of_report(F.array(F.lit("p")), F.col("review_reasons")).alias("r")).collect()
    assert [r.r for r in both] == [["p", "b", "r"], ["p"]]


def test_duplicate_reading_is_unresolved(spark):
    rows = [(1, side, f, "v", None) for side in ("SI", "BL") for f in L.FIELDS] + [(1, "SI", L.FIELDS[0], "v", None), (2, "SI", L.FIELDS[1], "w", None)]
    out = compare.findings(spark.createDataFrame(rows, "case_id int, role string, field string, normalized string, issue string")).collect()
    first = {r.field: r for r in out if r.case_id == 1}
    assert len(out) == 14 and first[L.FIELDS[0]].outcome == "unresolved" and first[L.FIELDS[0]].si_issue == "ambiguous_reading"
    assert all(first[f].outcome == "match" for f in L.FIELDS[1:]) and all(r.outcome == "unresolved" for r in out if r.case_id == 2)


def test_import_keeps_rows_without_digest(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "doc_id int, digest string")
    out = {r.doc_id: r.outcome for r in intake.import_outcome(rows, spark.createDataFrame([("b",), (None,)], "digest string")).collect()}
    assert out == {1: "accepted", 2: "duplicate", 3: "failed", 4: "duplicate"}
    assert intake.import_outcome(rows.limit(0)).count() == 0


def test_published_scores():
    """Counts that the evaluation publishes give its figures."""
    precision, recall = 18 / 109, 18 / 20
    assert round(precision, 6) == 0.165138 and round(2 * precision * recall / (precision + recall), 6) == 0.27907


def test_final_score(spark):
    got = spark.range(1).select(export.final_score(F.lit(0.9875069399594366), F.lit(1.0), F.lit(1.0)).alias("s")).first().s
    assert round(got, 6) == 0.996252


def test_scores_of_nothing(spark):
    schema = "case_id int, category string, status string, review_reason string, has_defect boolean, defect_fields array<string>, t_category string, t_status string, t_review_reason string, t_has_defect boolean, t_defect_fields array<string>, reviewer_assisted boolean, blockers array<string>, processing string, run_status string"
    rows = spark.createDataFrame([], schema)
    assert scores.defect_scores(rows).first().f1 == 0.0 and scores.end_to_end(rows).first().rate == 0.0
    assert scores.export_rates(rows).first().automatic_coverage is None
    assert [r.caught for r in scores.escalation(rows).collect()] == [0] and scores.blocked_but_predicted(rows).count() == 0


def test_further_identifiers(spark):
    texts = ["Order No.: AB-12/9", "order reference xy9z1, bill of lading no. 7788-A", "in good order today", "Order 2024", "提单编号：无 提单编号 MX-100"]
    out = _text(spark, texts).select(references.further_identifiers(F.col("x"), "order").alias("o"), references.further_identifiers(F.col("x"), "bill").alias("b")).collect()
    assert [r.o for r in out] == [["AB-12/9"], ["XY9Z1"], [], ["2024"], []]
    assert [r.b for r in out] == [[], ["7788-A"], [], [], ["MX-100"]]


def test_ports_with_countries(spark):
    entries = [(None, "AA", None, ".Aland", None, None, None, None), (None, "BB", None, ".Bland", None, None, None, None), (None, "AA", "XXX", "Twin", "Twin", None, "1--", "AI"), (None, "BB", "YYY", "Twin", None, None, "1--", "AI"), (None, "AA", "ZZZ", "Inland", None, None, "-3-", "AI"), ("X", "AA", "OLD", "Gone", None, None, "1--", "AI")]
    directory = references.port_directory(spark.createDataFrame(entries, "marker string, country string, location string, name string, plain_name string, division string, function string, status string"))
    texts = ["Twin", "twin, Aland", "TWIN,  bb", "twin, nowhere", "Inland", "gone", "AAXXX", "twin, aland (AAXXX)", "twin, aland (BBYYY)", None]
    out = references.resolve_ports(_text(spark, texts).withColumn("n", F.monotonically_increasing_id()), *directory, text="x").orderBy("n").collect()
    assert [r.code for r in out] == [None, "AAXXX", "BBYYY", None, None, None, "AAXXX", "AAXXX", None, None]


def test_evidence(spark):
    blocks = spark.createDataFrame([("d", "b1", "t", 1, "docx", 2), ("d", "b1", " ", 0, "pdf", None)], "document_id string, block_id string, text string, n_locations int, kind string, page int")
    documents = spark.createDataFrame([("d", 0), ("e", 0), ("f", 1), (None, 1)], "document_id string, n_issues int")
    out = {r.document_id: r.problems for r in evidence.problems(blocks, documents).collect()}
    assert out == {"d": ["duplicate_evidence_id:b1", "empty_evidence_text:b1", "invented_docx_page:b1", "missing_location:b1"], "e": ["empty_reading_without_issue"], "f": [], None: ["missing_document_identity"]}
    titles = _text(spark, ["Sheet 1", "work-sheet", "Packing", "SHEET_1."]).select(evidence.meaningful_title(F.col("x")).alias("m")).collect()
    assert [r.m for r in titles] == [False, False, True, False]
    row, column = evidence.cell_position(F.col("x"))
    assert [tuple(r) for r in _text(spark, ["A1", "AB12", "z300"]).select(row, column).collect()] == [(1, 1), (12, 28), (300, 26)]
    cells = spark.createDataFrame([([f"S!A{k}" for k in range(21)],), (["S!A1"],)], "c array<string>").select(evidence.first_uncertain(F.col("c")).alias("t")).collect()
    assert cells[0].t.endswith("S!A19,...") and cells[1].t == "S!A1"
    sheets = spark.createDataFrame([("Sheet1", 5), ("Cargo", 0), ("Cargo", 2)], "title string, n_cells int")
    assert [tuple(r) for r in evidence.kept_titles(sheets).collect()] == [("Cargo", 2)]


def test_counts(spark):
    assert [r.p for r in spark.createDataFrame([(0,), (25,), (26,)], "n long").select(counts.pages_of(F.col("n"), 25).alias("p")).collect()] == [1, 1, 2]
    found = counts.outcomes(spark.createDataFrame([("accepted",), ("accepted",)], "outcome string"), spark.createDataFrame([("bad.json",)], "file string"))
    assert sorted(map(tuple, found.collect())) == [("accepted", 2), ("failed", 1)]
    files = spark.createDataFrame([(1, "b", "2"), (1, "a", "1"), (1, "a", "1")], "email_id int, filename string, sha256 string")
    assert [tuple(x) for x in counts.stable_attachments(files).first().files] == [("a", "1"), ("b", "2")]
    assert [r.x for r in counts.first_in_order(_text(spark, "cab"), "x", 2).collect()] == ["a", "b"]


def test_functions_that_no_query_reaches(spark):
    paths = _text(spark, ["a/b.txt", "../a", "/etc/x", "C:\\x", "a//b", None]).select("x", safe_path(F.col("x")).alias("s")).collect()
    assert [bool(r.s) for r in paths] == [True, False, False, False, False, False]
    sheets = spark.createDataFrame([("w", 1, 15000, 10), ("w", 2, 20000, 10)], "workbook string, sheet_no int, n_rows int, n_columns int")
    assert [r.rows_read for r in segment.within_budget(sheets).orderBy("sheet_no").collect()] == [15000, 5000]
    rows = spark.createDataFrame([("BL_COMPARISON", "MISMATCH", None, True, ["shipper"]), ("GENERAL", "MISMATCH", None, True, ["shipper"]), ("BL_COMPARISON", "NEEDS_REVIEW", None, False, [])], "c string, s string, r string, h boolean, f array<string>")
    assert [x.bad for x in rows.select(export.incoherent(*(F.col(k) for k in "csrhf")).alias("bad")).collect()] == [False, True, True]
