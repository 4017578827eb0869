"""Whole proofs of pairs: identifiers, order references of sheets, further identifiers, a person's choice."""

import pytest

from tallymark.operators import export, issues, references
from tallymark.operators.regions import LOCATION

BLOCK = f"doc_id string, text string, method string, locations array<{LOCATION}>, readable boolean"


def _cell(sheet, name, kind="xlsx"):
    return {"kind": kind, "page": None, "x0": None, "top": None, "x1": None, "bottom": None, "sheet": sheet, "cell": name}


def sheet(doc, role, order="700123", *, drop=None, texts=None, method="native", name=None, readable=True, extra=()):
    own, heading = references.SHEETS[role]
    said = {3: f"{heading}: {order}", 13: "HS CODE: 84", 15: "FREIGHT: PREPAID"} | (texts or {})
    rows = [(doc, said.get(r, f"LINE: {r}"), method, [_cell(name or own, f"A{r}"), _cell(name or own, f"B{r}")], readable) for r in range(3, 16) if r != drop]
    return rows + [(doc, t, "native", [_cell(own, c) for c in cells], readable) for t, cells in extra]


def prose(doc, *texts):
    return [(doc, t, "native", [_cell(None, None, "pdf")], True) for t in texts]


def _proof(spark, si, bl, human=False):
    pairs = spark.createDataFrame([(1, si[0][0], bl[0][0], human)], "case_id int, si_id string, bl_id string, human_selected boolean")
    r = references.pair_proofs(pairs, spark.createDataFrame(si + (bl if bl is not si else []), BLOCK)).first()
    return r.conflict, r.shared, r.valid


def test_sheets_with_one_order_prove_a_pair(spark):
    assert _proof(spark, sheet("s", "SI"), sheet("b", "BL")) == (False, True, True)
    assert _proof(spark, sheet("s", "SI"), sheet("b", "BL", "700124"), human=True) == (True, False, False)


@pytest.mark.parametrize("fault", [{"drop": 9}, {"texts": {13: "HS CODE: x"}}, {"texts": {15: "FREIGHT: COLLECT"}}, {"order": "12345"}, {"order": "7001234 "}, {"method": "ocr"}, {"name": "Other"}, {"readable": False}, {"extra": [("again", ["A5", "B5"])]}, {"texts": {3: "BOOKING: 700123"}}])
def test_what_is_not_the_template_proves_nothing(spark, fault):
    si = sheet("s", "SI", **fault)
    assert _proof(spark, si, sheet("b", "BL")) == (False, False, False)
    assert _proof(spark, si, sheet("b", "BL"), human=True) == (False, False, True)


def test_more_cells_do_no_harm(spark):
    assert _proof(spark, sheet("s", "SI", extra=[("TOTAL: 4", ["A16", "B16"]), ("alone", ["C3"])]), sheet("b", "BL"))[2]


def test_identifiers_and_persons(spark):
    assert _proof(spark, prose("s", "Booking No. BK-77001"), prose("b", "x", "Booking Ref: BK-77001")) == (False, True, True)
    assert _proof(spark, prose("s", "Booking No. BK-77001"), prose("b", "Booking Ref: BK-77002"), human=True) == (True, False, False)
    assert _proof(spark, prose("s", "nothing"), prose("b", "nothing")) == (False, False, False)
    assert _proof(spark, prose("s", "nothing"), prose("b", "nothing"), human=True) == (False, False, True)
    one = prose("s", "Booking No. BK-77001")
    assert _proof(spark, one, one, human=True) == (True, True, False)


@pytest.mark.parametrize(("si", "bl", "conflict"), [("B/LNo.: QX4410", "B/LNo.: QX4411", True), ("B/L No. QX4410", "Bill of Lading number = QX4410", False), ("B/L number QX4410", "bill of lading QX9", False), ("Order QX4410 order QX4411", "Order no. QX4410", True), ("Order QX4410", "BL instruction QX4411", False)])
def test_further_identifiers_refute(spark, si, bl, conflict):
    shared = "Booking No. BK-77001"
    assert _proof(spark, prose("s", shared, si), prose("b", shared, bl)) == (conflict, True, not conflict)


def test_exports_say_why_a_report_is_missing(spark):
    papers = {1: [], 2: [("SI", True)], 3: [("SI", True), ("BL", False)], 4: [("SI", True), ("SI", True)], 5: [("SI", True), ("BL", True)]}
    rows = [(c, f"{c}{k}", role, False, True, 3 if good else 0, 0) for c, own in papers.items() for k, (role, good) in enumerate(own)]
    attachments = spark.createDataFrame(rows, "case_id int, attachment_id string, role string, superseded boolean, has_evidence boolean, n_blocks int, n_issues int")
    cases = spark.createDataFrame([(c,) for c in papers], "case_id int").join(issues.roles(attachments), "case_id", "left")
    cases = cases.withColumn("no_report_reason", issues.reason_without_report(cases)).selectExpr("case_id", "no_report_reason", "'BL_COMPARISON' accepted", "'completed' processing", "false report_present", "false report_current", "false pair_valid", "false complete", "array() mismatches", "array() unresolved", "array() issues")
    out = {r.case_id: (r.review_reason, r.blocker) for r in export.decide(cases).collect()}
    assert out == {1: ("missing_attachment", None), 2: ("missing_attachment", None), 3: ("unreadable", None), 4: ("wrong_doc_type", None), 5: (None, "comparison_missing")}
