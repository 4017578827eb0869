"""Rule tables: input -> expected."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions import labels as L
from tallymark.functions.values import decimal_text
from tallymark.operators import cases, compare, export, operations, references, segment

VALUES = [
    ("container_count", "No. of Containers: 3 x 40'HC", "3"),
    ("container_count", "No. of Containers or Packages: 12 x 20'FCL", "12"),
    ("container_count", "No. of Containers or Packages: 12", None),
    ("container_count", "Container Count: 1 container", "1"),
    ("container_count", "Container Count: 0 containers", "0"),
    ("container_count", "Container Count: 1.5", None),
    ("container_count", "Container Count: -", None),
    ("gross_weight_kg", "Gross Weight (KG): 3,420 KG", "3420"),
    ("gross_weight_kg", "Gross Weight毛重(KGS): 51,204 KG", "51204"),
    ("gross_weight_kg", "Gross Wt (MT): 2.75 MT", "2750"),
    ("gross_weight_kg", "Gross Weight: 190277", "190277"),
    ("gross_weight_kg", "Gross Weight: 10 pounds", "4.5359237"),
    ("gross_weight_kg", "Gross Weight: 6,078.90", "6078.9"),
    ("gross_weight_kg", "Gross Weight (LBS): 10000", "4535.9237"),
    ("gross_weight_kg", "Gross Weight: 1000 g", "1"),
    ("gross_weight_kg", "Gross Weight (KG): 10 lbs", None),
    ("gross_weight_kg", "Gross Weight (oz): 10", None),
    ("gross_weight_kg", "Gross Weight: 10 tons", None),
    ("gross_weight_kg", "Gross Weight: 10 containers", None),
    ("gross_weight_kg", "Gross Weight: 10 / 20", None),
    ("gross_weight_kg", "Gross Weight: not provided", None),
    ("shipper", "Shipper Quill & Rope Goods", "quill & rope goods"),
    ("shipper", "Shipperly Freight", "shipperly freight"),
    ("shipper", "Shipper | Quill & Rope Goods\n4 Tannery Lane", "quill & rope goods 4 tannery lane"),
    ("consignee", "To the Order of (收货人) | Oakmoor BV", "oakmoor bv"),
    ("notify_party", "Notify Party/Intermediate Consignee (通知人) | Bellwether KG", "bellwether kg"),
    ("port_of_loading", "Portof Loading Valparaiso", "valparaiso"),
    ("port_of_loading", "Port of Loading: TBA", None),
    ("port_of_discharge", "Port of Call: Kobe", None),
    ("shipper", None, None),
]


def test_values(spark):
    rows = spark.createDataFrame([(k, "SI", f, t) for k, (f, t, _) in enumerate(VALUES)], "case_id int, role string, field string, text string")
    found = {r.case_id: r.normalized for r in compare.read_values(rows).collect()}
    wrong = [(VALUES[k], found[k]) for k in range(len(VALUES)) if found[k] != VALUES[k][2]]
    assert not wrong


@pytest.mark.parametrize(("field", "text", "issue"), [("shipper", "Consignee: A", "source_field_mismatch"), ("notify_party", "Notify Party: A Consignee: B", "ambiguous_source_fields"), ("notify_party", "Notify Party/Intermediate Consignee: A", None), ("shipper", "Acme", None)])
def test_source_issue(spark, field, text, issue):
    rows = spark.createDataFrame([(1, "SI", field, text)], "case_id int, role string, field string, text string")
    assert compare.read_values(rows).first().issue == issue


@pytest.mark.parametrize(("right", "outcome"), [("10000", "match"), ("10001", "mismatch"), ("10 MT", "match"), ("10000 lb", "mismatch"), ("N/A", "unresolved"), ("Gross Weight (kg): 10 lb", "unresolved")])
def test_weight_verdicts(spark, right, outcome):
    rows = spark.createDataFrame([(1, "SI", "gross_weight_kg", "10000"), (1, "BL", "gross_weight_kg", right)], "case_id int, role string, field string, text string")
    found = compare.findings(compare.read_values(rows))
    assert found.count() == 7
    assert found.where("field = 'gross_weight_kg'").first().outcome == outcome


def test_decimal_text(spark):
    rows = spark.sql("SELECT inline(array(struct(cast('100.000' as decimal(20,6)) a), struct(cast('0' as decimal(20,6)) a), struct(cast('1.50' as decimal(20,6)) a)))")
    assert [r.d for r in rows.select(decimal_text(F.col("a")).alias("d")).collect()] == ["100", "0", "1.5"]


def test_ports(spark):
    names = spark.createDataFrame([("Valparaiso", "CLVAP"), ("Newport", "GBNPT"), ("Newport", "USNPT"), ("Brill", "NLQRS")], "alias string, code string")
    codes = spark.createDataFrame([("CLVAP",), ("GBNPT",), ("USNPT",), ("CNQDO",), ("BRILL",)], "code string")
    expected = {"Valparaiso": "CLVAP", "Valparaiso (CLVAP)": "CLVAP", "Valparaiso (CNQDO)": None, "CNQDO": "CNQDO", "Newport": None, "BRILL": None, "TBA": None}
    rows = spark.createDataFrame([(x,) for x in expected], "normalized string")
    assert {r.normalized: r.code for r in references.resolve_ports(rows, names, codes).collect()} == expected


@pytest.mark.parametrize(
    ("si", "bl", "valid"),
    [
        ("Booking Ref: LIKE-5070", "Booking No. LIKE-5070", True),
        ("Shipment ID: SHIP-4040\nBooking: BK-80806", "Shipment ID: SHIP-5050\nBooking: BK-80806", False),
        ("Booking Ref: LIKE-5070", "OC No.: LIKE-5070", False),
        ("Rebooking No. BK-80806", "Booking No. BK-80806", False),
        (None, "", False),
    ],
)
def test_pairs(spark, si, bl, valid):
    rows = spark.createDataFrame([(1, "SI", si), (1, "BL", bl)], "case_id int, role string, text string")
    assert references.pair_validity(rows).first().valid is valid


def test_text_blocks(spark):
    lines = ["SHIPPING INSTRUCTION", "====", "Shipper: Quill", "  4 Tannery Lane", "  Gate 7: rear", "Consignee (Non-Negotiable): Oakmoor BV", "  Harbour Works", "Notify Party: Same as consignee", "Berth Window: keep with it", "  continued value"]
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id int, text string")
    found = segment.text_blocks(rows).orderBy("block").collect()
    assert [r.line_start for r in found] == [1, 3, 6, 8, 9]


def test_choice_errors(spark):
    choices = [("A", 0.9, {"A": 0.9, "B": 0.1}), ("B", 0.9, {"A": 0.9, "B": 0.1}), ("A", 0.9, {"A": 0.5, "B": 0.1}), ("A", float("nan"), {"A": 0.9, "B": 0.1}), ("A", 0.9, {"A": 1.0})]
    rows = spark.createDataFrame(choices, "s string, c double, p map<string, double>")
    error = cases.distribution_error(F.col("s"), F.col("c"), F.col("p"), F.array(F.lit("A"), F.lit("B")))
    assert [r.e for r in rows.select(error.alias("e")).collect()] == [None, "not_largest", "sum", "range", "keys"]


def _case(**more):
    base = {"case_id": 1, "accepted": "BL_COMPARISON", "suggested": "BL_COMPARISON", "source": "model", "processing": "completed", "report_present": True, "report_current": True, "pair_valid": True, "complete": True, "mismatches": [], "unresolved": [], "issues": [], "blocking": [], "unused_warnings": [], "review_reasons": [], "n_attachments": 2}
    return base | more


_SCHEMA = "case_id int, accepted string, suggested string, source string, processing string, report_present boolean, report_current boolean, pair_valid boolean, complete boolean, mismatches array<string>, unresolved array<string>, issues array<string>, blocking array<string>, unused_warnings array<string>, review_reasons array<string>, n_attachments int"


@pytest.mark.parametrize(
    ("more", "kind"),
    [({}, "match"), ({"unresolved": ["shipper"]}, "needs_review"), ({"unresolved": ["shipper"], "mismatches": ["consignee"]}, "mismatch_review"), ({"mismatches": ["consignee"]}, "mismatch"), ({"report_current": False}, "needs_review"), ({"complete": False}, "needs_review"), ({"pair_valid": False}, "needs_review"), ({"blocking": ["x"]}, "needs_review"), ({"accepted": None}, "needs_review"), ({"accepted": "SPAM"}, "spam"), ({"accepted": None, "suggested": "SPAM"}, "suspected_spam"), ({"processing": "running"}, "running"), ({"accepted": "GENERAL"}, "categorized")],
)
def test_summary(spark, more, kind):
    out = cases.assess(spark.createDataFrame([_case(**more)], _SCHEMA))
    assert out.select(cases.summary_kind(out).alias("k")).first().k == kind


@pytest.mark.parametrize(
    ("more", "expected"),
    [
        ({"accepted": "GENERAL"}, ("OK", None, None)),
        ({"mismatches": ["consignee", "gross_weight_kg"]}, ("MISMATCH", None, None)),
        ({"report_present": False, "n_attachments": 0}, ("NEEDS_REVIEW", "missing_attachment", None)),
        ({"unresolved": ["gross_weight_kg"], "issues": ["missing_value"]}, ("NEEDS_REVIEW", "missing_value", None)),
        ({"mismatches": ["consignee"], "unresolved": ["gross_weight_kg"], "issues": ["missing_value"]}, ("NEEDS_REVIEW", "missing_value", None)),
        ({"mismatches": ["consignee"], "unresolved": ["shipper"], "issues": ["low_field_confidence"]}, ("MISMATCH", None, None)),
        ({"mismatches": ["consignee"], "unresolved": ["shipper"], "issues": ["low_ocr_confidence"]}, ("MISMATCH", None, None)),
        ({"mismatches": ["consignee"], "unresolved": ["shipper"], "issues": ["ambiguous_source_fields"]}, (None, None, "mixed_outcomes_unrepresentable")),
        ({"unresolved": ["shipper"], "issues": ["low_ocr_confidence"]}, ("NEEDS_REVIEW", "unreadable", None)),
        ({"unresolved": ["shipper"], "issues": ["low_field_confidence"]}, (None, None, "review_reason_unrepresentable")),
        ({"report_current": False}, (None, None, "comparison_missing")),
        ({"pair_valid": False}, (None, None, "pairing_unresolved")),
        ({"complete": False}, (None, None, "report_incomplete")),
        ({"processing": "running"}, (None, None, "processing_incomplete")),
    ],
)
def test_export(spark, more, expected):
    r = export.decide(spark.createDataFrame([_case(**more)], _SCHEMA)).first()
    assert (r.status, r.review_reason, r.blocker) == expected


def test_published_scores(spark):
    one = spark.range(1).select(export.final_score(F.lit(0.9875069399594366), F.lit(1.0), F.lit(1.0)).alias("s"), export.f1(F.lit(18), F.lit(91), F.lit(2)).alias("f"))
    r = one.first()
    assert abs(r.s - 0.996252081987831) < 1e-12 and abs(r.f - 0.2790697674) < 1e-9


def test_costs(spark):
    one = spark.range(1).select(operations.cost(F.lit(59061), F.lit(0), F.lit("0.042").cast("decimal(18,6)"), F.lit("0").cast("decimal(18,6)")).alias("a"), operations.cost(F.lit(100), F.lit(20), F.lit("0.30").cast("decimal(18,6)"), F.lit("1.20").cast("decimal(18,6)")).alias("b"))
    assert tuple(one.first()) == (2481, 54)


def test_labels_longest_first():
    assert L.alternatives(("a", "abc", "ab")).split("|") == ["abc", "ab", "a"]
