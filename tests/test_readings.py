"""Readings that are taken once, whatever number of rows or figures rests on them."""

from pyspark.sql import functions as F

from tallymark.operators import compare
from tallymark.plans import queries

SF = "/root/testdata/sf0.001"


def test_equal_texts_are_read_once(spark, monkeypatch):
    """Only distinct texts come to be read; every row has its reading, rows without field or text too."""
    taken, read = [], compare._read
    monkeypatch.setattr(compare, "_read", lambda texts: taken.append(texts.count()) or read(texts))
    rows = [(k, role, f, t) for k in range(50) for role in ("SI", "BL") for f, t in (("shipper", "Shipper: A"), ("consignee", "Shipper: A"), ("shipper", None), (None, "x"))]
    out = compare.read_values(spark.createDataFrame(rows, "case_id long, role string, field string, text string")).collect()
    assert taken == [4] and len(out) == len(rows)
    alone = {(r.field, r.text): (r.normalized, r.issue) for r in read(spark.createDataFrame([x[2:] for x in rows[:4]], "field string, text string")).collect()}
    assert {(r.field, r.text): (r.normalized, r.issue) for r in out} == alone and alone["shipper", "Shipper: A"] == ("a", None)


def test_findings_of_a_case_are_made_once(spark):
    """Mismatches and issues come from one pass; the findings were made for each before."""
    plan = queries._decided(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_second_readings_have_no_value(spark):
    rows = [(1, "SI", "shipper", "a", None), (1, "BL", "shipper", "a", None), (1, "BL", "shipper", "b", None), (1, "SI", "consignee", "c", None), (1, "BL", "consignee", "c", None)]
    out = compare.findings(spark.createDataFrame(rows, "case_id long, role string, field string, normalized string, issue string"))
    found = {r.field: (r.si_value, r.bl_value, r.bl_issue, r.outcome) for r in out.where(F.col("field").isin("shipper", "consignee", "notify_party")).collect()}
    assert found == {"shipper": ("a", None, "ambiguous_reading", "unresolved"), "consignee": ("c", "c", None, "match"), "notify_party": (None, None, None, "unresolved")}
