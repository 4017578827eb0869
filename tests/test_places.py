"""OCR blocks, bound numbers, refreshed flags and kept stage results."""

import random

from pyspark.sql import functions as F

from tallymark import streaming
from tallymark.operators import bindings, layout
from tallymark.sources import stages
from tallymark.streaming import refresh


def test_ocr_blocks_against_a_loop(spark):
    rng = random.Random(2)
    labels = ("Shipper: A", "Port of Loading X", "booking", "GROSS WEIGHT (KG) 5")
    rows = [(d, p, rng.randrange(3), rng.choice([*labels, "plain", "more text", "Shipper", ""]), float(rng.randrange(50)), float(k * 7 + rng.randrange(30)), 90.0, 200.0 + k, rng.choice([None, 50.0, 90.0, 100.0, 120.0, 70.0])) for d in range(30) for p in range(2) for k in range(rng.randrange(8))]
    frame = spark.createDataFrame(rows, "doc_id int, paragraph int, at int, text string, x0 double, top double, x1 double, bottom double, confidence double")
    expected = {}
    for d in range(30):
        for p in range(2):
            n = 0
            for k, r in enumerate(sorted((r for r in rows if r[:2] == (d, p)), key=lambda r: (r[2], r[5], r[4], r[3]))):
                n += k == 0 or r[3] in labels
                text, boxes, conf = expected.setdefault((d, p, n), ([], [], []))
                text.append(r[3])
                boxes.append(tuple(x / 2 for x in r[4:8]))
                conf.append(r[8])
    got = {(r.doc_id, r.paragraph, r.block): (r.text, [tuple(b) for b in r.boxes], r.confidence, (r.x0, r.top, r.x1, r.bottom)) for r in layout.ocr_blocks(frame, scale=2).collect()}
    for key, (text, boxes, conf) in expected.items():
        around = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
        least = None if any(c is None or c > 100 for c in conf) else min(conf) / 100
        assert got[key] == ("\n".join(text), boxes, least, around)
    assert len(got) == len(expected)


def _bound(spark, text, *pick, method="native", kinds=("pdf",), field="gross_weight_kg"):
    blocks = spark.createDataFrame([(1, 1, method, text, list(kinds))], "doc_id int, block int, method string, text string, kinds array<string>")
    picks = spark.createDataFrame([(1, field, 1, *pick)], "doc_id int, field string, block int, start int, end int, unit_start int, confidence double")
    r = bindings.bind_numbers(blocks, picks).first()
    return r.value, r.normalized, r.unit_source, r.issue, r.error


def test_bound_numbers(spark):
    assert _bound(spark, "net 1,200.50 MT", 4, 12, 13, 0.9) == ("1,200.50", "1200500", "explicit", None, None)
    assert _bound(spark, "net 1,200.50 MT", 4, 12, 13, None) == ("1,200.50", "1200500", "explicit", "low_field_confidence", None)
    assert _bound(spark, "net 1,200.50 MT", 4, 12, None, 0.9)[4] == "not_the_span"
    assert _bound(spark, "net 1,200.50 MT", 4, 9, 13, 0.9)[4] == "not_the_span"
    assert _bound(spark, "12 and 13 kg", 0, 9, 10, 0.9)[4] == "several_numbers"
    assert _bound(spark, "12 and 13 kg", 3, 6, 10, 0.9)[4] == "no_number"
    assert _bound(spark, "total 500", 6, 9, None, 0.9) == ("500", None, None, "missing_value", None)
    assert _bound(spark, "total 500", 6, 9, None, 0.9, field="container_count") == ("500", "500", None, None, None)
    assert _bound(spark, "total 500", 6, 9, None, 0.9, field="shipper")[4] == "not_numeric"
    assert _bound(spark, "total 500", 6, 9, None, 0.9, kinds=("pdf", "image"))[4] == _bound(spark, "total 500", 6, 9, None, 0.9, kinds=())[4] == "not_a_pdf"
    assert _bound(spark, "total 500", 6, 9, None, 0.9, method="ocr")[4] == "no_number"


def test_what_can_be_repaired(spark):
    rows = [("container_count", "missing_value", "machine", 0.8, True), ("shipper", "missing_value", "machine", 0.9, True), ("container_count", "low_field_confidence", "machine", 0.9, True), ("container_count", "missing_value", "human_verified", 0.9, True), ("gross_weight_kg", "source_field_mismatch", "machine", 0.79, True), ("gross_weight_kg", "source_field_mismatch", "machine", None, True), ("gross_weight_kg", "ambiguous_source_fields", "machine", 0.9, False), ("gross_weight_kg", None, "machine", float("nan"), True)]
    frame = spark.createDataFrame(rows, "field string, issue string, provenance string, confidence double, pdf boolean")
    assert [r.x for r in frame.select(bindings.can_repair(*(F.col(c) for c in frame.columns)).alias("x")).collect()] == [True] + [False] * 7
    blocks = spark.createDataFrame([(1, "native", ["pdf"]), (1, "native", ["pdf", "pdf"]), (2, "native", ["pdf"]), (2, "ocr", ["pdf"]), (3, "native", []), (4, "native", None)], "doc_id int, method string, kinds array<string>")
    assert {r.doc_id: r.native_pdf for r in bindings.native_pdfs(blocks).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_refresh_of_touched_cases(spark, tmp_path):
    """A replayed batch changes nothing; a full rebuild gives the same; only touched cases are computed."""
    log, path = str(tmp_path / "log"), str(tmp_path / "kept")
    computed: list[int] = []

    def compute(touched):
        computed.append(touched.count())
        rows = spark.read.schema("case_id long, n long").parquet(log).join(touched, "case_id", "left_semi")
        return rows.groupBy("case_id").agg(F.sum("n").alias("total"), (F.max("n") > 5).alias("large"))

    summary = lambda rows: rows.agg(F.count("*").alias("cases"), F.count_if("large").alias("large"))
    write = refresh.refresher(path, ["case_id"], compute, summary=summary)
    for rows in ([(1, 2), (2, 3), (3, 9)], [(2, 7), (4, 1)]):
        spark.createDataFrame(rows, "case_id long, n long").coalesce(1).write.mode("append").parquet(log)
        streaming.run_once(streaming.new_files(spark, log, "case_id long, n long"), str(tmp_path / "ck"), write)
    state = lambda: sorted(tuple(r) for r in refresh.current(spark, path, ["case_id"]).collect())
    expected = [(1, 2, False), (2, 10, True), (3, 9, True), (4, 1, False)]
    assert state() == expected and computed == [3, 2]
    write(spark.createDataFrame([(2, 7), (4, 1)], "case_id long, n long"), 1)
    assert state() == expected
    assert [tuple(refresh.snapshot(spark, path, k).first()) for k in (0, 1)] == [(3, 1), (4, 2)] and refresh.snapshot(spark, path, 2) is None
    whole = compute(spark.read.parquet(log).select("case_id").distinct())
    assert refresh.differing(refresh.current(spark, path, ["case_id"]), whole, ["case_id"]).collect() == []
    other = whole.where("case_id > 1").withColumn("total", F.when(F.col("case_id") == 4, None).otherwise(F.col("total")))
    assert {r.case_id: r.change for r in refresh.differing(refresh.current(spark, path, ["case_id"]), other, ["case_id"]).collect()} == {1: "removed", 4: "changed"}
    refresh.compact(spark, path, ["case_id"], str(tmp_path / "compacted"))
    refresh.refresher(str(tmp_path / "compacted"), ["case_id"], compute)(spark.createDataFrame([(4,)], "case_id long"), 2)
    assert sorted(tuple(r) for r in refresh.current(spark, str(tmp_path / "compacted"), ["case_id"]).collect()) == expected


def test_stages_are_computed_once_for_each_content(spark, tmp_path):
    path, reached = str(tmp_path / "stages"), []
    inputs = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "content string, n int")

    def compute(rows):
        reached.append(sorted(r.n for r in rows.collect()))
        return rows.select("content", (F.col("n") * 10).alias("value"))

    def run(rows, stage, profile):
        reached.clear()
        out = sorted(((r.content or "", r.value) for r in stages.run_stage(rows, path, stage, profile, "value int", compute).collect()))
        return out, sorted(n for own in reached for n in own)

    assert run(inputs, "read", "p1") == ([("", 30), ("a", 10), ("b", 20)], [1, 2, 3])
    assert run(inputs, "read", "p1") == ([("", 30), ("a", 10), ("b", 20)], [3])
    more = inputs.unionByName(spark.createDataFrame([("c", 4)], "content string, n int"))
    assert run(more, "read", "p1")[1] == [3, 4]
    assert run(more, "read", "p2")[1] == [1, 2, 3, 4]  # a changed threshold computes its stage again
    assert run(more, "read", "p1")[1] == run(more, "read", "p2")[1] == [3]
    stages.keep(spark.createDataFrame([("a", 10)], "content string, value int"), path, "read", "p1")  # a second attempt
    assert run(more, "read", "p1")[0] == [("", 30), ("a", 10), ("b", 20), ("c", 40)]
    plan = stages.kept(spark, path, "read", "p1", "value int")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(stage" in plan and "profile" in plan.split("PartitionFilters")[1]
