"""Steps that must not read, group or search more than once."""

import pyarrow as pa

from tallymark.functions import numbers
from tallymark.llm import packing
from tallymark.operators import layout, segment, selector
from tallymark.plans import queries


def test_lines_of_a_page_go_on_over_batches():
    """A page may come in any number of batches; its state is one line's."""
    tops = [(1, 0, 0.0), (1, 0, 3.0), (1, 0, 3.5), (1, 0, None), (1, 1, 3.5), (None, 0, 1.0), (None, 0, 9.0)]
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*tops, strict=True)], names=["doc_id", "page", "top"])
    for size in (1, 2, 7):
        out = layout._number_lines(rows.slice(k, size) for k in range(0, 7, size))
        assert [n for b in out for n in b.column("line").to_pylist()] == [1, 1, 2, 2, 1, 1, 2]


def test_blocks_are_read_once_for_labels(spark):
    blocks = spark.createDataFrame([(1, 1, "Shipper: A"), (1, 2, "Shipper: B"), (2, 1, "none")], "doc_id long, block long, text string")
    out = selector.select_by_label(blocks)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    found = {(r.doc_id, r.field): (r.status, r.blocks, r.text) for r in out.collect()}
    assert len(found) == 14 and found[1, "shipper"] == ("uncertain", [1, 2], "Shipper: A\nShipper: B") and found[2, "shipper"] == ("missing", [], None)


def test_packing_takes_few_texts_at_a_time(spark, monkeypatch):
    """A batch stands in the executor's memory and in its worker's."""

    def widest(*args):
        def run(batches):
            for b in batches:
                yield packing._rows(0, [(0, 0, 0, 0, b"", b.num_rows, "<u4")])

        return run

    monkeypatch.setattr(packing, "pack_partition", widest)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "'a b' AS text")
    taken = [r.doc_tokens for r in packing.pack_documents(docs, "").collect()]
    assert sum(taken) == 4000 and max(taken) <= 1000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_page_stay_together(spark, tmp_path):
    """Only texts are shuffled, never single words; texts of one id make one page."""
    texts = [(1, "a b  c d e f g h i j k\tl"), (1, "z y"), (2, " "), (3, None), (None, "q")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.ocr_line_confidence(spark, str(tmp_path))
    plan = _plan(out)
    assert plan.index("Generate") < plan.index("Exchange") and plan.count("Exchange hash") == 1
    found = {(r.doc_id, r.line): (r.n, r.confidence) for r in out.collect()}
    assert found == {(1, 0): (12, None), (1, 1): (2, 0.1), (None, 0): (1, None)}


def test_lines_of_a_page_are_runs_of_its_words(spark):
    words = [(7, 2.0, "c", 50), (None, 0.0, "x", 9), (7, 1.0, "b", 80), (9, 0.0, None, 101), (7, 1.0, "a", 0), (8, 0.0, "d", None)]
    pages = spark.createDataFrame([(1, words), (2, []), (3, None), (4, words[:1])], "doc_id long, words array<struct<line:int,x0:double,word:string,conf:int>>")
    found = {(r.doc_id, r.line): (r.text, r.confidence, r.n) for r in segment.ocr_lines(pages).collect()}
    assert found == {(1, None): ("x", 0.09, 1), (1, 7): ("a b c", 0.0, 3), (1, 8): ("d", None, 1), (1, 9): ("", None, 1), (4, 7): ("c", 0.5, 1)}


def test_lines_of_a_paragraph_are_sorted_in_its_row(spark):
    """No window sorts all lines of a task one more time."""
    line = (1, 0, 0, "Shipper: A", 1.0, 2.0, 3.0, 4.0, 90.0)
    lines = spark.createDataFrame([line], "doc_id int, paragraph int, at int, text string, x0 double, top double, x1 double, bottom double, confidence double")
    assert "Window" not in _plan(layout.ocr_blocks(lines))


def test_numbers_are_searched_for_at_digits_alone(spark):
    """Words are no candidates that a second pattern must rule out."""
    texts = ["Supplier#0012", "a1 1,000 1,00 .5 5. 1-2 7_ \u00e97", "9", "x\u20287 mt 8kg\r\n6 T\u00f6 kgs", "no digit", "12 kg 13 KGS", "1,234,567.89MT"]
    blocks = spark.createDataFrame([(k, 0, "native", t) for k, t in enumerate(texts)], "doc int, block int, method string, text string")
    out = numbers.numeric_candidates(blocks, keys=["doc"])
    assert "[\\w.,/-]+" not in _plan(out)
    found = [(r.doc, r.number, r.value, r.start, r.unit, r.unit_start, r.line) for r in out.orderBy("doc", "number").collect()]
    assert found == [(0, 1, "0012", 9, None, None, "Supplier#0012"), (1, 1, "1,000", 3, None, None, texts[1]), (2, 1, "9", 0, None, None, "9"), (3, 1, "7", 2, None, None, "7 mt 8kg"), (3, 2, "6", 12, "kgs", 17, "6 T\u00f6 kgs"), (5, 1, "12", 0, "kg", 3, texts[5]), (5, 2, "13", 6, "kg", 3, texts[5])]
