"""Words of a page become lines without a shuffle of words."""

import pyarrow as pa

from tallymark.operators import layout
from tallymark.plans import proposals


def test_lines_are_whole_whatever_the_batches(spark):
    """A line's words may come in any number of batches; each line is one row."""
    names = ["doc_id", "page", "text", "x0", "x1", "top", "bottom", "font"]
    words = [(1, 0, "a", 0.0, 1.0, 0.0, 2.0, "f"), (1, 0, "b", 1.0, 2.0, 3.0, 5.0, None), (1, 0, "c", 0.0, None, 3.5, 5.0, "f"), (1, 1, "d", 0.0, 1.0, 3.5, 5.0, "f"), (None, 0, "e", 0.0, 1.0, None, 5.0, "f"), (None, 0, "g", 2.0, 1.0, None, 5.0, "f")]
    kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.string()]
    rows = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*words, strict=True), kinds, strict=True)], names=names)
    for size in (1, 2, 3, 7):
        cut = [rows.slice(0, 0), *(rows.slice(k, size) for k in range(0, 6, size)), rows.slice(6, 0)]
        found = [(x["doc_id"], x["page"], x["line"], "".join(w["text"] for w in x["held"])) for b in layout._whole_lines(iter(cut)) for x in b.to_pylist()]
        assert found == [(1, 0, 1, "ab"), (1, 0, 2, "c"), (1, 1, 1, "d"), (None, 0, 1, "eg")]
    assert list(layout._whole_lines(iter([rows.slice(0, 0)]))) == []


def test_only_texts_and_lines_are_shuffled(spark, tmp_path):
    """Words were shuffled twice, one by one and by line; texts of one id make the same pages."""
    texts = [(1, "a b  c"), (1, "z"), (2, " "), (3, None), (None, "q")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = proposals.pdf_blocks(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 2 and plan.rindex("Exchange hash") > plan.rindex("Generate") > plan.index("MapInArrow") > plan.index("Exchange hash")
    assert {(r.doc_id, r.page, r.block, r.x0) for r in out.collect()} == {(1, 0, 1, 0.0), (None, 0, 1, 0.0)}
