"""Labels at the start of lines, found without a pattern where they can be."""

import itertools

from pyspark.sql import functions as F

from tallymark.functions import labels as L
from tallymark.functions import values
from tallymark.operators import segment, selector

_OLD_BREAKS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_label_begins_like_one_of_another_field():
    assert not [(x, y) for f, g in itertools.permutations(L.FIELDS, 2) for x in L.LABELS[f] for y in L.LABELS[g] if y.startswith(x)]


def test_fields_of_lines_are_those_of_their_patterns(spark):
    labels = [x for own in L.LABELS.values() for x in own] + ["colon", "", "\u0130", "shi\u017fper", "notify\u212a"]
    texts = [a + b + c + d for a, b, c, d in itertools.product(["", " ", "\u3000", "x"], [x for k in labels for x in (k, k.upper())], ["", ":", " : ", " (a) =", " ", "|"], ["", " ", "\u2003", "a: b"])]
    rows = spark.createDataFrame([(x,) for x in texts] + [(None,)], "text string").repartition(4)
    old = F.array_compact(F.array(*(F.when(values.strip(F.col("text")).rlike(L.leading(f)), f) for f in L.FIELDS)))
    found = rows.select("text", old.alias("a"), F.array_compact(F.array(values.field_of(F.col("text")))).alias("b"))
    assert found.where("not a <=> b").collect() == [] and found.where("size(a) > 0").count() > 500


def test_lines_are_split_as_the_patterns_split_them(spark):
    texts = ["".join(x) for n in range(5) for x in itertools.product("a\n\r\x0b\u2028", repeat=n)] + ["a\x1cb\x1d\x1e\x85\x0c\u2029\x1f\n"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    t = F.col("text")
    found = rows.select(F.split(t, _OLD_BREAKS, -1).alias("a"), segment.split_lines(t).alias("b"), F.split(t, "\r\n|[\r\n]").alias("c"), values.lines_of(t).alias("d"))
    assert found.where("a <> b or c <> d").collect() == []
    assert _OLD_BREAKS not in _plan(segment.text_blocks(spark.createDataFrame([(1, "a")], "doc_id long, text string")))


def test_blocks_of_a_document_meet_before_their_texts_cross(spark):
    """One row a document crosses, and with blocks that lie together nothing is shuffled one more time."""
    texts = [(1, "Shipper: A\rPOL: x\n\nEXPORTER b"), (2, "none"), (3, None), (None, "Consignee\uff1a c")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    out = selector.select_by_label(segment.text_blocks(frame))
    assert _plan(out).count("Exchange") == 1
    found = {(r.doc_id, r.field): (r.status, r.blocks, r.text) for r in out.where("status <> 'missing'").collect()}
    assert found == {(1, "shipper"): ("uncertain", [1, 3], "Shipper: A\nEXPORTER b"), (1, "port_of_loading"): ("present", [2], "POL: x"), (None, "consignee"): ("present", [1], "Consignee\uff1a c")}
