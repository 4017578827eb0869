"""Requests about pairs, with bodies of many sizes."""

import hashlib
import json

from pyspark.sql import functions as F

from tallymark.operators import service

BLOCKS = [(c, side, 1, f"Ref AB{1000 + c} é\"", "native", None) for c in range(4) for side in ("SI", "BL")]


def _requests(spark):
    cases = spark.range(4).select(F.col("id").alias("case_id"), F.lit('s "é"').alias("subject"), F.expr("CASE id WHEN 0 THEN repeat('long ', 20000) WHEN 1 THEN NULL ELSE 'b' END").alias("body"), (F.col("id") == 3).alias("blocked"))
    return service.pair_requests(cases, spark.createDataFrame(BLOCKS, "case_id long, role string, block int, text string, method string, ocr double"), "p")


def test_requests_hold_both_parts(spark):
    out = {r.case_id: r for r in _requests(spark).collect()}
    assert sorted(out) == [0, 1, 2]
    assert out[0].request is None and out[0].fingerprint is None and out[0].n_bytes > 100_000
    side = [{"block": 1, "text": 'Ref AB1001 é"', "confidence": 1.0}]
    assert json.loads(out[1].request) == {"subject": 's "é"', "body": None, "si": side, "bl": side, "candidates": ["AB1001"]}
    for c in (1, 2):
        assert out[c].n_bytes == len(out[c].request.encode())
        assert out[c].fingerprint == hashlib.sha256(("p\n" + out[c].request).encode()).hexdigest()


def test_bodies_are_not_broadcast(spark):
    assert "Broadcast" not in _requests(spark)._jdf.queryExecution().executedPlan().toString()
