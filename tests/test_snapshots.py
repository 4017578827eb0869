"""Snapshots by id and sets of artifacts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallymark.sources import snapshots


def test_snapshots_are_read_by_id(spark, tmp_path):
    files = {"a": {"m1": {"status": "OK", "n": [1, 2]}, "m2": {"status": None}, "m3": "text"}, "b": {"m4": {}, "m2": {"status": "late"}}}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "c.json").write_text("[1, 2]")
    (tmp_path / "d.json").write_text(" ")
    good, bad = snapshots.read_snapshot(spark, str(tmp_path / "*.json"))
    assert {r.source_id: json.loads(r.case) for r in good.collect()} == {"m1": files["a"]["m1"], "m4": {}}
    found = {(r.file, r.source_id, r.problem) for r in bad.collect()}
    assert found == {("a.json", "m3", "no_object"), ("a.json", "m2", "repeated_id"), ("b.json", "m2", "repeated_id"), ("c.json", None, "no_object"), ("d.json", None, "no_object")}


def test_artifacts_appear_together(spark, tmp_path):
    rows = spark.createDataFrame([("m1", 1), ("m2", 2)], "id string, n int")
    path = str(tmp_path / "report")
    snapshots.publish({"truth": rows, "scores": rows.where("n = 1")}, path)
    assert sorted(tuple(r) for r in snapshots.artifact(spark, path, "truth", "id string, n int").collect()) == [("m1", 1), ("m2", 2)]
    assert snapshots.artifact(spark, path, "scores", "id string, n int").count() == 1
    with pytest.raises(FileExistsError):
        snapshots.publish({"truth": rows}, path)
    other = str(tmp_path / "half")
    with pytest.raises(Exception, match="stop"):
        snapshots.publish({"truth": rows, "scores": rows.select(F.raise_error(F.lit("stop")).alias("x"))}, other)
    assert sorted(os.listdir(tmp_path)) == ["report"]
    with pytest.raises(ValueError, match="nothing"):
        snapshots.publish({}, other)
