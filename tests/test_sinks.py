"""Attachments in, predictions and diagnostics out, arrivals once, counts kept up to date."""

import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymark import sources, streaming
from tallymark.operators import intake

DECISION = "case_id int, status string, review_reason string, has_defect boolean, defect_fields array<string>, blocker string"


def _lines(path):
    return [json.loads(line) for f in sorted(Path(path).glob("part-*")) for line in f.read_text().splitlines()]


def test_attachments_of_allowed_kinds_and_sizes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "MOST_BYTES", 20)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, body in {"a.TXT": b"hello", "deep/b.pdf": b"x" * 20, "c.exe": b"no", "d.txt": b"", "e.txt": b"y" * 21, "plain": b"z"}.items():
        (tmp_path / "in" / name).write_bytes(body)
    found = {r.name: (r.suffix, r.length, bytes(r.content)) for r in sources.read_attachments(spark, str(tmp_path / "in")).collect()}
    assert found == {"a.TXT": ("txt", 5, b"hello"), "b.pdf": ("pdf", 20, b"x" * 20)}


def test_predictions_are_written_whole_and_once(spark, tmp_path):
    rows = [(1, "OK", None, False, [], None), (2, "MISMATCH", None, True, ["shipper"], None)]
    good, bad = spark.createDataFrame(rows, DECISION), spark.createDataFrame([*rows, (3, None, None, None, [], "pairing_unresolved")], DECISION)
    with pytest.raises(ValueError, match="can't be exported"):
        sources.write_predictions(bad, str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()
    sources.write_predictions(good, str(tmp_path / "p"))
    assert sorted(r["case_id"] for r in _lines(tmp_path / "p")) == [1, 2]
    with pytest.raises(Exception, match="(?i)exist"):
        sources.write_predictions(good, str(tmp_path / "p"))
    sources.write_diagnostics(bad, str(tmp_path / "d"))
    assert {r["outcome"]: r["count"] for r in _lines(tmp_path / "d")} == {"OK": 1, "MISMATCH": 1, "pairing_unresolved": 1}


def test_predictions_are_of_the_expected_cases(spark, tmp_path):
    rows = spark.createDataFrame([(1, "OK", None, False, [], None), (2, "OK", None, False, [], None)], DECISION)
    ids = lambda *own: spark.createDataFrame([(i,) for i in own], "case_id int")
    for decided, expected in ((rows, ids(1)), (rows, ids(1, 2, 3)), (rows.unionByName(rows.where("case_id = 1")), ids(1, 2))):
        with pytest.raises(ValueError, match="missing, unexpected or repeated"):
            sources.write_predictions(decided, str(tmp_path / "p"), expected=expected)
    sources.write_predictions(rows, str(tmp_path / "p"), expected=ids(2, 1))
    assert len(_lines(tmp_path / "p")) == 2


def test_what_keeps_an_inbox_from_being_taken(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, ident in (("a", "1"), ("b", "1"), ("c", "2"), ("d", "")):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"email_id": ident, "from": "x", "subject": "s", "body": "b", "attachments": []}))
    good, bad = sources.read_emails(spark, str(tmp_path / "in"))
    assert {(r.file, r.reason) for r in sources.inbox_problems(good, bad).collect()} == {("a.json", "repeated_id"), ("b.json", "repeated_id"), ("d.json", "email_id")}
    assert sources.inbox_problems(good.where("email_id = '2'"), bad.limit(0)).collect() == []
    assert [tuple(r) for r in sources.inbox_problems(good.limit(0), bad.limit(0)).collect()] == [(None, "empty_inbox")]


def _feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_repeated_arrivals_count_once_across_restarts(spark, tmp_path):
    schema, at = "digest string, at timestamp", datetime.datetime(2024, 1, 1)
    got: list[str] = []

    def go(*rows):
        _feed(spark, str(tmp_path / "in"), [(d, at + datetime.timedelta(days=n)) for d, n in rows], schema)
        stream = streaming.import_once(streaming.new_files(spark, str(tmp_path / "in"), schema), keys=["digest"], at="at")
        streaming.run_once(stream, str(tmp_path / "ck"), lambda df, _: got.extend(r.digest for r in df.collect()))

    go(("a", 0), ("a", 0), ("b", 1))
    go(("a", 2), ("c", 2))
    assert sorted(got) == ["a", "b", "c"]


def test_live_counts_follow_their_cases(spark, tmp_path):
    schema = "workspace_id int, workflow string"
    held: dict = {}

    def go(*rows):
        _feed(spark, str(tmp_path / "in"), rows, schema)
        stream = streaming.live_counts(streaming.new_files(spark, str(tmp_path / "in"), schema))
        streaming.run_once(stream, str(tmp_path / "ck"), lambda df, _: held.update({(r.workspace_id, r.workflow): r.n for r in df.collect()}), mode="update")

    go((1, "open"), (1, "open"), (2, "open"))
    go((1, "open"), (2, "waiting"))
    assert held == {(1, "open"): 3, (2, "open"): 1, (2, "waiting"): 1}


def test_digests_tell_nulls_and_parts_apart(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", None), (None, "ab"), ("a", "b"), ("", "ab")], "x string, y string")
    found = [r.d for r in rows.select(intake.digest(F.col("x"), F.col("y")).alias("d")).collect()]
    assert found[0] == found[3] and len(set(found)) == 4 and all(len(d) == 64 for d in found)
