"""Actions and results folded into cases: each rule, the stream against its batch twin, and what corrections change."""

import pandas as pd
import pytest

from tallymark import streaming
from tallymark.operators import compare, reviews

DOCS = ["si", "bl", "x"]


def _log(*events):
    """Events of case 1 in order; the first opens it."""
    rows = []
    for seq, e in enumerate(events):
        rows.append(tuple({"case_id": 1, "seq": seq, **e}.get(name) for name in reviews.EVENT_NAMES))
    return rows


def _run(spark, *events):
    out = reviews.replay(spark.createDataFrame(_log(*events), reviews.EVENT)).toPandas().sort_values("seq")
    return [{k: None if pd.api.types.is_scalar(v) and pd.isna(v) else v for k, v in r.items()} for r in out.to_dict("records")]


def opened(**more):
    return {"kind": "created", "value": "BL_COMPARISON", "normalized": "BL_COMPARISON", "si_id": "si", "bl_id": "bl", "documents": DOCS, "pair_valid": True} | more


def done(**more):
    return {"kind": "published", "value": "BL_COMPARISON", "normalized": "BL_COMPARISON", "pair_valid": True} | more


def fix(**more):
    return {"kind": "correct", "document_id": "si", "field": "shipper", "normalized": "new", "fingerprint": "f", "sources": 1, "ocr": False, "verified": False, "transcribed": False, "reason": "seen"} | more


def test_each_action_sets_its_values(spark):
    a = _run(spark, opened(), {"kind": "assign", "value": "Ana"}, {"kind": "workflow", "value": "waiting"}, {"kind": "retry"}, {"kind": "published", "run": 2, "result_revision": 1, "value": "GENERAL", "normalized": "GENERAL", "pair_valid": True})
    assert [r["outcome"] for r in a] == ["applied"] * 5
    assert a[1]["assignee"] == "Ana" and a[2]["workflow"] == "waiting" and a[3]["stage"] == "retry_requested" and a[3]["run"] == 2
    last = a[4]
    assert (last["assignee"], last["workflow"], last["accepted"], last["processing"], last["revision"], last["input_revision"]) == ("Ana", "waiting", "GENERAL", "completed", 5, 1)


def test_a_persons_category_wins(spark):
    a = _run(spark, opened(), {"kind": "category", "value": "GENERAL"}, {"kind": "classified", "run": 1, "value": "SPAM", "normalized": "SPAM"}, {"kind": "published", "run": 1, "value": "SPAM", "normalized": "SPAM"})
    assert [(r["accepted"], r["source"]) for r in a[1:]] == [("GENERAL", "human")] * 3
    assert a[1]["report_revision"] is None and a[1]["stage"] == "category_changed" and a[2]["stage"] == "classified"


def test_late_results_are_superseded(spark):
    a = _run(spark, opened(), {"kind": "category", "value": "BL_COMPARISON"}, {"kind": "published", "run": 1, "pair_valid": True}, {"kind": "published", "run": 2, "result_revision": 1, "pair_valid": True}, {"kind": "published", "run": 2, "result_revision": 2, "pair_valid": True})
    assert [r["outcome"] for r in a] == ["applied", "applied", "superseded", "superseded", "applied"]
    assert a[3]["revision"] == a[1]["revision"] and a[3]["report_revision"] is None and a[4]["report_revision"] == 2


def test_stale_actions_change_nothing(spark):
    a = _run(spark, opened(), {"kind": "assign", "value": "Ana", "expected_revision": 1}, fix(expected_revision=1), fix(expected_revision=2))
    assert [r["outcome"] for r in a] == ["applied", "applied", "conflict", "applied"]
    own = [k for k in reviews.OUTCOME_NAMES if k not in ("seq", "kind", "outcome")]
    assert {k: a[1][k] for k in own} == {k: a[2][k] for k in own}


@pytest.mark.parametrize(
    ("event", "error"),
    [
        ({"kind": "assign"}, "unknown_reviewer"), ({"kind": "workflow", "value": "lost"}, "unknown_workflow"), ({"kind": "other"}, "unknown_kind"), ({"kind": "not_spam"}, "no_spam"),
        ({"kind": "pair", "si_id": "si", "bl_id": "si", "reason": "r"}, "same_document"), ({"kind": "pair", "si_id": "si", "bl_id": "y", "reason": "r"}, "unread_or_unexplained"),
        ({"kind": "pair", "si_id": "x", "bl_id": "bl"}, "unread_or_unexplained"), ({"kind": "pair", "si_id": "x", "bl_id": "bl", "reason": "r", "conflict": True}, "identifiers_conflict"),
        (fix(reason=None), "no_current_comparison"), (fix(document_id="y"), "foreign_document"), (fix(ocr=True), "unverified_ocr"), (fix(transcribed=True), "unverified_transcription"), (fix(sources=0), "no_evidence"), (fix(document_id="x"), "not_in_pair"),
        ({"kind": "revision", "document_id": "y", "value": "z", "reason": "r"}, "unknown_document"), ({"kind": "revision", "document_id": "si", "value": "z"}, "unexplained"),
    ],
)
def test_what_a_case_does_not_allow(spark, event, error):
    a = _run(spark, opened(), event)
    assert (a[1]["outcome"], a[1]["error"], a[1]["revision"], a[1]["stage"]) == ("rejected", error, 1, "processed")


def test_categories_and_spam(spark):
    a = _run(spark, opened(value="SPAM", normalized=None, pair_valid=None), fix(), {"kind": "not_spam"}, {"kind": "not_spam"}, {"kind": "category", "value": "BL_COMPARISON"}, fix())
    assert [r["error"] for r in a] == [None, "category_required", None, "no_spam", None, "no_current_comparison"]
    assert a[2]["stage"] == "classification_required" and a[4]["processing"] == "queued"
    assert _run(spark, opened(value=None, normalized=None), {"kind": "category", "value": "SPAM"})[1]["error"] == "not_classified"


def test_revised_documents(spark):
    a = _run(spark, opened(), {"kind": "revision", "document_id": "bl", "value": "bl2", "reason": "r"}, done(run=2), fix(document_id="bl"), fix(document_id="bl2"), {"kind": "pair", "si_id": "si", "bl_id": "bl", "reason": "r"})
    assert [r["error"] for r in a] == [None, None, None, "foreign_document", None, "unread_or_unexplained"]
    assert a[1]["bl_id"] == "bl2" and a[1]["report_revision"] is None and a[4]["report_revision"] == a[4]["input_revision"] == 3
    full = _run(spark, opened(documents=[*DOCS, *(f"d{k}" for k in range(20))]), {"kind": "revision", "document_id": "x", "value": "n", "reason": "r"}, {"kind": "revision", "document_id": "n", "value": "m", "reason": "r"})
    assert [r["error"] for r in full] == [None, None, "too_many_versions"]


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows = []
    for case in (1, 2, 3):
        events = [opened(), {"kind": "assign", "value": "A"}, fix(normalized=str(case)), {"kind": "retry", "expected_revision": -1}, {"kind": "category", "value": "BL_COMPARISON"}, done(), fix(field="consignee"), {"kind": "revision", "document_id": "si", "value": "s2", "reason": "r"}, fix(), done(), fix(document_id="s2")]
        rows += [(case, *r[1:]) for r in _log(*events)]
    log = spark.createDataFrame(rows, reviews.EVENT)
    got: list[pd.DataFrame] = []

    def go(part):
        log.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming.follow_cases(streaming.new_files(spark, str(tmp_path / "in"), reviews.EVENT))
        streaming.run_once(stream, str(tmp_path / "ck"), lambda df, _: got.append(df.toPandas()))

    for part in ("seq < 4", "seq = 4", "seq > 4"):
        go(part)
    order = lambda df: df.astype(object).where(df.notna(), None).sort_values(["case_id", "seq"]).reset_index(drop=True)
    batch = order(reviews.replay(log).toPandas())
    assert len(batch) == 33 and (batch.outcome == "applied").sum() > 20
    pd.testing.assert_frame_equal(order(pd.concat([x for x in got if len(x)])), batch, check_dtype=False)


def test_only_what_rests_on_a_correction_is_compared_again(spark):
    rows = [(c, role, role.lower(), f, f"{f}{c}" if role == "SI" or k % 2 else None, None if role == "SI" or k % 2 else "missing_value", "f") for c in (1, 2) for role in ("SI", "BL") for k, f in enumerate(compare.L.FIELDS)]
    readings = spark.createDataFrame(rows, "case_id long, role string, document_id string, field string, normalized string, issue string, fingerprint string")
    log = [(1, *r[1:]) for r in _log(opened(), fix(document_id="bl", normalized="shipper1"), fix(document_id="bl", normalized="x"), fix(document_id="bl", normalized="shipper1"), fix(document_id="bl", field="notify_party", normalized="q", fingerprint="older"))]
    outcomes = reviews.replay(spark.createDataFrame(log, reviews.EVENT))
    fixes = reviews.corrections(outcomes)
    found = compare.findings(readings)
    after = {(r.case_id, r.field): r.outcome for r in reviews.compare_again(found, readings, fixes).collect()}
    before = {(r.case_id, r.field): r.outcome for r in found.collect()}
    assert {k for k in before if before[k] != after[k]} == {(1, "shipper")} and after[1, "shipper"] == "match"
    assert len(after) == 14 and after == {(r.case_id, r.field): r.outcome for r in compare.findings(reviews.corrected(readings, fixes)).collect()}
    history = [(r.field, r.before, r.after) for r in reviews.correction_history(outcomes, readings).orderBy("seq").collect()]
    assert history == [("shipper", None, "shipper1"), ("shipper", "shipper1", "x"), ("shipper", "x", "shipper1"), ("notify_party", None, "q")]


def test_fingerprints(spark):
    def of(rows, *versions):
        blocks = spark.createDataFrame(rows, "document_id string, block int, text string, method string, confidence double, locations string")
        return {r.document_id: r.fingerprint for r in reviews.fingerprints(blocks, *versions).collect()}

    rows = [("a", 1, "t", "ocr", 0.5, "l"), ("a", 2, "u", "ocr", None, "l"), ("b", 1, "t", "ocr", 0.5, "l"), ("b", 2, "u", "ocr", None, "l")]
    base = of(rows, "v1")
    assert base == of(rows[::-1], "v1") and base["a"] != base["b"] and base["a"] != of(rows, "v2")["a"]
    for k, x in ((1, 3), (2, "T"), (3, "native"), (4, 0.6), (5, "m")):
        changed = [tuple(x if i == k else y for i, y in enumerate(rows[0])), *rows[1:]]
        assert of(changed, "v1")["a"] != base["a"] and of(changed, "v1")["b"] == base["b"]
    assert reviews.profile({"a": 1, "b": 2}) == reviews.profile({"b": 2, "a": 1}) != reviews.profile({"a": 1, "b": 3})
