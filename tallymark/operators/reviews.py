"""Reviewer actions and processing results folded into the state of their case.

A case's events take effect in order.  An action that expects another revision
than the current one is a conflict, one that its case does not allow is
rejected, a result of an outdated run or input is superseded; none of these
changes anything.  ``replay`` folds a table (sorted, holding one case's state at
a time), ``tallymark.streaming.follow_cases`` a stream; both give the same rows.
Corrections then meet the stored readings by join, and only the comparisons that
rest on a corrected reading are made again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import compare

#: ``value``: assignee, workflow, category or the new document's id.  ``sources``: how many blocks a correction names.
EVENT = (
    "case_id long, seq long, kind string, expected_revision long, value string, si_id string, bl_id string, document_id string, field string, "
    "normalized string, issue string, fingerprint string, sources int, ocr boolean, verified boolean, transcribed boolean, conflict boolean, reason string, "
    "run long, result_revision long, pair_valid boolean, documents array<string>"
)
OUTCOME = (
    "case_id long, seq long, kind string, outcome string, error string, revision long, input_revision long, workflow string, assignee string, suggested string, accepted string, source string, "
    "processing string, stage string, si_id string, bl_id string, run long, report_revision long, pair_valid boolean, document_id string, field string, normalized string, issue string, fingerprint string, provenance string"
)
EVENT_NAMES, OUTCOME_NAMES = ([x.split()[0] for x in s.split(", ")] for s in (EVENT, OUTCOME))

# Fixed values.
COMPARISON, UNASSIGNED, MOST_DOCUMENTS = "BL_COMPARISON", "Unassigned", 24
WORKFLOWS = ("open", "waiting", "completed")
#: Kinds that change what a comparison rests on.
INPUTS = ("category", "not_spam", "pair", "correct", "revision")
START: dict[str, Any] = {
    "revision": 1, "input_revision": 1, "workflow": "open", "assignee": UNASSIGNED, "suggested": None, "accepted": None, "source": "model", "processing": "queued", "stage": "created",
    "si_id": None, "bl_id": None, "run": 1, "report_revision": None, "pair_valid": None, "documents": {},
}


class Rejected(Exception):
    """An action that the case does not allow."""


def _need(fits: Any, error: str) -> None:
    if not fits:
        raise Rejected(error)


def _queue(state: dict, stage: str) -> None:
    state.update(processing="queued", stage=stage, run=state["run"] + 1)


def _drop_report(state: dict) -> None:
    state.update(report_revision=None, pair_valid=None)


def _is_current(state: dict, name: str | None) -> bool:
    return name is not None and state["documents"].get(name) is True


def _created(state: dict, e: Any) -> None:
    state.update(suggested=e.value, accepted=e.normalized, si_id=e.si_id, bl_id=e.bl_id, documents={x: True for x in (() if e.documents is None else e.documents)})
    if e.pair_valid is not None:
        state.update(report_revision=state["input_revision"], pair_valid=bool(e.pair_valid), processing="completed", stage="processed")


def _assign(state: dict, e: Any) -> None:
    _need(e.value, "unknown_reviewer")
    state["assignee"] = e.value


def _workflow(state: dict, e: Any) -> None:
    _need(e.value in WORKFLOWS, "unknown_workflow")
    state["workflow"] = e.value


def _category(state: dict, e: Any) -> None:
    _need(state["suggested"], "not_classified")
    state.update(accepted=e.value, source="human")
    _drop_report(state)
    if e.value == COMPARISON:
        _queue(state, "classification_accepted")
    else:
        state.update(processing="completed", stage="category_changed")


def _not_spam(state: dict, e: Any) -> None:
    suspected = state["accepted"] is None and state["suggested"] == "SPAM" and state["source"] != "human"
    _need(state["accepted"] == "SPAM" or suspected, "no_spam")
    state.update(accepted=None, source="human", workflow="open", processing="completed", stage="classification_required")


def _pair(state: dict, e: Any) -> None:
    _need(state["accepted"] == COMPARISON, "category_required")
    _need(e.si_id != e.bl_id, "same_document")
    _need(_is_current(state, e.si_id) and _is_current(state, e.bl_id) and e.reason, "unread_or_unexplained")
    _need(not e.conflict, "identifiers_conflict")
    state.update(si_id=e.si_id, bl_id=e.bl_id)
    _drop_report(state)
    _queue(state, "pair_accepted")


def _correct(state: dict, e: Any) -> None:
    _need(state["accepted"] == COMPARISON, "category_required")
    _need(state["pair_valid"] and state["report_revision"] == state["input_revision"] and e.field and e.reason, "no_current_comparison")
    _need(_is_current(state, state["si_id"]) and _is_current(state, state["bl_id"]), "pair_changed")
    _need(_is_current(state, e.document_id), "foreign_document")
    _need(e.verified or not e.ocr, "unverified_ocr")
    _need(e.verified or not e.transcribed, "unverified_transcription")
    _need(e.sources, "no_evidence")
    _need(e.document_id in (state["si_id"], state["bl_id"]), "not_in_pair")
    state.update(report_revision=state["input_revision"] + 1, processing="completed", stage="reading_corrected")


def _retry(state: dict, e: Any) -> None:
    _queue(state, "retry_requested")


def _revision(state: dict, e: Any) -> None:
    _need(state["accepted"] == COMPARISON, "category_required")
    _need(_is_current(state, e.document_id), "unknown_document")
    _need(e.reason, "unexplained")
    _need(len(state["documents"]) < MOST_DOCUMENTS, "too_many_versions")
    role = next((r for r in ("si_id", "bl_id") if state[r] == e.document_id), None)
    state["documents"] = state["documents"] | {e.document_id: False, e.value: True}
    if role:
        state[role] = e.value
    _drop_report(state)
    _queue(state, "revision_attached")
    state["workflow"] = "open"


def _publish(state: dict, e: Any) -> None:
    """Processing owns category, report and stage; a person's category, the workflow and the assignee stay."""
    if state["source"] != "human":
        state.update(suggested=e.value, accepted=e.normalized)
    if e.kind == "classified":
        state["stage"] = "classified"
    else:
        state.update(processing="completed", stage="processed", report_revision=state["input_revision"] if e.pair_valid is not None else None, pair_valid=None if e.pair_valid is None else bool(e.pair_valid))


_ACTIONS = {"created": _created, "assign": _assign, "workflow": _workflow, "category": _category, "not_spam": _not_spam, "pair": _pair, "correct": _correct, "retry": _retry, "revision": _revision, "classified": _publish, "published": _publish}
_RESULTS = ("classified", "published")


def _known(x: Any) -> Any:
    """None for any of pandas' missing values."""
    return None if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else x


def apply_event(row: Any, state: dict | None) -> tuple[tuple, dict]:
    """The outcome of one event and the state after it."""
    e = row._make(map(_known, row))
    before = dict(START) if state is None else state
    after, outcome, error = dict(before), "applied", None
    if e.kind in _RESULTS and ((e.run is not None and int(e.run) != before["run"]) or (e.result_revision is not None and int(e.result_revision) != before["input_revision"])):
        outcome = "superseded"
    elif e.kind not in _RESULTS and e.expected_revision is not None and int(e.expected_revision) != before["revision"]:
        outcome = "conflict"
    elif e.kind not in _ACTIONS:
        outcome, error = "rejected", "unknown_kind"
    else:
        try:
            _ACTIONS[e.kind](after, e)
            if e.kind != "created":
                after["revision"] += 1
                after["input_revision"] += e.kind in INPUTS
        except Rejected as no:
            after, outcome, error = before, "rejected", str(no)
    fixed = outcome == "applied" and e.kind == "correct"
    provenance = ("human_transcribed" if e.transcribed else "human_verified") if fixed else None
    own = [after[k] for k in ("revision", "input_revision", "workflow", "assignee", "suggested", "accepted", "source", "processing", "stage", "si_id", "bl_id", "run", "report_revision", "pair_valid")]
    reading = [e.document_id, e.field, e.normalized, e.issue, e.fingerprint, provenance] if fixed else [None] * 6
    return (int(e.case_id), int(e.seq), e.kind, outcome, error, *own, *reading), after


def outcome_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=OUTCOME_NAMES, dtype=object)
    for name in ("run", "report_revision", "revision", "input_revision"):
        out[name] = out[name].astype("Int64")
    return out


def packed(state: dict) -> str:
    return json.dumps(state, sort_keys=True)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    case, state = None, None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.case_id != case:
                case, state = row.case_id, None
            outcome, state = apply_event(row, state)
            out.append(outcome)
        yield outcome_frame(out)


def replay(events: DataFrame) -> DataFrame:
    """``OUTCOME`` of every event; events without a case or a number have nothing to act on and are left out."""
    chosen = events.select(EVENT_NAMES).where("case_id is not null and seq is not null")
    return chosen.repartition("case_id").sortWithinPartitions("case_id", "seq", "kind").mapInPandas(_fold, OUTCOME)


def corrections(outcomes: DataFrame) -> DataFrame:
    """The last correction of each document and field: case_id, document_id, field, normalized, issue, fingerprint, provenance."""
    held = F.max_by(F.struct("normalized", "issue", "fingerprint", "provenance"), "seq").alias("last")
    return outcomes.where("provenance is not null").groupBy("case_id", "document_id", "field").agg(held).select("case_id", "document_id", "field", "last.*")


def corrected(readings: DataFrame, fixes: DataFrame) -> DataFrame:
    """``readings`` (case_id, document_id, field, normalized, issue, fingerprint ...) with corrections whose evidence is still the same."""
    own = fixes.select("case_id", "document_id", "field", F.struct("normalized", "issue", "fingerprint", "provenance").alias("fix"))
    out = readings.join(own, ["case_id", "document_id", "field"], "left")
    holds = F.col("fix").isNotNull() & F.col("fix.fingerprint").eqNullSafe(F.col("fingerprint"))
    take = lambda name: F.when(holds, F.col(f"fix.{name}")).otherwise(F.col(name)).alias(name)
    rest = [c for c in readings.columns if c not in ("normalized", "issue", "provenance")]
    return out.select(*rest, take("normalized"), take("issue"), F.when(holds, F.col("fix.provenance")).otherwise("machine").alias("provenance"))


def correction_history(outcomes: DataFrame, readings: DataFrame) -> DataFrame:
    """case_id, seq, document_id, field, before, after, input_revision: what each correction replaced, an earlier one or the machine's reading."""
    fixes = outcomes.where("provenance is not null")
    own = Window.partitionBy("case_id", "document_id", "field").orderBy("seq")
    fixes = fixes.select("case_id", "seq", "document_id", "field", "input_revision", F.col("normalized").alias("after"), F.lag("normalized").over(own).alias("earlier"), F.row_number().over(own).alias("n"))
    machine = readings.groupBy("case_id", "document_id", "field").agg(F.min_by("normalized", "fingerprint").alias("machine"))
    before = F.when(F.col("n") == 1, F.col("machine")).otherwise(F.col("earlier"))
    return fixes.join(machine, ["case_id", "document_id", "field"], "left").select("case_id", "seq", "document_id", "field", before.alias("before"), "after", "input_revision")


def compare_again(found: DataFrame, readings: DataFrame, fixes: DataFrame) -> DataFrame:
    """``found`` with the findings that rest on a corrected reading made again; others are taken over as they are.

    ``found``: rows of ``compare.findings``; ``readings`` also has role.  What
    is read again is bounded by the corrections, not by the findings.
    """
    touched = fixes.select("case_id", "field").distinct()
    again = corrected(readings.join(touched, ["case_id", "field"], "left_semi"), fixes)
    fresh = compare.findings(again).join(touched, ["case_id", "field"], "left_semi")
    return found.join(touched, ["case_id", "field"], "left_anti").unionByName(fresh.select(found.columns))


def fingerprints(blocks: DataFrame, *versions: str) -> DataFrame:
    """document_id, fingerprint of its blocks (block, text, method, confidence, locations as text) and of the readers' versions; any change of one changes it."""
    held = F.array_sort(F.collect_list(F.struct("block", "text", "method", "confidence", "locations")))
    return blocks.groupBy("document_id").agg(F.sha2(F.to_json(F.struct(F.col("document_id"), held.alias("blocks"), F.array(*map(F.lit, versions)).alias("versions")), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def profile(settings: dict) -> str:
    """Identity of what a stage's results rest on: models, thresholds, texts of requests."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
