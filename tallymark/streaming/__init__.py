"""Streams: email intake, reviewer actions, live counts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import reviews

ACTION = "case_id long, seq long, kind string, expected_revision long"
OUTCOME = "case_id long, seq long, kind string, applied boolean, revision long, input_revision long, workflow string"
_STATE = "revision long, input_revision long, workflow string"
#: Kinds that change what a comparison rests on.
_INPUT = {"category", "not_spam", "pair", "correct", "revision"}


_START = (0, 1, "open")


def _apply(r: Any, state: tuple[int, int, str]) -> tuple[tuple, tuple[int, int, str]]:
    revision, input_revision, workflow = state
    applied = pd.isna(r.expected_revision) or int(r.expected_revision) == revision
    if applied:
        revision += 1
        input_revision += r.kind in _INPUT
        workflow = {"workflow": "completed", "not_spam": "open"}.get(r.kind, workflow)
    return (int(r.case_id), int(r.seq), r.kind, bool(applied), revision, input_revision, workflow), (revision, input_revision, workflow)


def fold_actions(rows: pd.DataFrame, state: tuple[int, int, str]) -> tuple[list[tuple], tuple[int, int, str]]:
    """Apply a case's actions in order; one whose expected revision is not the current one is a conflict and changes nothing."""
    out = []
    for r in rows.sort_values("seq", kind="stable").itertuples(index=False):
        row, state = _apply(r, state)
        out.append(row)
    return out, state


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in OUTCOME.split(", ")])


def _fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by case and number; only the state of the case at hand is held, however many actions it has."""
    case, state = None, _START
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.case_id != case:
                case, state = r.case_id, _START
            row, state = _apply(r, state)
            out.append(row)
        yield _frame(out)


def replay_actions(actions: DataFrame) -> DataFrame:
    """Batch twin of ``apply_actions``; actions without a case or a number have nothing to act on and are left out."""
    chosen = actions.select("case_id", "seq", "kind", "expected_revision").where("case_id is not null and seq is not null")
    ordered = chosen.repartition("case_id").sortWithinPartitions("case_id", "seq", "kind", "expected_revision")
    return ordered.mapInPandas(_fold_sorted, OUTCOME)


def _stateful(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows, held = fold_actions(pd.concat(list(batches)), state.get if state.exists else _START)
    state.update(held)
    yield _frame(rows)


def apply_actions(actions: DataFrame) -> DataFrame:
    """A stream of actions folded into the state of their cases."""
    chosen = actions.select("case_id", "seq", "kind", "expected_revision")
    return chosen.groupBy("case_id").applyInPandasWithState(_stateful, OUTCOME, _STATE, "append", GroupStateTimeout.NoTimeout)


def _follow(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else None
    out = []
    for row in pd.concat(list(batches)).sort_values(["seq", "kind"], kind="stable").itertuples(index=False):  # a case's share of one trigger
        outcome, held = reviews.apply_event(row, held)
        out.append(outcome)
    state.update((reviews.packed(held),))
    yield reviews.outcome_frame(out)


def follow_cases(events: DataFrame) -> DataFrame:
    """A stream of ``reviews.EVENT`` folded into its cases; its batch twin is ``reviews.replay``."""
    chosen = events.select(reviews.EVENT_NAMES).where("case_id is not null and seq is not null")
    return chosen.groupBy("case_id").applyInPandasWithState(_follow, reviews.OUTCOME, "held string", "append", GroupStateTimeout.NoTimeout)


def new_files(spark: SparkSession, path: str, schema: str, *, per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def import_once(arrivals: DataFrame, *, keys: list[str], at: str, within: str = "7 days") -> DataFrame:
    """The first arrival of each key; state is bounded by the watermark, older repeats are for ``import_outcome``."""
    return arrivals.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def live_counts(cases: DataFrame) -> DataFrame:
    """Cases by workspace and workflow, kept up to date."""
    return cases.groupBy("workspace_id", "workflow").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], *, mode: str = "append") -> None:
    """Process what is there and stop; offsets in ``checkpoint`` make a rerun start where this one ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
