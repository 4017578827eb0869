"""Monitoring runs: attempts, leases that end in silence, late and foreign events.

A run is queued, claimed under a token with a lease, kept alive by heartbeats,
and ends completed, failed or superseded.  A lease that ends without a word
queues the run again; after the third attempt the run has failed.  Every event
and every ended lease gives a row; ``applied`` says whether it changed anything.
``follow_runs`` keeps a run's state in a state store and sets a timer on its
lease; ``replay_runs`` is its batch twin up to a point in time.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "run_id long, at timestamp, seq long, kind string, token string"
OUTCOME = "run_id long, at timestamp, kind string, applied boolean, status string, attempts int, error string"
EVENT_NAMES, OUTCOME_NAMES = ([x.split()[0] for x in s.split(", ")] for s in (EVENT, OUTCOME))
_STATE = "status string, attempts int, token string, lease_until timestamp, error string"

# Fixed values.
LEASE, MOST_ATTEMPTS = datetime.timedelta(seconds=90), 3
ENDED = ("completed", "failed", "superseded")
START = ("queued", 0, None, None, None)

State = tuple[str, int, str | None, datetime.datetime | None, str | None]


def _row(run: int, at: datetime.datetime, kind: str, applied: bool, state: State) -> tuple:
    return (run, at, kind, applied, state[0], state[1], state[4])


def end_lease(run: int, state: State, now: datetime.datetime) -> tuple[list[tuple], State]:
    """A lease that is over by ``now`` queues its run again, or fails it after the last attempt."""
    status, attempts, _, until, _ = state
    if status != "running" or until is None or until > now:
        return [], state
    state = ("failed", attempts, None, None, "attempts_exhausted") if attempts >= MOST_ATTEMPTS else ("queued", attempts, None, None, None)
    return [_row(run, until, "lease_ended", True, state)], state


def apply_event(run: int, at: datetime.datetime, kind: str, token: str | None, state: State) -> tuple[list[tuple], State]:
    """Rows of one event, behind that of a lease which ended before it, and the state after it."""
    rows, state = end_lease(run, state, at)
    status, attempts, owner, until, error = state
    new = None
    if status in ENDED:
        pass
    elif kind == "claimed":
        if status == "queued":
            new = ("failed", attempts, None, None, "attempts_exhausted") if attempts >= MOST_ATTEMPTS else ("running", attempts + 1, token, at + LEASE, None)
    elif kind == "superseded":
        new = ("superseded", attempts, None, None, None)
    elif status == "running" and token is not None and token == owner:
        if kind == "heartbeat":
            new = (status, attempts, owner, at + LEASE, None)
        elif kind == "completed":
            new = ("completed", attempts, None, None, None)
        elif kind in ("error", "refused"):  # an error may pass, a refusal doesn't
            ends = kind == "refused" or attempts >= MOST_ATTEMPTS
            new = ("failed" if ends else "queued", attempts, None, None, kind)
    rows.append(_row(run, at, kind, new is not None, new or state))
    return rows, new or state


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=OUTCOME_NAMES)
    return out.assign(at=pd.to_datetime(out["at"]))


def _known(x: Any) -> Any:
    return None if pd.isna(x) else x


class RunMonitor(StatefulProcessor):
    """One run's state, and a timer where its lease ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("run", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self._held()
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").itertuples(index=False):  # a run's share of one trigger
            found, state = apply_event(key[0], r.at.to_pydatetime(), r.kind, _known(r.token), state)
            out.extend(found)
        self._hold(state)
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, datetime.UTC).replace(tzinfo=None)
        out, state = end_lease(key[0], self._held(), due)
        if out:
            self._hold(state)
            yield _frame(out)

    def _held(self) -> State:
        if not self._state.exists():
            return START
        status, attempts, token, until, error = self._state.get()
        return status, attempts, _known(token), None if until is None or pd.isna(until) else pd.Timestamp(until).to_pydatetime().replace(tzinfo=None), _known(error)

    def _hold(self, state: State) -> None:
        for due in list(self._handle.listTimers()):
            self._handle.deleteTimer(due)
        if state[3] is not None:
            self._handle.registerTimer(int(state[3].replace(tzinfo=datetime.UTC).timestamp() * 1000))
        self._state.update(state)

    def close(self) -> None:
        pass


def follow_runs(events: DataFrame, *, late: str = "0 seconds") -> DataFrame:
    """A stream of run events as ``OUTCOME``; leases end when the watermark passes them.

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB
    provider and a session in UTC.
    """
    chosen = events.select(EVENT_NAMES).where("run_id is not null and at is not null").withWatermark("at", late)
    return chosen.groupBy("run_id").transformWithStateInPandas(statefulProcessor=RunMonitor(), outputStructType=OUTCOME, outputMode="append", timeMode="eventTime")


def _replay(until: datetime.datetime):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, START
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.run_id != at:
                    if at is not None:
                        out.extend(end_lease(at, state, until)[0])
                    at, state = r.run_id, START
                found, state = apply_event(r.run_id, r.at.to_pydatetime(), r.kind, _known(r.token), state)
                out.extend(found)
            yield _frame(out)
        if at is not None:
            yield _frame(end_lease(at, state, until)[0])

    return run


def replay_runs(events: DataFrame, until: datetime.datetime) -> DataFrame:
    """``OUTCOME`` of all events, and of leases that ended by ``until``; one run's state is held at a time."""
    chosen = events.select(EVENT_NAMES).where("run_id is not null and at is not null")
    return chosen.repartition("run_id").sortWithinPartitions("run_id", "at", "seq").mapInPandas(_replay(until), OUTCOME)


def attempts_of(outcomes: DataFrame) -> DataFrame:
    """run_id, status, attempts, ended_leases, ignored: where each run stands."""
    last = F.max_by(F.struct("status", "attempts", "error"), F.struct("at", F.col("kind") != "lease_ended", "attempts")).alias("last")
    counted = outcomes.groupBy("run_id").agg(last, F.count_if(F.col("kind") == "lease_ended").alias("ended_leases"), F.count_if(~F.col("applied")).alias("ignored"))
    return counted.select("run_id", "last.status", "last.attempts", "last.error", "ended_leases", "ignored")
