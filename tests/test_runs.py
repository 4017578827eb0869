"""Run monitoring: rules, silent leases in a stream whose clock is its watermark, and the batch twin."""

import datetime
import random

import pytest

from tallymark import streaming
from tallymark.streaming import runs

NAMES = runs.OUTCOME_NAMES


def _at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def _run(*events, until=None):
    """Statuses after each event (seconds, kind, token) of one run, with the leases that ended."""
    state, out = runs.START, []
    for seconds, kind, token in events:
        rows, state = runs.apply_event(1, _at(seconds), kind, token, state)
        out += rows
    out += runs.end_lease(1, state, _at(until))[0] if until else []
    return [(r[2], r[3], r[4], r[5]) for r in out]


def test_a_silent_lease_queues_the_run_again():
    assert _run((0, "claimed", "a"), until=89) == [("claimed", True, "running", 1)]
    assert _run((0, "claimed", "a"), until=90)[1:] == [("lease_ended", True, "queued", 1)]
    assert _run((0, "claimed", "a"), (80, "heartbeat", "a"), until=169)[-1] == ("heartbeat", True, "running", 1)
    assert _run((0, "claimed", "a"), (95, "claimed", "b"))[1:] == [("lease_ended", True, "queued", 1), ("claimed", True, "running", 2)]


def test_three_attempts_at_most():
    silent = _run((0, "claimed", "a"), (100, "claimed", "b"), (200, "claimed", "c"), until=400)
    assert silent[-1] == ("lease_ended", True, "failed", 3)
    assert _run((0, "claimed", "a"), (1, "error", "a"), (2, "claimed", "a"), (3, "error", "a"), (4, "claimed", "a"), (5, "error", "a"))[-1] == ("error", True, "failed", 3)
    assert _run((0, "claimed", "a"), (1, "refused", "a"), (2, "claimed", "b"))[1:] == [("refused", True, "failed", 1), ("claimed", False, "failed", 1)]


def test_foreign_and_late_events_change_nothing():
    assert _run((0, "claimed", "a"), (1, "completed", "b"), (2, "claimed", "b"), (3, "heartbeat", None), (4, "other", "a"))[1:] == [(k, False, "running", 1) for k in ("completed", "claimed", "heartbeat", "other")]
    assert _run((0, "claimed", "a"), (100, "completed", "a"))[1:] == [("lease_ended", True, "queued", 1), ("completed", False, "queued", 1)]
    assert _run((0, "superseded", None), (1, "claimed", "a")) == [("superseded", True, "superseded", 0), ("claimed", False, "superseded", 0)]
    assert _run((0, "heartbeat", "a"), (1, "completed", "a")) == [("heartbeat", False, "queued", 0), ("completed", False, "queued", 0)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_stream_equals_batch_and_timers_end_leases(rocks, tmp_path):
    rng = random.Random(3)
    events, clock = [], 0
    for k in range(120):
        clock += rng.randrange(1, 40)  # events no later than the watermark would be dropped as late
        events.append((rng.randrange(8), _at(clock), k, rng.choice(["claimed", "claimed", "heartbeat", "error", "completed"]), rng.choice("ab")))
    events.append((50, _at(clock), 200, "claimed", "a"))
    got: list = []

    def go(rows):
        rocks.createDataFrame(rows, runs.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = runs.follow_runs(streaming.new_files(rocks, str(tmp_path / "in"), runs.EVENT))
        streaming.run_once(stream, str(tmp_path / "ck"), lambda df, _: got.extend(tuple(r[n] for n in NAMES) for r in df.collect()))

    go(events[:50])
    go(events[50:])
    told = sum(r[2] == "lease_ended" for r in got)
    go([(99, _at(clock + 1000), 0, "claimed", "z")])  # the clock of the stream goes on; nothing else is heard of the others
    assert sum(r[2] == "lease_ended" for r in got) > told
    log = rocks.createDataFrame(events, runs.EVENT)
    batch = [tuple(r[n] for n in NAMES) for r in runs.replay_runs(log, _at(clock + 1000)).collect()]
    assert sorted(map(repr, (r for r in got if r[0] != 99))) == sorted(map(repr, batch))
    last = {r.run_id: r.status for r in runs.attempts_of(runs.replay_runs(log, _at(clock + 1000))).collect()}
    assert set(last) == {e[0] for e in events} and "running" not in last.values()


def test_events_without_a_run_or_time_are_left_out(spark):
    rows = [(None, _at(0), 0, "claimed", "a"), (1, None, 0, "claimed", "a")]
    assert runs.replay_runs(spark.createDataFrame(rows, runs.EVENT), _at(9)).collect() == []
