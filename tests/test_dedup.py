"""The batch operator, the stateful one and the rule for single events agree."""

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators import dedup
from logloom.streaming import dedup as stream
from logloom.streaming.transition import SECOND, transition

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ENRICHED = (
    "event_id bigint, timestamp timestamp, fingerprint string, title string, level string, service string, host string, message string, error_code string, trace_id string, "
    "labels map<string,string>, window_seconds int, refire_interval_seconds int, suppress_dispatch_while_acknowledged boolean, allow_reopen_after_resolve boolean"
)


def rows(events):
    """events: (fingerprint, seconds, window, refire, level)."""
    return [
        (i, START + timedelta(seconds=t), f"fp{fp}", f"t{i}", level, "s", "h", f"m{i}", None, f"tr{i}" if i % 3 else "", {"a": "b"}, w, r, True, True)
        for i, (fp, t, w, r, level) in enumerate(events)
    ]


def expected(events):
    """event_id -> (action, count, severity, trace) by the rule, in event-time order."""
    out, states = {}, {}
    order = sorted(range(len(events)), key=lambda i: (events[i][1], i))
    for i in order:
        fp, t, w, r, level = events[i]
        e = {"event_id": i, "micros": t * SECOND, "clock": t * SECOND, "level": level, "message": f"m{i}", "trace_id": f"tr{i}" if i % 3 else "", "window_seconds": w, "refire_interval_seconds": r}
        action, states[fp] = transition(states.get(fp), e)
        s = states[fp]
        out[i] = (action, s["occurrence_count"], s["severity"], s["trace_id"])
    return out


def acted(spark, events, **more):
    return dedup.actions(spark.createDataFrame(rows(events), ENRICHED), **more)


def check(spark, events, **more):
    a = acted(spark, events, **more)
    want = expected(events)
    assert {r.event_id: r.action for r in a.collect()} == {i: x[0] for i, x in want.items()}
    got = {r.event_id: (r.action, r.occurrence_count, r.severity, r.trace_id) for r in dedup.emits(a).collect()}
    assert got == {i: x for i, x in want.items() if x[0] != "suppress"}


CASES = {
    "refire": ([(0, t, 300, 60, "ERROR") for t in (0, 10, 70, 80)], ["new", "suppress", "update", "suppress"]),
    "expiry": ([(0, t, 300, 60, "ERROR") for t in (0, 5, 400)], ["new", "suppress", "new"]),
    "gap as long as the window": ([(0, t, 300, 60, "ERROR") for t in (0, 300, 601)], ["new", "update", "new"]),
    "gap as long as the refire": ([(0, t, 300, 60, "ERROR") for t in (0, 60, 119)], ["new", "update", "suppress"]),
    "the window of the event before": ([(0, 0, 100, 60, "ERROR"), (0, 90, 1000, 60, "ERROR"), (0, 900, 100, 60, "ERROR"), (0, 1001, 9999, 60, "ERROR")], ["new", "update", "update", "new"]),
    "over days": ([(0, t, 100_000, 60, "ERROR") for t in (0, 86_399, 86_401, 200_000, 300_001)], ["new", "update", "suppress", "new", "new"]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    events, want = CASES[name]
    got = [r.action for r in acted(spark, events).orderBy("timestamp").collect()]
    assert got == want
    check(spark, events)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 200_000), st.sampled_from([1, 60, 300, 5000]), st.sampled_from([1, 30, 300]), st.sampled_from(["ERROR", "CRITICAL", "WARN"])), min_size=1, max_size=40))
def test_any_events(spark, events):
    check(spark, events)
    check(spark, events, fold_events=2)  # longer sessions go through the sorted stream


def test_future_clamp(spark):
    events = [(0, 0, 300, 60, "ERROR"), (0, 10_000, 300, 60, "ERROR")]
    now = int(START.timestamp()) * SECOND + 100 * SECOND
    got = acted(spark, events, now_micros=now).orderBy("micros").collect()
    assert got[1].clock == now


def test_late_event_moves_last_seen_back():
    actions, state = [], None
    for i, t in enumerate((0, 250, 10, 320)):
        action, state = transition(state, {"event_id": i, "micros": t * SECOND, "clock": t * SECOND, "level": "ERROR", "message": "", "window_seconds": 300, "refire_interval_seconds": 60})
        actions.append(action)
    assert actions == ["new", "update", "suppress", "new"]


def test_stream_in_pieces(spark, tmp_path):
    """Micro-batches in event-time order give what the whole table gives, and a second run finds nothing to do."""
    events = [(i % 3, 37 * i, 300, 60, "CRITICAL" if i % 7 == 0 else "ERROR") for i in range(60)]
    table = spark.createDataFrame(rows(events), ENRICHED)
    for k in range(3):
        table.where(F.col("event_id").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    for _ in range(2):
        stream.run_available(stream.emits(src), str(tmp_path / "check"), lambda df, n: got.extend(df.collect()))
    want = {i: x for i, x in expected(events).items() if x[0] != "suppress"}
    assert len(got) == len(want)
    assert {r.event_id: (r.action, r.occurrence_count, r.severity, r.trace_id) for r in got} == want
