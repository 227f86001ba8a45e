"""Dedup of a stream: one state per fingerprint; late events are merged, never dropped.

Three things may be added to the plain operator, all of them without any effect on its decisions:

* ``settle_seconds``: an event-time timer deletes a state that has seen nothing for its window and that time more, and emits a closing row
  (action ``closed``) with what it was. The stream's time is a watermark on the clamped event time, but that column doesn't reach the
  operator, so Spark drops no late rows: an event that comes after its state has gone begins a new incident, as it would after its
  window. Only an event that is late by more than ``settle_seconds`` could have met the state.
* ``keep_states``: a row (action ``state``) for each fingerprint of a batch whose last event was suppressed. With the emitted rows, which
  carry the state as well, they are what ``latest_states`` turns into rows of the ``states`` table.
* ``initial``: states of such a table, for a stream whose checkpoint is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import incident_id
from ..model import FUTURE_SECONDS
from ..operators.dedup import SECOND, event_clock
from .transition import transition

STATE = (
    "fingerprint string, title string, service string, host string, error_code string, labels map<string,string>, trace_id string, first_seen bigint, first_event bigint, "
    "last_seen bigint, last_emitted bigint, occurrence_count bigint, severity string, sample_message string, window_seconds int"
)
STATE_NAMES = ("fingerprint", "title", "service", "host", "error_code", "labels", "trace_id", "first_seen", "first_event", "last_seen", "last_emitted", "occurrence_count", "severity", "sample_message", "window_seconds")
OUT = (
    "event_id bigint, micros bigint, action string, fingerprint string, title string, description string, severity string, service string, host string, status string, "
    "occurrence_count bigint, first_micros bigint, first_event bigint, last_seen timestamp, error_code string, trace_id string, labels map<string,string>, sample_message string, is_new boolean, "
    "window_seconds int, suppress_dispatch_while_acknowledged boolean, allow_reopen_after_resolve boolean, last_emitted bigint, step bigint"
)
EMITTED = ("new", "update")
#: Partitions of the state for each core of the session: more even out keys of different sizes, and each costs every batch.
PER_CORE = 4
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _row(state: dict, action: str, step: int, event: dict | None = None) -> Row:
    event = event or {}
    new = action == "new"
    return Row(
        event_id=event.get("event_id"), micros=event.get("micros", state["last_seen"]), action=action, fingerprint=state["fingerprint"], title=state["title"], description=event.get("message", state["sample_message"]), severity=state["severity"],
        service=state["service"], host=state["host"], status="open" if new else "updated", occurrence_count=state["occurrence_count"], first_micros=state["first_seen"], first_event=state["first_event"],
        last_seen=(EPOCH + timedelta(microseconds=state["last_seen"])), error_code=state["error_code"], trace_id=state["trace_id"], labels=state["labels"], sample_message=state["sample_message"], is_new=new,
        window_seconds=state["window_seconds"], suppress_dispatch_while_acknowledged=event.get("suppress_dispatch_while_acknowledged"), allow_reopen_after_resolve=event.get("allow_reopen_after_resolve"),
        last_emitted=state["last_emitted"], step=step,
    )


class Dedup(StatefulProcessor):
    """State is read once and written once per key and batch; rows of a key are sorted by (time, event_id) first."""

    def __init__(self, settle_seconds: int | None = None, keep_states: bool = False) -> None:
        self.settle_seconds, self.keep_states = settle_seconds, keep_states

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("incident", STATE)

    def _load(self) -> dict | None:
        got = self.state.get() if self.state.exists() else None
        if got is None:
            return None
        state = dict(zip(STATE_NAMES, got, strict=True))
        return state | {"labels": state["labels"] or {}}  # a state store gives an empty map back as null

    def _store(self, state: dict) -> None:
        self.state.update(tuple(state[k] for k in STATE_NAMES))

    def _settles(self, state: dict) -> int:
        """When a state has been still for its window and the time to settle, in milliseconds."""
        return -(-(state["last_seen"] + (state["window_seconds"] + self.settle_seconds) * SECOND) // 1000)

    def _set_timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        state, out, action = self._load(), [], None
        for step, e in enumerate(sorted((r.asDict() for r in rows), key=lambda r: (r["micros"], r["event_id"]))):
            action, state = transition(state, e)
            if action != "suppress":
                out.append(_row(state, action, step, e))
        if self.keep_states and action == "suppress":
            out.append(_row(state, "state", step + 1))
        self._store(state)
        if self.settle_seconds is not None:
            self._set_timer(self._settles(state))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        state = self._load()
        if state is not None and self._settles(state) <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
            yield _row(state, "closed", 0)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        state = {k: initialState[k] for k in STATE_NAMES}
        self._store(state)
        if self.settle_seconds is not None:
            self._set_timer(self._settles(state))

    def close(self) -> None:
        pass


NEEDED = (
    "event_id", "micros", "clock", "fingerprint", "title", "level", "service", "host", "message", "error_code", "trace_id", "labels", "window_seconds", "refire_interval_seconds",
    "suppress_dispatch_while_acknowledged", "allow_reopen_after_resolve",
)


def emits(
    enriched: DataFrame, now_micros: int | Column | None = None, settle_seconds: int | None = None, keep_states: bool = False, initial: DataFrame | None = None, future_seconds: int = FUTURE_SECONDS,
    timed: bool = False,
) -> DataFrame:
    """The change stream of enriched events (a stream, or a table); with the options also rows of the actions ``closed`` and ``state``.

    A stream that has a watermark already (``timed``: of arrival, as ``once`` sets it) keeps it; a stream can't have a second one.
    """
    enriched.sparkSession.streams.active  # noqa: B018  makes the state coordinator in sessions that haven't streamed yet
    src = enriched.withColumn("micros", F.unix_micros("timestamp")).withColumn("clock", event_clock(F.col("micros"), now_micros, future_seconds))
    if settle_seconds is not None and not timed:
        src = src.withColumn("_time", F.timestamp_micros("clock")).withWatermark("_time", "0 seconds")
    src = src.select(*NEEDED)
    mode = "None" if settle_seconds is None else "EventTime"
    start = None if initial is None else initial.select(*STATE_NAMES).groupBy("fingerprint")
    out = src.groupBy("fingerprint").transformWithState(Dedup(settle_seconds, keep_states), OUT, "Append", mode, start)
    out = out.withColumn("id", incident_id(F.col("fingerprint"), F.col("first_micros"), F.col("first_event")))
    out = out.withColumn("first_seen", F.timestamp_micros("first_micros"))
    return out if keep_states else out.drop("first_micros", "first_event", "last_emitted", "step")


def latest_states(changes: DataFrame) -> DataFrame:
    """The state of each fingerprint of a batch after it, from rows of a stream with ``keep_states``; a closed one is gone."""
    rows = changes.select(
        "fingerprint", "title", "service", "host", "error_code", "labels", "trace_id", F.col("first_micros").alias("first_seen"), "first_event", F.unix_micros("last_seen").alias("last_seen"), "last_emitted", "occurrence_count",
        "severity", "sample_message", "window_seconds", (F.col("action") == "closed").alias("_gone"), F.struct((F.col("action") == "closed").alias("last"), "step").alias("_at"),
    )
    rest = [c for c in rows.columns if c not in ("fingerprint", "_at")]
    return rows.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), "_at").alias("r")).select("fingerprint", "r.*")


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Runs a stream over all that is there, a batch at a time, with a function for each batch.

    Every batch opens and commits each partition of the state, with or without rows: there are at most PER_CORE to a core.
    """
    spark, key = stream.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    return query
