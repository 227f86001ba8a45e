"""Event-time dedup of a batch: an inactivity window per fingerprint, and a throttled refire inside it.

For the events of one fingerprint in the order (timestamp, event_id):

* an event is ``new`` if it is the first one, or comes more than the window *of the event before it* after that event;
* else ``update`` if at least its own refire interval has passed since the last new or update, else ``suppress``.

A session (from one ``new`` to the next) may hold most of all events, so no task takes a fingerprint or a session as a whole (see
``actions``). Counts, the worst level, the last trace and the first event are prefixes that partitions of sorted events join up. So is the
refire chain, although each of its links depends on the one before: a partition that lies in one session gives, for every time
that the last event let through before it may have, the time of the last one behind it (see ``_jumps``); that is a step function,
of as many steps as the partition has records of clock less refire interval that lead to different ends.

``sessions`` only numbers sessions: events are compared with the one before inside (key, time slice), slices are stitched by their first
and last events.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import incident_id, rank
from ..model import FUTURE_SECONDS, LEVEL_RANK
from ..session import checkpointed

SLICE_SECONDS = 86_400
SECOND = 1_000_000


def event_clock(micros: Column, now_micros: int | Column | None = None, future_seconds: int = FUTURE_SECONDS) -> Column:
    """Event time; times more than future_seconds after now count as now (without now: event time as it is)."""
    if now_micros is None:
        return micros
    now = now_micros if isinstance(now_micros, Column) else F.lit(now_micros)
    return F.when(micros > now + future_seconds * SECOND, now).otherwise(micros)


def sessions(df: DataFrame, key: list[str], micros: str = "micros", order: str = "event_id", gap: str = "window_seconds", slice_seconds: int = SLICE_SECONDS, clock: str | None = None) -> DataFrame:
    """df with ``session``, a number that grows with time per key; a session ends at a gap over the earlier event's ``gap`` seconds.

    Events are in order of ``micros``; a gap is from there to the next event's ``clock``, where that is another column.
    """
    clock = clock or micros
    slot = F.floor(F.col(micros) / (slice_seconds * SECOND))
    df = df.withColumn("_slot", slot)
    in_slot = Window.partitionBy(*key, "_slot").orderBy(micros, order)
    last, wide = F.lag(micros).over(in_slot), F.lag(gap).over(in_slot)
    df = df.withColumn("_first", last.isNull()).withColumn("_new", F.when(last.isNull(), False).otherwise(F.col(clock) - last > F.greatest(F.lit(1), wide).cast("long") * SECOND))
    df = df.withColumn("_run", F.sum(F.col("_new").cast("long")).over(in_slot.rowsBetween(Window.unboundedPreceding, 0)))
    ends = df.groupBy(*key, "_slot").agg(
        F.min_by(clock, F.struct(micros, order)).alias("_from"), F.max_by(F.struct(F.col(micros).alias("t"), F.col(gap).alias("w")), F.struct(micros, order)).alias("_to"), F.sum(F.col("_new").cast("long")).alias("_n")
    )
    by_slot = Window.partitionBy(*key).orderBy("_slot")
    before = F.lag("_to").over(by_slot)
    opens = F.when(before.isNull(), 1).otherwise((F.col("_from") - before["t"] > F.greatest(F.lit(1), before["w"]).cast("long") * SECOND).cast("int"))
    ends = ends.withColumn("_open", opens)
    ahead = F.sum("_n").over(by_slot) - F.col("_n") + F.sum("_open").over(by_slot)
    ends = ends.select(*key, "_slot", ahead.alias("_base"))
    return df.join(ends, [*key, "_slot"]).withColumn("session", F.col("_base") + F.col("_run")).drop("_slot", "_first", "_new", "_run", "_base")


#: What a row carries of its session so far, besides its place: the first event's columns, the worst level, the last trace.
FIRSTS = ("title", "service", "host", "error_code", "labels", "micros", "event_id", "trace_id")
CARRIED = "first_title string, first_service string, first_host string, first_error_code string, first_labels map<string,string>, first_micros bigint, first_event_id bigint, first_trace_id string, worst string, trace string"
_RANK, _PLACE = 44, 36
_MASK = (1 << _PLACE) - 1


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _fresh(batch: pa.RecordBatch, state: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted events: whether its fingerprint is another one than before, and whether a session begins."""
    fp, micros, clock, window = batch.column("fingerprint"), _numbers(batch, "micros"), _numbers(batch, "clock"), np.maximum(1, _numbers(batch, "window_seconds"))
    other = np.ones(len(fp), dtype=bool)
    other[1:] = pc.not_equal(fp.slice(1), fp.slice(0, len(fp) - 1)).to_numpy(zero_copy_only=False)
    other[0] = state is None or state["fingerprint"] != fp[0].as_py()
    last, wide = np.empty_like(micros), np.empty_like(micros)
    last[1:], wide[1:] = micros[:-1], window[:-1]
    last[0], wide[0] = (0, 0) if state is None else (state["micros"], state["window"])
    return other, other | (clock - last > wide * SECOND)


def _due(clock: np.ndarray, wait: np.ndarray, new: np.ndarray, last: int) -> tuple[np.ndarray, int]:
    """Which events are let through: the first of a session, and those that come their wait or more after the last one let through."""
    out = []
    for t, w, n in zip(clock.tolist(), wait.tolist(), new.tolist(), strict=True):
        due = n or t - last >= w
        if due:
            last = t
        out.append(due)
    return np.array(out, dtype=bool), last


def _advance(batch: pa.RecordBatch, state: dict | None) -> tuple[dict, dict]:
    """(columns of the events: session, place, due and what they carry, the state behind them) for sorted events behind a state.

    The state is that of the session that is open; it stands before the events as one more of its own session.
    """
    other, new = _fresh(batch, state)
    n = len(new)
    clock, wait = _numbers(batch, "clock"), np.maximum(0, _numbers(batch, "refire_interval_seconds")) * SECOND
    due, last = _due(clock, wait, new, 0 if state is None else state["last"])
    run, index = np.cumsum(new), np.arange(1, n + 1)
    begun = np.maximum.accumulate(np.where(new, index, 0))  # the place of the session's first event; 0 is the state
    place = index - begun + np.where(begun > 0, 1, 0 if state is None else state["place"])
    in_fp = np.maximum.accumulate(np.where(other, index, 0))
    session = run - np.where(in_fp > 0, run[in_fp - 1] - 1, 0 if state is None else -state["session"])
    levels = [state["worst"] if state else None, *batch.column("level").to_pylist()]
    ranks = np.array([LEVEL_RANK.get(x, 0) for x in levels], np.int64)
    section = np.concatenate(([0], run)).astype(np.int64)
    worst = _MASK - (np.maximum.accumulate(section << _RANK | ranks << _PLACE | (_MASK - np.arange(n + 1))) & _MASK)
    traces = pa.concat_arrays([pa.array([state["trace"] if state else None], pa.string()), batch.column("trace_id").cast(pa.string())])
    some = pc.fill_null(pc.not_equal(traces, ""), False).to_numpy(zero_copy_only=False)
    said = np.maximum.accumulate(section << _PLACE | np.where(some, np.arange(n + 1) + 1, 0)) & _MASK
    columns = {"session": session, "place": place, "due": due}
    firsts = {}
    for c in FIRSTS:
        given = batch.column(c)
        held = state["first"][c] if state else None
        head = pa.array([list(held.items()) if isinstance(held, dict) else held], given.type)
        firsts[c] = pa.concat_arrays([head, given]).take(pa.array(begun))
        columns[f"first_{c}"] = firsts[c]
    columns["worst"] = pa.array([levels[k] for k in worst[1:].tolist()], pa.string())
    found = traces.take(pa.array(np.maximum(said[1:] - 1, 0)))
    columns["trace"] = pc.if_else(pa.array(said[1:] > 0), found, firsts["trace_id"].cast(pa.string()))
    plain = lambda v: dict(v) if isinstance(v, list) else v
    after = {
        "fingerprint": batch.column("fingerprint")[-1].as_py(), "micros": int(_numbers(batch, "micros")[-1]), "window": max(1, int(batch.column("window_seconds")[-1].as_py())), "last": int(last), "session": int(session[-1]),
        "place": int(place[-1]), "worst": levels[int(worst[-1])], "trace": found[-1].as_py() if said[-1] else None, "first": {c: plain(v[-1].as_py()) for c, v in firsts.items()},
    }
    return columns, after


def _jumps(clock: np.ndarray, wait: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chain of events that lie in one session, as a function of the last one let through before them: (bounds, ends).

    A time up to bounds[i] (and over bounds[i - 1]) leads to ends[i]; one over all bounds stays as it is. An event is due if its clock less
    its wait is at least that time, so the first due one is a record of these differences; from there each event's next one is found
    among those behind it, from the last event to the first.
    """
    least = (clock - wait).tolist()
    end, behind, at = [0] * len(least), [], []  # behind: differences (negative, ascending) that no later one reaches, with their places
    for i in range(len(least) - 1, -1, -1):
        k = bisect.bisect_right(behind, -int(clock[i])) - 1
        end[i] = end[at[k]] if k >= 0 else int(clock[i])
        while behind and -behind[-1] <= least[i]:
            behind.pop()
            at.pop()
        behind.append(-least[i])
        at.append(i)
    # What is left behind the first event, read from it on, are the records.
    bounds, ends = np.array([-x for x in behind[::-1]], np.int64), np.array([end[i] for i in at[::-1]], np.int64)
    keep = np.append(ends[1:] != ends[:-1], True)
    return bounds[keep], ends[keep]


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for a partition: its number and, as JSON, what it makes of the state before it."""
    state, about, parts = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        _, new = _fresh(batch, state)
        if about is None:
            about = {"part": batch.column("_m")[0].as_py() >> 33, "fingerprint": batch.column("fingerprint")[0].as_py(), "clock": int(_numbers(batch, "clock")[0]), "whole": True}
            new = new[1:]
        about["whole"] &= not new.any()
        if about["whole"]:
            parts.append((_numbers(batch, "clock"), np.maximum(0, _numbers(batch, "refire_interval_seconds")) * SECOND))
        else:
            parts = []
        _, state = _advance(batch, state)
    if about is not None:
        if about["whole"]:
            about["bounds"], about["ends"] = (x.tolist() for x in _jumps(*[np.concatenate(x) for x in zip(*parts, strict=True)]))
        yield pa.RecordBatch.from_arrays([pa.array([about["part"]], pa.int64()), pa.array([json.dumps(about | {"state": state})])], ["part", "said"])


def _worse(a: str | None, b: str | None) -> str | None:
    return b if LEVEL_RANK.get(b, 0) > LEVEL_RANK.get(a, 0) else a


def _behind(state: dict | None, said: dict) -> dict:
    """The state behind a partition, from the state before it and its summary, which was made as if a session began with it."""
    own = dict(said["state"])
    known = state is not None and state["fingerprint"] == said["fingerprint"]
    opens = not known or said["clock"] - state["micros"] > state["window"] * SECOND
    if own["fingerprint"] == said["fingerprint"]:
        own["session"] += (state["session"] if known else 0) - (not opens)
    if said["whole"] and not opens:
        k = bisect.bisect_left(said["bounds"], state["last"])
        own |= {"place": own["place"] + state["place"], "first": state["first"], "worst": _worse(state["worst"], own["worst"]), "trace": own["trace"] or state["trace"], "last": said["ends"][k] if k < len(said["bounds"]) else state["last"]}
    return own


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each partition, from the summaries in order."""
    state = None
    for batch in batches:
        before = []
        for said in batch.column("said").to_pylist():
            before.append(None if state is None else json.dumps(state))
            state = _behind(state, json.loads(said))
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(before, pa.string())], ["part", "_before"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        if not batch.num_rows:
            continue
        given = batch.column("_before")[0].as_py()
        state = json.loads(given) if given else state
        got, state = _advance(batch, state)
        action = np.where(got["place"] == 1, "new", np.where(got.pop("due"), "update", "suppress"))
        keep = [c for c in batch.schema.names if c not in ("_m", "_before")]
        arrays = [batch.column(c) for c in keep] + [pa.array(got.pop("session")), pa.array(got.pop("place").astype(np.int32)), pa.array(action.astype(object), pa.string())] + [v.cast(pa.string()) if k == "first_trace_id" else v for k, v in got.items()]
        yield pa.RecordBatch.from_arrays(arrays, [*keep, "session", "place", "action", *got])


def actions(enriched: DataFrame, now_micros: int | Column | None = None, fold_events: int | None = None) -> DataFrame:
    """enriched with micros, clock, session, place (in the session, from 1), action and what the session carries (see CARRIED).

    Events are range-partitioned by (fingerprint, micros, event_id) and kept in the shared folder, so a long session lies in as many partitions as its
    events fill; with fold_events in partitions of about that many. Each partition says what it makes of any state before it; one task reads
    these summaries, a row a partition, in order; then each partition decides its events behind the state that it begins with.
    """
    df = enriched.withColumn("micros", F.unix_micros("timestamp"))
    df = df.withColumn("clock", event_clock(F.col("micros"), now_micros))
    order = ["fingerprint", "micros", "event_id"]
    parts = [] if fold_events is None else [max(1, -(-df.count() // fold_events))]
    kept = checkpointed(df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)).withColumn("_m", F.monotonically_increasing_id())
    summed = kept.select("_m", "fingerprint", "clock", "window_seconds", "refire_interval_seconds", "level", *FIRSTS).mapInArrow(_summary, "part long, said string")
    before = summed.repartition(1).sortWithinPartitions("part").mapInArrow(_stitch, "part long, _before string")
    first = F.when(F.col("_m").bitwiseAND((1 << 33) - 1) == 0, F.shiftright("_m", 33))
    met = kept.withColumn("_part", first).join(F.broadcast(before.withColumnRenamed("part", "_part")), "_part", "left").drop("_part")
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    return met.mapInArrow(_decide, f"{kinds}, session bigint, place int, action string, {CARRIED}")


def emits(acted: DataFrame) -> DataFrame:
    """The change stream: a row in the alert schema for each new and update, with the fields that a session carries along."""
    out = acted.where("action <> 'suppress'")
    return out.select(
        "event_id", "micros", "session", "action", incident_id(F.col("fingerprint"), F.col("first_micros"), F.col("first_event_id")).alias("id"), "fingerprint", F.col("first_title").alias("title"),
        F.col("message").alias("description"), F.col("worst").alias("severity"), F.col("first_service").alias("service"), F.col("first_host").alias("host"),
        F.when(F.col("action") == "new", "open").otherwise("updated").alias("status"), F.col("place").cast("long").alias("occurrence_count"), F.timestamp_micros("first_micros").alias("first_seen"),
        F.col("timestamp").alias("last_seen"), F.col("first_error_code").alias("error_code"), F.col("trace").alias("trace_id"), F.col("first_labels").alias("labels"),
        F.col("message").alias("sample_message"), (F.col("action") == "new").alias("is_new"), "window_seconds", "suppress_dispatch_while_acknowledged", "allow_reopen_after_resolve",
    )


def states(acted: DataFrame) -> DataFrame:
    """The last state of each session: one row per incident of the change stream, suppressed events included."""
    first = lambda c: F.min_by(c, "place").alias(c)
    worst = F.max(F.struct(rank(F.col("level")).alias("r"), (-F.col("place")).alias("p"), F.col("level").alias("level")))["level"]
    trace = F.max_by("trace_id", F.when(F.coalesce("trace_id", F.lit("")) != "", F.col("place")))
    out = acted.groupBy("fingerprint", "session").agg(
        first("title"), first("service"), first("host"), first("error_code"), first("labels"), F.min_by("event_id", "place").alias("first_event"), F.min_by("micros", "place").alias("first_micros"),
        F.max_by("micros", "place").alias("last_micros"), F.count("*").alias("occurrence_count"), worst.alias("severity"), trace.alias("trace_id"), F.max_by("message", "place").alias("sample_message"),
        F.max_by("window_seconds", "place").alias("window_seconds"), F.count_if(F.col("action") != "suppress").alias("n_emits"),
    )
    return out.withColumn("id", incident_id(F.col("fingerprint"), F.col("first_micros"), F.col("first_event")))
