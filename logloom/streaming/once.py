"""Entries of a stream without repeats, whatever their age: a map of what has been seen, with a time to live.

Entries are keyed by some of their columns and the minute of their time, so a service that sends most of them is many keys; a key's
map holds a digest for each different entry. A map lives for ``ttl_seconds`` after the last arrival of one of its entries, whatever their own
times: an entry that is hours late is as new as any other, and a repeat is one if it comes within that time. The stream's time is a
watermark on the time of arrival, of which no row can be late. (State with a time to live of Spark's own wants the mode of processing
time, in which a stream without new data runs one empty batch after another and never ends.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS, SLOT_SECONDS = 86_400, 60


class Once(StatefulProcessor):
    def __init__(self, columns: Sequence[str], ttl_seconds: int) -> None:
        self.columns, self.ttl_ms = list(columns), ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "digest string", "times bigint")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        here, arrived = set(), 0
        for r in rows:
            digest, arrived = r["_digest"], max(arrived, r["_arrived"])
            if digest in here:
                continue
            here.add(digest)
            if not self.seen.containsKey((digest,)):
                self.seen.updateValue((digest,), (1,))
                yield Row(**{c: r[c] for c in self.columns})
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(arrived + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def once(entries: DataFrame, keys: Sequence[str], by: Sequence[str] = ("service",), time: str = "timestamp", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The first of each of the entries that are equal in keys; ``by`` and ``time`` must follow from keys."""
    entries.sparkSession.streams.active  # noqa: B018  makes the state coordinator in sessions that haven't streamed yet
    columns = entries.columns
    part = lambda c: F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    digest = F.sha2(F.concat(*[part(F.col(k).cast("string")) for k in keys]), 256)
    slot = F.floor(F.unix_seconds(F.col(time)) / SLOT_SECONDS)
    src = entries.withColumn("_now", F.current_timestamp()).withWatermark("_now", "0 seconds")
    src = src.select(*columns, digest.alias("_digest"), F.coalesce(slot, F.lit(0)).alias("_slot"), F.unix_millis("_now").alias("_arrived"))
    return src.groupBy(*by, "_slot").transformWithState(Once(columns, ttl_seconds), entries.schema, "Append", "EventTime")
