"""Incident, outbox, audit and widget tables, the state of the dedup and running sums: the stream, operators and workers write to them.

All are tables of one store (see ``store``), so incidents and the outbox rows that they cause come together or not at all, and so do the
sums that follow from them. A stream's batch carries its number in the commit, and a batch that is found in the log isn't applied
again; a batch that failed before its log entry leaves folders that nobody reads.

Every write is made from the tables as of the generation that it is committed on, and is made again where another writer was first:
a status isn't set on an incident that was cleared meanwhile, a row that a worker has sent isn't redriven. Results of a delivery
are older than that by nature: they carry the version of the claimed rows, and a row that was cleared, deleted, redriven or claimed
again since then keeps what it has; the audit tells of the delivery in any case.

``totals`` and ``tallies`` are kept by each commit: the changed rows' measures as they were are taken off, as they are now added. Statistics,
services, outbox counts and dispatch counts come from there, however many incidents there are.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ALERT_ROW, DISPATCH, OUTBOX, OUTBOX_OPEN, SEVERE
from ..operators import incidents, outbox, reads
from ..session import checkpointed
from . import dedup
from .store import COMPACT_EVERY, Conflict, Kind, Store

__all__ = ["Conflict", "ReadModel", "Tables"]

WIDGET = "id STRING, title STRING, labels ARRAY<STRUCT<key: STRING, value: STRING>>, status_filter STRING, sort_order INT, created_at TIMESTAMP, updated_at TIMESTAMP"
CLEARED = ("incidents", "outbox", "audit")


def _measures(name: str) -> Column:
    """What a row of a table adds to ``totals``: an array of (kind, name)."""
    one = lambda kind, of: F.struct(F.lit(kind).alias("kind"), of.cast("string").alias("name"))
    if name == "outbox":
        return F.array(one("outbox", F.col("status")))
    if name == "audit":
        return F.array(one("dispatch", F.col("success")))
    severe = F.when(F.col("severity").isin(*SEVERE), "yes").otherwise("no")
    return F.array(one("status", F.col("status")), one("severe", severe), one("service", F.col("service")), one("day", F.to_date("last_seen")))


class Tables(Store):
    KINDS = {
        "incidents": Kind(ALERT_ROW, "id", "fingerprint"),
        "outbox": Kind(OUTBOX, "idempotency_key", "idempotency_key"),
        "audit": Kind(DISPATCH, None, "idempotency_key"),
        "widgets": Kind(WIDGET, "id", "id"),
        "states": Kind(dedup.STATE, "fingerprint", "fingerprint"),
        "totals": Kind("kind STRING, name STRING, n BIGINT", sums=("n",)),
        "tallies": Kind("alert_id STRING, dispatch_ok BIGINT, dispatch_failed BIGINT", by="alert_id", sums=("dispatch_ok", "dispatch_failed")),
    }

    def __init__(self, spark: SparkSession, folder: str, channels: Sequence[str] = ("webhook",), compact_every: int = COMPACT_EVERY, **layout: int) -> None:
        super().__init__(spark, folder, compact_every, **layout)
        self.channels = list(channels)

    def snapshot(self, rows: int) -> tuple[int, DataFrame]:
        """The generation, and the newest incidents as of it: a reader keeps them until the generation changes."""
        now = self.generation()
        return now, reads.snapshot(self.read("incidents", now), rows)

    # Sums

    def follow(self, base: int, wrote: dict[str, str]) -> dict[str, DataFrame]:
        """Deltas of totals and tallies: the written rows' measures, less those of the rows that they replace."""
        parts, more = [], {}
        for name in [n for n in CLEARED if n in wrote]:
            kind, new = self.KINDS[name], self._folders(name, [wrote[name]])
            if kind.key:
                old = self.read(name, base, new).join(new.select(kind.key), kind.key, "left_semi")
                parts.append(old.select(F.inline(_measures(name)), F.lit(-1).alias("n")))
            parts.append(new.where("_gone is not true").select(F.inline(_measures(name)), F.lit(1).alias("n")))
            if name == "audit":
                more["tallies"] = reads.dispatch_counts(new)
        if not parts:
            return more
        deltas = parts[0]
        for p in parts[1:]:
            deltas = deltas.unionByName(p)
        return more | {"totals": deltas.groupBy("kind", "name").agg(F.sum("n").alias("n")).where("n <> 0")}

    def totals(self, at: int | None = None) -> DataFrame:
        return self.read("totals", at)

    def stats(self, at: int | None = None) -> DataFrame:
        """``reads.stats`` of the tables, from their sums. The newest time is looked up among the incidents of the newest day that has any."""
        at = self.generation() if at is None else at
        of = lambda kind, name=None: (F.col("kind") == kind) & (F.lit(True) if name is None else F.col("name") == name)
        n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
        totals = self.totals(at)
        sums = totals.agg(
            n(of("status")).alias("total"), *[n(of("status", s)).alias(f"n_{s}") for s in ("open", "updated", "acknowledged", "resolved")], n(of("severe", "yes")).alias("n_severe"),
            F.count_if(of("service") & F.col("name").isNotNull()).alias("n_services"), n(of("dispatch", "1")).alias("dispatch_ok"), n(of("dispatch", "0")).alias("dispatch_failed"), F.max(F.when(of("day"), F.col("name"))).alias("_day"),
        )
        day = sums.first()["_day"]
        versions = self.rows("incidents", at).where(F.lit(False) if day is None else F.col("last_seen") >= F.lit(day).cast("timestamp"))
        near = checkpointed(versions.select("id", "fingerprint").distinct())
        newest = self.read("incidents", at, near).join(near.select("id"), "id", "left_semi").agg(F.max("last_seen").alias("last_seen"))
        return sums.drop("_day").crossJoin(newest)  # one row each

    def services(self, at: int | None = None) -> DataFrame:
        return self.totals(at).where("kind = 'service'").select(F.col("name").alias("service")).orderBy("service")

    def outbox_counts(self, at: int | None = None) -> DataFrame:
        return self.totals(at).where("kind = 'outbox'").select(F.col("name").alias("status"), "n")

    def outbox_open(self, at: int | None = None) -> DataFrame:
        n = lambda *names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("n"))), F.lit(0))
        return self.outbox_counts(at).agg(n(*OUTBOX_OPEN).alias("n_open"), n("dead").alias("n_dead"))

    def with_dispatch_counts(self, alerts: DataFrame, at: int | None = None) -> DataFrame:
        """Incidents with their dispatch counts, of which only the buckets of these incidents are read."""
        ids = alerts.select(F.col("id").alias("alert_id"))
        counts = self.read("tallies", at, ids).withColumnRenamed("alert_id", "id")
        return alerts.join(counts, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dispatch_ok", "dispatch_failed")})

    # The stream's batches

    def apply(self, emits: DataFrame, batch: int, name: str = "dedup", states: DataFrame | None = None) -> int:
        """One batch: reopen policy, merge into the incidents of its fingerprints, outbox rows of what may be sent; one commit.

        Only the buckets of the batch's fingerprints, and then of its outbox keys, are read. With states also the dedup's state of each
        fingerprint that the batch touched (see ``dedup.latest_states``).
        """
        kept: list[DataFrame] = []

        def change(base: int) -> dict[str, DataFrame]:
            table = self.read("incidents", base, emits.select("fingerprint")).join(emits.select("fingerprint").distinct(), "fingerprint", "left_semi")
            allowed = incidents.reopen_allowed(emits, table).where("reason is null").drop("reason")
            after, stored = incidents.merge_rows(table, allowed)
            rows = outbox.enqueue(stored.where(incidents.should_enqueue()), self.channels, None, F.col("last_seen")).persist()
            kept.append(rows)
            new = outbox.missing(rows, self.read("outbox", base, rows))
            return {"incidents": after, "outbox": new} | ({"states": states} if states is not None else {})

        try:
            return self.commit(change, (name, batch))
        finally:
            for df in kept:
                df.unpersist()

    # Operators' writes

    def _incident(self, alert_id: str, base: int) -> DataFrame:
        return self.read("incidents", base).where(F.col("id") == alert_id)

    def set_status(self, alert_id: str, status: str, now: Column | None = None) -> DataFrame | None:
        """The incident after an operator's action; None if there is none with this id."""
        incidents.check_settable(status)
        found = False

        def change(base: int) -> dict[str, DataFrame]:
            nonlocal found
            own = self._incident(alert_id, base).select("fingerprint").first()
            found = own is not None
            if not found:
                return {}
            near = self.spark.createDataFrame([own], "fingerprint string")
            return {"incidents": incidents.set_status(self.read("incidents", base, near).where(F.col("fingerprint") == own[0]), alert_id, status, now).where(F.col("id") == alert_id)}

        seq = self.commit(change)
        return self._incident(alert_id, seq) if found else None

    def resolve_fingerprint(self, fingerprint: str, now: Column | None = None) -> int:
        """Resolves the active incidents of a fingerprint; how many there were."""
        near, n = self.spark.createDataFrame([(fingerprint,)], "fingerprint string"), 0

        def change(base: int) -> dict[str, DataFrame]:
            nonlocal n
            mine = incidents.active_rows(self.read("incidents", base, near)).where(F.col("fingerprint") == fingerprint)
            n = mine.count()
            return {"incidents": incidents.resolve_fingerprint(mine, fingerprint, now)} if n else {}

        self.commit(change)
        return n

    def clear(self) -> dict[str, int]:
        """Empties incidents, outbox and audit for good, and says how many rows each had."""
        had: dict[str, int] = {}

        def change(base: int) -> dict[str, DataFrame]:
            had.update({name: self.read(name, base).count() for name in CLEARED})
            return {}

        self.commit(change, hide=(*CLEARED, "totals", "tallies"))
        return had

    def claim(self, now: Column, batch: int = outbox.BATCH) -> DataFrame:
        """Claims the due rows that come first, and releases all stale ones; the claimed rows, with the ``_version`` that ``results`` asks for.

        Two workers can't claim the same row: the one that was overtaken chooses again from what the other one left.
        """
        seq = self.commit(lambda base: {"outbox": self._claimed(base, now, batch)})
        return self.current("outbox").where((F.col("_version") == seq) & (F.col("status") == "processing"))

    def _claimed(self, base: int, now: Column, batch: int) -> DataFrame:
        box = self.read("outbox", base)
        picked = outbox.claim(box, now, batch)
        return picked.unionByName(outbox.released(box, now).join(picked.select("idempotency_key"), "idempotency_key", "left_anti"))

    def results(self, done: DataFrame, log: DataFrame) -> int:
        """Outbox rows after delivery and their audit rows, in one commit; of the outbox rows only those that are as they were claimed."""
        if "_version" not in done.columns:
            raise ValueError("rows must carry the _version that they were claimed with")
        return self.commit(lambda base: {"outbox": self.unchanged("outbox", done, base), "audit": log})

    def redrive(self, now: Column, keys: Sequence[str] | None = None, status: str = "dead") -> int:
        n = 0

        def change(base: int) -> dict[str, DataFrame]:
            nonlocal n
            hit = outbox.redrivable(self.read("outbox", base, self._keys(keys)), keys, status)
            n = hit.count()
            return {"outbox": outbox.redrive(hit, now, keys, status)} if n else {}

        self.commit(change)
        return n

    def _keys(self, keys: Sequence[str] | None) -> DataFrame | None:
        return self.spark.createDataFrame([(k,) for k in keys], "idempotency_key string") if keys else None

    def delete_outbox(self, keys: Sequence[str] | None = None, status: str | None = None) -> int:
        if not keys and not status:
            raise ValueError("keys or a status must be given")
        n = 0

        def change(base: int) -> dict[str, DataFrame]:
            nonlocal n
            hit = self.read("outbox", base, self._keys(keys)).where(F.col("idempotency_key").isin(*keys) if keys else F.col("status") == status)
            n = hit.count()
            return {"outbox": hit.select("idempotency_key", F.lit(True).alias("_gone"))} if n else {}

        self.commit(change)
        return n

    def save_widget(self, row: DataFrame, now: Column | None = None) -> None:
        """Inserts or replaces widgets by id; the time of their making stays."""
        reads.check_widget(row)
        at = F.current_timestamp() if now is None else now

        def change(base: int) -> dict[str, DataFrame]:
            old = self.read("widgets", base, row).select("id", F.col("created_at").alias("_made"))
            return {"widgets": row.join(old, "id", "left").withColumns({"created_at": F.coalesce("_made", at), "updated_at": at}).drop("_made")}

        self.commit(change)

    def drop_widget(self, widget_id: str) -> bool:
        found = False

        def change(base: int) -> dict[str, DataFrame]:
            nonlocal found
            hit = self.read("widgets", base).where(F.col("id") == widget_id)
            found = not hit.isEmpty()
            return {"widgets": hit.select("id", F.lit(True).alias("_gone"))} if found else {}

        self.commit(change)
        return found

    def widgets(self) -> DataFrame:
        return reads.widgets(self.read("widgets"))


class ReadModel:
    """The newest incidents, kept until the tables change: at most ``rows`` of them. A check of the generation is a listing
    of the log, and is made once in ``seconds`` at most; ``invalidate`` makes the next read look again at once.

    A new generation is taken over from the rows that its commits changed. Rows beyond the kept ones sort after the last of these, so the
    result is right as long as it doesn't reach past that place; where it would, and after ``clear``, the table is read again.
    """

    def __init__(self, tables: Tables, rows: int = reads.SNAPSHOT_ROWS, seconds: float = 10.0) -> None:
        self.tables, self.rows, self.seconds = tables, rows, seconds
        self._kept: tuple[int, DataFrame] | None = None
        self._full = False  # all incidents are kept
        self._looked: float | None = None
        self.reloads = 0

    def invalidate(self) -> None:
        self._looked = None

    def get(self) -> DataFrame:
        if self._kept and self._looked is not None and time.monotonic() - self._looked < self.seconds:
            return self._kept[1]
        now = self.tables.generation()
        if not self._kept or self._kept[0] != now:
            df = self._taken_over(now)
            if df is None:
                df = checkpointed(reads.snapshot(self.tables.read("incidents", now), self.rows))
                self._full = df.count() < self.rows
                self.reloads += 1
            self._kept = now, df
        self._looked = time.monotonic()
        return self._kept[1]

    def _taken_over(self, now: int) -> DataFrame | None:
        """The kept rows with the changes since; None where the table must be read."""
        if not self._kept:
            return None
        since, old = self._kept
        changed = self.tables.changes("incidents", since, now)
        if changed is None:
            return None
        changed = checkpointed(changed)
        rest = old.join(changed.select("id"), "id", "left_anti").select(old.columns)
        both = rest.unionByName(changed.where("_gone is not true").drop("_gone").select(old.columns))
        if self._full:
            got = checkpointed(reads.snapshot(both, self.rows))
            self._full = both.count() <= self.rows
            return got
        last_place = [F.asc("last_seen"), F.desc("id")]
        edge = old.orderBy(*last_place).select("last_seen", "id").first()
        got = checkpointed(reads.snapshot(both, self.rows))
        last = got.orderBy(*last_place).select("last_seen", "id").first() if got.count() == self.rows else None
        sure = last is not None and (last.last_seen > edge.last_seen or (last.last_seen == edge.last_seen and last.id <= edge.id))
        return got if sure else None

    def page(self, page: int = 1, page_size: int = 25, **filters) -> DataFrame:
        return reads.alerts_page(self.get(), page, page_size, self.rows, **filters)

    def about(self) -> dict[str, float | int | None]:
        """The generation that is kept, its rows, and seconds since the last look."""
        if not self._kept:
            return {"generation": None, "rows": 0, "age": None}
        return {"generation": self._kept[0], "rows": self._kept[1].count(), "age": None if self._looked is None else time.monotonic() - self._looked}
