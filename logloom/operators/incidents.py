"""The incident table: merging of the change stream, status lifecycle, and the checks around them.

Tables are DataFrames in, DataFrames out; ``logloom.streaming`` and callers write them as versions. One active row per fingerprint
is an invariant of ``merge``, which applies the emits of a fingerprint in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seconds_between
from ..model import ACTIVE, ALERT_ROW, SETTABLE

ROW = ALERT_ROW.lower()
COLUMNS = [x.split(" ")[0] for x in ROW.split(", ") if " " in x]
#: A slice of the first column of an order (microseconds: an hour).
SLICE = 3_600_000_000


def _of_schema(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) for c in COLUMNS])


def merge(table: DataFrame | None, emits: DataFrame, order: tuple[str, ...] = ("micros", "event_id")) -> tuple[DataFrame, DataFrame]:
    """(the table after the emits, the emits as stored: with the id, count and is_new that they have after the merge)."""
    table = _of_schema(table) if table is not None else emits.sparkSession.createDataFrame([], ROW)
    rows, stored = merge_rows(table, emits, order)
    touched = active_rows(table).join(emits.select("fingerprint"), "fingerprint", "left_semi").select("id")
    return table.join(touched, "id", "left_anti").unionByName(rows), stored


def merge_rows(table: DataFrame, emits: DataFrame, order: tuple[str, ...] = ("micros", "event_id")) -> tuple[DataFrame, DataFrame]:
    """(the rows of the table that the emits change or add, the emits as stored).

    An emit without an active row is inserted (with an id of its own if the table holds its id already); others are merged.

    A merge sets the count to n, or to one more than it was if the emit is new or n isn't larger: max(n, count + 1). After the
    k-th emit it is therefore k + max(count before, largest n_j - j so far), a running maximum: nothing is gathered per fingerprint.
    Places and maxima are taken inside (fingerprint, slice of time), and slices are joined up by their sums, so that a storm of one
    fingerprint isn't one task's work.
    """
    table = _of_schema(table)
    active = table.where(F.col("status").isin(*ACTIVE)).select("fingerprint", F.struct(*COLUMNS).alias("_row"))
    slot = ["fingerprint", "_slot"]
    in_slot, place = Window.partitionBy(*slot).orderBy(*order), F.struct(*order)
    e = emits.withColumn("_slot", F.floor(F.col(order[0]) / SLICE)).withColumn("_j", F.row_number().over(in_slot).cast("long"))
    given = F.col("occurrence_count").cast("long")
    e = e.withColumn("_ahead", F.max(F.when(~F.col("is_new"), given - F.col("_j"))).over(in_slot))
    first = F.min_by(F.struct(F.col("id").alias("id"), given.alias("n")), place)
    slots = e.groupBy(*slot).agg(F.count("*").alias("_n"), F.max("_ahead").alias("_most"), first.alias("_one"))
    by_slot = Window.partitionBy("fingerprint").orderBy("_slot")
    slots = slots.withColumns({"_base": F.sum("_n").over(by_slot) - F.col("_n"), "_one": F.first("_one").over(by_slot)})
    slots = slots.withColumn("_past", F.max(F.col("_most") - F.col("_base")).over(by_slot.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.join(slots.select(*slot, "_base", "_past", "_one"), slot).join(active, "fingerprint", "left")
    alone = F.col("_row").isNull()
    e = e.withColumns({"_k": F.col("_base") + F.col("_j"), "_first": F.col("_one.id")})
    k, inserted = F.col("_k"), alone & (F.col("_k") == 1)
    ahead = F.greatest(F.col("_ahead") - F.col("_base"), F.col("_past"), F.when(alone, F.col("_one.n") - 1), F.col("_row.occurrence_count"))
    e = e.withColumn("_count", k + ahead)
    e = e.join(table.select(F.col("id").alias("_first"), F.lit(True).alias("_taken")), "_first", "left")
    again = F.concat(F.substring(F.sha2(F.concat(F.col("_first"), F.lit("|again")), 256), 1, 8), F.substring("_first", 9, 28))
    status = F.when(F.col("_row.status") == "acknowledged", "acknowledged").when(inserted, "open").otherwise("updated")
    e = e.withColumns({"_id": F.coalesce("_row.id", F.when(F.col("_taken"), again), "_first"), "_status": status})
    kept = [c for c in emits.columns if c not in ("id", "occurrence_count", "is_new", "status")]
    stored = e.select(*kept, F.col("_id").alias("id"), F.col("_count").alias("occurrence_count"), inserted.alias("is_new"), F.col("_status").alias("status"))

    said = lambda c: F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", k))
    lasting = ["title", "description", "service", "host", "first_seen", "error_code", "labels", "trace_id", "sample_message"]
    g = e.groupBy("fingerprint").agg(
        F.max_by("_row", "_k").alias("row"), F.max_by("_id", "_k").alias("id"), F.min_by(F.struct(*lasting, "last_seen"), "_k").alias("a"),
        F.max_by(F.struct("last_seen", "severity", "_count", "_status"), "_k").alias("z"), said("trace_id").alias("trace"), said("sample_message").alias("sample"),
    )
    old = F.col("row").isNotNull()
    value = {c: F.when(old, F.col(f"row.{c}")).otherwise(F.col(f"a.{c}")) for c in lasting}
    value |= {c: F.col(f"row.{c}") for c in ("acknowledged_at", "resolved_at", "tta_seconds", "ttr_seconds")}
    value |= {
        "id": F.col("id"), "fingerprint": F.col("fingerprint"), "severity": F.col("z.severity"), "status": F.col("z._status"), "occurrence_count": F.col("z._count"), "last_seen": F.col("z.last_seen"),
        "updated_at": F.col("z.last_seen"), "created_at": F.when(old, F.col("row.created_at")).otherwise(F.col("a.last_seen")),
        "trace_id": F.coalesce("trace", value["trace_id"]), "sample_message": F.coalesce("sample", value["sample_message"]),
    }
    return g.select(*[value[c].alias(c) for c in COLUMNS]), stored


def reopen_allowed(emits: DataFrame, table: DataFrame) -> DataFrame:
    """emits with ``reason``: reopen_disallowed where the policy forbids it, nothing is active and something is resolved."""
    active = table.where(F.col("status").isin(*ACTIVE)).select("fingerprint").distinct().withColumn("_active", F.lit(True))
    done = table.where("status = 'resolved'").select("fingerprint").distinct().withColumn("_done", F.lit(True))
    out = emits.join(active, "fingerprint", "left").join(done, "fingerprint", "left")
    stop = ~F.col("allow_reopen_after_resolve") & F.col("_active").isNull() & F.col("_done").isNotNull()
    return out.withColumn("reason", F.when(stop, "reopen_disallowed")).drop("_active", "_done")


def should_enqueue() -> Column:
    """After the merge: not for repeated emits of an acknowledged incident whose policy silences them."""
    return ~(~F.col("is_new") & F.col("suppress_dispatch_while_acknowledged") & (F.col("status") == "acknowledged"))


def with_status(table: DataFrame, new: Column, now: Column, when: Column | None = None) -> DataFrame:
    """table after setting status new at now, with the times to acknowledge and to resolve that follow; only rows where ``when``."""
    when = F.lit(True) if when is None else when
    prev = F.col("status")
    ack = (new == "acknowledged") & prev.isin("open", "updated")
    resolve = (new == "resolved") & (prev != "resolved")
    unack = (new == "open") & (prev == "acknowledged")
    reopen = new.isin("open", "updated") & (prev == "resolved")
    since = seconds_between(F.col("first_seen"), now)
    silent = resolve & F.col("acknowledged_at").isNull()
    wipe_ack = unack | reopen
    changed = {
        "acknowledged_at": F.when(ack | silent, now).when(wipe_ack, None).otherwise(F.col("acknowledged_at")),
        "tta_seconds": F.when(ack | silent, since).when(wipe_ack, None).otherwise(F.col("tta_seconds")),
        "resolved_at": F.when(resolve, now).when(reopen, None).otherwise(F.col("resolved_at")),
        "ttr_seconds": F.when(resolve, since).when(reopen, None).otherwise(F.col("ttr_seconds")),
        "status": new, "updated_at": now,
    }
    return table.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in changed.items()})


def check_settable(status: str) -> None:
    if status not in SETTABLE:
        raise ValueError(f"status must be one of {', '.join(SETTABLE)}")


def set_status(table: DataFrame, alert_id: str, status: str, now: Column | None = None) -> DataFrame:
    """An operator's action on one incident; ValueError for statuses that operators can't set, or a second active row."""
    check_settable(status)
    if status in ACTIVE:
        one = table.where(F.col("id") == alert_id).select("fingerprint", F.col("id").alias("_own"))
        rival = table.where(F.col("status").isin(*ACTIVE)).join(one, "fingerprint").where("id <> _own")
        if not rival.isEmpty():
            raise ValueError("another incident of this fingerprint is active")
    return with_status(table, F.lit(status), F.current_timestamp() if now is None else now, F.col("id") == alert_id)


def resolve_fingerprint(table: DataFrame, fingerprint: str, now: Column | None = None) -> DataFrame:
    return with_status(table, F.lit("resolved"), F.current_timestamp() if now is None else now, (F.col("fingerprint") == fingerprint) & F.col("status").isin(*ACTIVE))


def active_rows(table: DataFrame) -> DataFrame:
    return table.where(F.col("status").isin(*ACTIVE))
