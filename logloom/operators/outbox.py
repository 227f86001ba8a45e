"""The notification outbox and the dispatch audit: enqueue, claim, results, redrive, delete."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import backoff_seconds, idempotency_key
from ..model import CLAIMABLE, OUTBOX_OPEN, REDRIVABLE
from ..session import checkpointed

MAX_ATTEMPTS, BATCH, STALE_SECONDS, BACKOFF_BASE, BACKOFF_CAP = 8, 50, 120, 2.0, 300.0


def later(at: Column, seconds: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + ((seconds if isinstance(seconds, Column) else F.lit(seconds)) * 1_000_000).cast("long"))


def enqueue(emits: DataFrame, channels: Sequence[str], outbox: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """New rows: one for each emit and channel whose idempotency key is neither in the outbox nor twice among the new ones."""
    now = F.current_timestamp() if now is None else now
    fanned = emits.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    rows = fanned.select(
        idempotency_key(F.col("id"), F.col("channel"), F.col("occurrence_count")).alias("idempotency_key"), F.col("id").alias("alert_id"), "channel", F.to_json(F.struct("*")).alias("payload_json"),
        F.lit("pending").alias("status"), F.lit(0).alias("attempts"), now.alias("next_attempt_at"), F.lit(None).cast("string").alias("last_error"), now.alias("created_at"), now.alias("updated_at"),
    ).dropDuplicates(["idempotency_key"])
    return rows if outbox is None else missing(rows, outbox)


def missing(rows: DataFrame, outbox: DataFrame) -> DataFrame:
    """The rows whose key the outbox doesn't have."""
    return rows.join(outbox.select("idempotency_key"), "idempotency_key", "left_anti")


def due(now: Column) -> Column:
    return F.col("status").isin(*CLAIMABLE) & (F.col("next_attempt_at") <= now)


def release_stale(outbox: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Rows in processing for longer than seconds are pending again."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < later(now, -seconds))
    return outbox.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "next_attempt_at": F.when(stale, now).otherwise(F.col("next_attempt_at")), "updated_at": F.when(stale, now).otherwise(F.col("updated_at"))})


def claim(outbox: DataFrame, now: Column, batch: int = BATCH, key: str = "idempotency_key") -> DataFrame:
    """The batch of due rows that come first by (next_attempt_at, key), as processing and with one more attempt."""
    picked = release_stale(outbox, now).where(due(now)).orderBy("next_attempt_at", key).limit(batch)
    return picked.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "updated_at": now})


def released(outbox: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """The stale rows alone, pending again: all of them, whether or not the next claim takes them."""
    return release_stale(outbox.where((F.col("status") == "processing") & (F.col("updated_at") < later(now, -seconds))), now, seconds)


def apply_rows(outbox: DataFrame, changed: DataFrame, key: str = "idempotency_key") -> DataFrame:
    return outbox.join(changed.select(key), key, "left_anti").unionByName(changed)


def mark(claimed: DataFrame, success: Column, error: Column, now: Column, max_attempts: int = MAX_ATTEMPTS, base: float = BACKOFF_BASE, cap: float = BACKOFF_CAP) -> DataFrame:
    """claimed rows after delivery: sent; dead after max_attempts; else failed, to be tried again after a growing pause."""
    status = F.when(success, "sent").when(F.col("attempts") >= max_attempts, "dead").otherwise("failed")
    pause = later(now, backoff_seconds(F.col("attempts"), base, cap))
    return claimed.withColumns({
        "status": status, "last_error": F.when(success, None).otherwise(F.coalesce(error, F.lit("dispatch failed"))),
        "next_attempt_at": F.when(status == "failed", pause).otherwise(F.col("next_attempt_at")), "updated_at": now,
    })


def already_sent(claimed: DataFrame, audit: DataFrame) -> DataFrame:
    """claimed rows whose key has a successful dispatch."""
    return claimed.join(audit.where("success = 1").select("idempotency_key").distinct(), "idempotency_key", "left_semi")


def _redriven(keys: Sequence[str] | None, status: str, key: str) -> Column:
    return F.col(key).isin(*keys) & F.col("status").isin(*REDRIVABLE) if keys else F.col("status") == status


def redrivable(outbox: DataFrame, keys: Sequence[str] | None = None, status: str = "dead", key: str = "idempotency_key") -> DataFrame:
    """The rows that ``redrive`` changes."""
    return outbox.where(_redriven(keys, status, key))


def redrive(outbox: DataFrame, now: Column, keys: Sequence[str] | None = None, status: str = "dead", key: str = "idempotency_key") -> DataFrame:
    """Given keys (if dead or failed), or all rows of a status, are pending again with no attempts and no error."""
    hit = _redriven(keys, status, key)
    new = {"status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string"), "next_attempt_at": now, "updated_at": now}
    return outbox.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def delete(outbox: DataFrame, keys: Sequence[str] | None = None, status: str | None = None, key: str = "idempotency_key") -> DataFrame:
    """Without the given keys (whatever their status), or without the rows of a status."""
    return outbox.where(~F.col(key).isin(*keys)) if keys else outbox.where(F.col("status") != status)


def counts(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("status").agg(F.count("*").alias("n"))


def open_count(outbox: DataFrame) -> DataFrame:
    return outbox.agg(F.count_if(F.col("status").isin(*OUTBOX_OPEN)).alias("n_open"), F.count_if(F.col("status") == "dead").alias("n_dead"))


def listing(outbox: DataFrame, status: str | None = "dead", limit: int = 100, offset: int = 0, key: str = "idempotency_key") -> DataFrame:
    rows = outbox if status in (None, "", "all", "*") else outbox.where(F.col("status") == status)
    return rows.orderBy(F.desc("updated_at"), F.desc(key)).offset(max(0, offset)).limit(min(500, max(1, limit)))


def audit_row() -> list[Column]:
    """Columns of the dispatch audit with the lengths it keeps; empty texts are null."""
    cut = lambda c, n: F.nullif(F.substring(c, 1, n), F.lit("")).alias(c)
    return [cut("response_body", 4000), cut("error_message", 2000)]


Send = Callable[[dict], dict]


def deliver(claimed: DataFrame, audit: DataFrame, senders: dict[str, Send], now: Column, **limits) -> tuple[DataFrame, DataFrame]:
    """(claimed rows after delivery, new audit rows): rows sent before are marked sent without another delivery.

    A sender gets a row as a dict and returns success, status_code, response_body and error_message; senders run on the executors.
    """
    names = claimed.columns

    def send(batches: Iterator) -> Iterator:
        for pdf in batches:
            results = []
            for row in pdf.to_dict("records"):
                sender = senders.get(row["channel"])
                try:
                    got = sender(row) if sender else {"success": False, "error_message": f"unknown channel: {row['channel']}"}
                except Exception as e:  # a sender's failure is a result
                    got = {"success": False, "error_message": str(e)}
                results.append({"idempotency_key": row["idempotency_key"], "success": int(bool(got.get("success"))), "status_code": got.get("status_code"), "response_body": got.get("response_body"), "error_message": got.get("error_message")})
            yield type(pdf)(results, columns=["idempotency_key", "success", "status_code", "response_body", "error_message"])

    sent = already_sent(claimed, audit)
    todo = claimed.join(sent.select("idempotency_key"), "idempotency_key", "left_anti")
    # Kept, so that nothing is sent again when the result is read twice.
    got = checkpointed(todo.mapInPandas(send, "idempotency_key string, success int, status_code int, response_body string, error_message string"))
    done = mark(todo.join(got, "idempotency_key"), F.col("success") == 1, F.col("error_message"), now, **limits).select(*names)
    skipped = mark(sent, F.lit(True), F.lit(None).cast("string"), now, **limits).select(*names)
    log = todo.join(got, "idempotency_key").select("alert_id", "channel", "success", "status_code", *audit_row(), "idempotency_key", now.alias("created_at"))
    return done.unionByName(skipped), log
