"""Log, incident, dispatch and outbox views over the ``events`` table, and the same ones as DuckDB SQL.

Operators' facts that the table doesn't have (statuses, deliveries) follow from event numbers, so both engines know them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import idempotency_key, level
from ..model import OUTBOX_STATUSES
from ..operators import dedup, policy

#: Services and codes that the shipped policy names.
SERVICES = ("payments-api", "checkout", "inventory", "auth-service")
CODES = ("DB_CONN", "GW_TIMEOUT", "NPE", "RATE_LIMIT", "DISK_FULL", None)
TEXTS = ("Replica lags behind its leader", "Job timed out after 9 tries", "Checksum of the upload differs", "Certificate expires today", "Queue is longer than its limit")
LEVELS = {"error": "ERROR", "purchase": "fatal", "signup": "warning", "click": "info", "view": "debug"}
COARSE = ["service", "level"]
STATUS = ("open", "updated", "acknowledged", "resolved")
CHANNELS = ("webhook", "card")


def one_of(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def logs_of(e: DataFrame) -> DataFrame:
    raw = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("event_type"))
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), raw.alias("raw_level"), level(raw).alias("level"), one_of(SERVICES, F.col("user_id")).alias("service"),
        F.concat(F.lit("pod-"), (F.col("user_id") % 3).cast("string")).alias("host"), one_of(CODES, F.col("event_id")).alias("error_code"),
        F.concat(one_of(TEXTS, F.col("event_id")), F.lit(" req_id="), F.col("event_id").cast("string")).alias("message"), F.concat(F.lit("t-"), F.col("event_id").cast("string")).alias("trace_id"),
        F.create_map(F.lit("env"), F.when(F.col("user_id") % 2 == 0, "prod").otherwise("staging"), F.lit("Team"), F.lit("platform")).alias("labels"),
    )


def enriched(spark: SparkSession, sf_dir: str, fields: list[str] | None = None) -> DataFrame:
    return policy.enrich(logs(spark, sf_dir), fields=fields)


def acted(spark: SparkSession, sf_dir: str, fields: list[str] | None = None) -> DataFrame:
    return dedup.actions(enriched(spark, sf_dir, fields))


def emits(spark: SparkSession, sf_dir: str, fields: list[str] | None = None) -> DataFrame:
    return dedup.emits(acted(spark, sf_dir, fields))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incident per session of the coarse keys, with a status that its first event's number says."""
    out = dedup.states(acted(spark, sf_dir, COARSE)).withColumn("status", one_of(STATUS, F.col("first_event")))
    return out.withColumns({"first_seen": F.timestamp_micros("first_micros"), "last_seen": F.timestamp_micros("last_micros"), "description": F.col("sample_message"), "is_new": F.col("n_emits") == 1})


def deliveries(spark: SparkSession, sf_dir: str, given: DataFrame | None = None) -> DataFrame:
    """Dispatch audit: each emit (given, or the coarse ones) to each channel; every seventh event's delivery fails."""
    e = (emits(spark, sf_dir, COARSE) if given is None else given).select("id", "event_id", "micros", "occurrence_count")
    e = e.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    return e.select(
        F.col("id").alias("alert_id"), "channel", (F.col("event_id") % 7 != 0).cast("int").alias("success"), idempotency_key(F.col("id"), F.col("channel"), F.col("occurrence_count")).alias("idempotency_key"),
        F.timestamp_micros(F.col("micros") + (F.col("event_id") % 5) * 1_000_000).alias("created_at"),
    )


def box(spark: SparkSession, sf_dir: str, given: DataFrame | None = None) -> DataFrame:
    """Outbox rows of the emits (given, or the coarse ones), with statuses, attempts and times that event numbers say."""
    e = emits(spark, sf_dir, COARSE) if given is None else given
    e = e.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    at = lambda k: F.timestamp_micros(F.col("micros") + (F.col("event_id") % k) * 1_000_000)
    return e.select(
        idempotency_key(F.col("id"), F.col("channel"), F.col("occurrence_count")).alias("idempotency_key"), F.col("id").alias("alert_id"), "channel", F.lit("{}").alias("payload_json"),
        one_of(OUTBOX_STATUSES, F.col("event_id")).alias("status"), (F.col("event_id") % 9).cast("int").alias("attempts"), at(3600).alias("next_attempt_at"), F.lit("e").alias("last_error"), at(1).alias("created_at"), at(7200).alias("updated_at"),
    )


#: A time inside the data at which claims are made.
NOW = "2024-01-20 00:00:00"
NOW_MICROS = 1_705_708_800_000_000


#: The clock of an event where times far after NOW count as NOW.
CLAMPED = f"(CASE WHEN {{0}} > {NOW_MICROS} + 300000000 THEN {NOW_MICROS} ELSE {{0}} END)"


def now() -> Column:
    return F.timestamp_micros(F.lit(NOW_MICROS))


# The same as SQL.


def _case(by: str, values: tuple) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


LOGS = f"""logs AS (SELECT event_id, epoch_us(ts) AS micros, ts,
  CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items())} END AS raw_level,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'CRITICAL' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END AS level,
  {_case('user_id', SERVICES)} AS service, 'pod-' || (user_id % 3) AS host, {_case('event_id', CODES)} AS error_code,
  {_case('event_id', TEXTS)} || ' req_id=' || event_id AS message, 't-' || event_id AS trace_id,
  CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS env
  FROM events)"""

POLICY = """resolved AS (SELECT *,
  CASE service WHEN 'inventory' THEN 'CRITICAL' ELSE 'ERROR' END AS min_level,
  COALESCE(CASE error_code WHEN 'DB_CONN' THEN 900 WHEN 'RATE_LIMIT' THEN 120 END, CASE service WHEN 'payments-api' THEN 600 WHEN 'checkout' THEN 180 WHEN 'inventory' THEN 900 END, 300) AS w,
  COALESCE(CASE error_code WHEN 'DB_CONN' THEN 180 WHEN 'RATE_LIMIT' THEN 60 END, CASE service WHEN 'payments-api' THEN 120 WHEN 'checkout' THEN 30 WHEN 'inventory' THEN 300 END, 60) AS r,
  CASE level WHEN 'DEBUG' THEN 10 WHEN 'INFO' THEN 20 WHEN 'WARN' THEN 30 WHEN 'ERROR' THEN 40 ELSE 50 END AS lr
  FROM logs)"""

MESSAGE = r"substr(regexp_replace(lower(regexp_replace(trim(message), '(?i)\b(?:req(?:uest)?(?:[_-]?id)?|requestid|trace[_-]?id|span[_-]?id)\s*[=:]\s*[A-Za-z0-9._:-]+\b', '<req>', 'g')), '\s+', ' ', 'g'), 1, 500)"
MATERIAL = {
    "default": f"'service=' || service || '|level=' || level || '|labels={{env=' || env || '|team=platform}}|message=' || {MESSAGE}",
    "coarse": "'service=' || service || '|level=' || level",
    "service": "'service=' || service",
    "label": f"'label.env=' || env || '|message=' || {MESSAGE} || '|error_code=' || lower(COALESCE(error_code, '')) || '|host=' || host || '|unknown.team='",
}
TITLE = "'[' || service || '] ' || CASE WHEN COALESCE(error_code, '') <> '' THEN error_code || ': ' || substr(message, 1, 120) ELSE substr(message, 1, 140) END"


def gated(fields: str = "default") -> str:
    """resolved rows that pass the gate, with fingerprint, title and place per fingerprint."""
    return f"""{LOGS}, {POLICY}, g AS (SELECT *, substr(sha256({MATERIAL[fields]}), 1, 32) AS fingerprint, {TITLE} AS title FROM resolved
  WHERE lr >= CASE min_level WHEN 'CRITICAL' THEN 50 ELSE 40 END),
  o AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY micros, event_id) AS rn FROM g)"""


def chain(fields: str = "default", clock: str = "{}") -> str:
    """a: gated rows with action, session and place in the session; clock: what counts as the time of an event, of its micros."""
    t, first = clock.format("o.micros"), clock.format("micros")
    return f"""{gated(fields)}, c AS (
  SELECT fingerprint, rn, micros, w, {first} AS last_emitted, 'new' AS action, 0 AS s, 1 AS place FROM o WHERE rn = 1
  UNION ALL
  SELECT o.fingerprint, o.rn, o.micros, o.w,
    CASE WHEN {t} - c.micros > c.w * 1000000 OR {t} - c.last_emitted >= o.r * 1000000 THEN {t} ELSE c.last_emitted END,
    CASE WHEN {t} - c.micros > c.w * 1000000 THEN 'new' WHEN {t} - c.last_emitted < o.r * 1000000 THEN 'suppress' ELSE 'update' END,
    CASE WHEN {t} - c.micros > c.w * 1000000 THEN c.s + 1 ELSE c.s END,
    CASE WHEN {t} - c.micros > c.w * 1000000 THEN 1 ELSE c.place + 1 END
  FROM c JOIN o ON o.fingerprint = c.fingerprint AND o.rn = c.rn + 1),
  a AS (SELECT o.*, c.action, c.s, c.place FROM o JOIN c USING (fingerprint, rn))"""


def uuid(*parts: str) -> str:
    h = f"sha256({' || chr(124) || '.join(parts)})"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


NAME = "CASE max(lr) OVER run WHEN 50 THEN 'CRITICAL' WHEN 40 THEN 'ERROR' WHEN 30 THEN 'WARN' WHEN 20 THEN 'INFO' ELSE 'DEBUG' END"


def emitted(fields: str = "default") -> str:
    return f"""{chain(fields)}, x AS (SELECT *, first(micros) OVER run AS first_micros, first(event_id) OVER run AS first_event, first(title) OVER run AS first_title, first(error_code) OVER run AS first_code,
  first(host) OVER run AS first_host, {NAME} AS severity FROM a WINDOW run AS (PARTITION BY fingerprint, s ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  em AS (SELECT *, {uuid('fingerprint', 'first_micros', 'first_event')} AS id FROM x WHERE action <> 'suppress')"""


ALERTS = f"""{chain('coarse')}, st AS (SELECT fingerprint, s, arg_min(title, place) AS title, arg_min(service, place) AS service, arg_min(host, place) AS host,
  first(error_code ORDER BY place) AS error_code, arg_min(env, place) AS env, arg_min(event_id, place) AS first_event, arg_min(micros, place) AS first_micros, arg_max(micros, place) AS last_micros, count(*) AS occurrence_count, max(lr) AS top,
  arg_max(trace_id, place) AS trace_id, arg_max(message, place) AS sample_message, arg_max(w, place) AS window_seconds, count(*) FILTER (action <> 'suppress') AS n_emits FROM a GROUP BY fingerprint, s),
  alerts AS (SELECT *, CASE top WHEN 50 THEN 'CRITICAL' ELSE 'ERROR' END AS severity, {_case('first_event', STATUS)} AS status, {uuid('fingerprint', 'first_micros', 'first_event')} AS id FROM st)"""

DELIVERIES = f"""{emitted('coarse')}, del AS (SELECT id AS alert_id, channel, CASE WHEN event_id % 7 <> 0 THEN 1 ELSE 0 END AS success, id || ':' || channel || ':' || place AS idempotency_key,
  micros + (event_id % 5) * 1000000 AS created_micros FROM em, (VALUES ('webhook'), ('card')) v(channel))"""

BOX = f"""{emitted('coarse')}, box AS (SELECT id || ':' || channel || ':' || place AS idempotency_key, id AS alert_id, channel, {_case('event_id', OUTBOX_STATUSES)} AS status, CAST(event_id % 9 AS INT) AS attempts,
  micros + (event_id % 3600) * 1000000 AS next_micros, micros + (event_id % 7200) * 1000000 AS updated_micros FROM em, (VALUES ('webhook'), ('card')) v(channel))"""
