"""The registered queries of the engine and DuckDB SQL with the same results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import channels, dedup, external, incidents, metrics, outbox, parse, policy, reads, search
from ..session import checkpointed, shared_folder
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def _micros(name: str, into: str | None = None):
    return F.unix_micros(name).alias(into or name)


# Parsing


@query(f"WITH {V.LOGS} SELECT raw_level, level, count(*) AS n FROM logs GROUP BY ALL")
def parse_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.logs(spark, sf_dir).groupBy("raw_level", "level").agg(F.count("*").alias("n"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts under three sets of names, with some that can't be used."""
    e = V.logs(spark, sf_dir).withColumn("micros", F.unix_micros("timestamp"))
    env = F.col("labels")["env"]
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    one = F.struct(iso.alias("timestamp"), F.col("raw_level").alias("level"), "service", "host", "message", "error_code", "trace_id", F.struct(env.alias("env")).alias("labels"))
    two = F.struct(F.floor(F.col("micros") / 1_000_000).alias("time"), F.lit("").alias("level"), F.col("raw_level").alias("severity"), F.col("service").alias("app"), F.col("host").alias("pod"), F.col("message").alias("msg"), F.lit(0).alias("code"), F.lit("no object").alias("labels"))
    three = F.struct(F.floor(F.col("micros") / 1000).alias("@timestamp"), F.lit(None).cast("string").alias("level"), F.col("raw_level").alias("log_level"), F.struct("service", env.alias("env"), (F.col("event_id") % 2 == 0).alias("flag")).alias("labels"), F.lit(False).alias("message"), F.col("message").alias("text"), F.col("trace_id").alias("traceId"))
    good = F.when(F.col("event_id") % 3 == 0, F.to_json(one)).when(F.col("event_id") % 3 == 1, F.to_json(two)).otherwise(F.to_json(three))
    value = F.when(F.col("event_id") % 50 == 7, F.concat(F.lit("not json "), F.col("event_id").cast("string"))).when(F.col("event_id") % 53 == 9, "[1,2]").when(F.col("event_id") % 59 == 11, '{"timestamp":"yesterday","message":"m"}').otherwise(good)
    return e.select("event_id", value.alias("value"))


BAD = "CASE WHEN event_id % 50 = 7 OR event_id % 53 = 9 THEN 'unparseable' WHEN event_id % 59 = 11 THEN 'invalid_timestamp' END"


@query(f"""WITH {V.LOGS} SELECT event_id, CASE event_id % 3 WHEN 0 THEN micros WHEN 1 THEN micros // 1000000 * 1000000 ELSE micros // 1000 * 1000 END AS micros, level, service,
  CASE WHEN event_id % 3 = 2 THEN 'unknown' ELSE host END AS host, message, CASE event_id % 3 WHEN 0 THEN error_code WHEN 1 THEN '0' END AS error_code,
  CASE WHEN event_id % 3 <> 1 THEN trace_id END AS trace_id, CASE WHEN event_id % 3 <> 1 THEN env ELSE '' END AS env, CASE WHEN event_id % 3 = 2 THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE '' END AS flag
  FROM logs WHERE ({BAD}) IS NULL""")
def parse_json_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = parse.events(parse.parse(raw_records(spark, sf_dir)))
    label = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
    return got.select("event_id", F.unix_micros("timestamp").alias("micros"), "level", "service", "host", "message", "error_code", "trace_id", label("env").alias("env"), label("flag").alias("flag"))


@query(f"WITH {V.LOGS}, b AS (SELECT {BAD} AS reason FROM logs) SELECT reason, count(*) AS n FROM b WHERE reason IS NOT NULL GROUP BY reason")
def bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.dead_letters(parse.parse(raw_records(spark, sf_dir))).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {V.LOGS} SELECT event_id, CASE event_id % 6 WHEN 0 THEN micros // 1000000 * 1000000 WHEN 1 THEN micros // 1000 * 1000 WHEN 2 THEN micros // 1000000 * 1000000 WHEN 3 THEN micros // 1000000 * 1000000
  WHEN 4 THEN {V.NOW_MICROS} END AS micros FROM logs""")
def ts_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.logs(spark, sf_dir)
    m = F.unix_micros("timestamp")
    form = lambda p: F.concat(F.lit('"'), F.date_format("timestamp", p), F.lit('"'))
    k = F.col("event_id") % 6
    value = (
        F.when(k == 0, F.floor(m / 1_000_000).cast("string")).when(k == 1, F.floor(m / 1000).cast("string")).when(k == 2, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, form("yyyy-MM-dd HH:mm:ss")).when(k == 4, '""').otherwise('"1717243200"')
    )
    text_ = e.select("event_id", F.concat(F.lit('{"time":'), value, F.lit("}")).alias("t"))
    got = text_.select("event_id", parse.record(F.col("t")).alias("j"), F.try_parse_json("t").alias("v")).select("event_id", parse.given_time(F.col("j"), F.col("v")).alias("given"))
    return got.select("event_id", F.unix_micros(parse.timestamp(F.col("given"), V.now())).alias("micros"))


@query(f"""WITH {V.LOGS} SELECT event_id, CASE event_id % 4 WHEN 0 THEN micros // 1000000 * 1000000 WHEN 1 THEN micros // 1000 * 1000 WHEN 2 THEN micros END AS micros FROM logs""")
def epoch_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = F.unix_micros("timestamp"), F.col("event_id") % 4
    n = F.when(k == 0, F.floor(m / 1_000_000)).when(k == 1, F.floor(m / 1000)).when(k == 2, m * 1000).cast("decimal(38,0)")
    return V.logs(spark, sf_dir).select("event_id", F.unix_micros(text.epoch_guess(n)).alias("micros"))


# Policy and fingerprints


@query(f"WITH {V.LOGS}, {V.POLICY} SELECT service, error_code, min_level, w AS window_seconds, r AS refire_interval_seconds, count(*) AS n FROM resolved GROUP BY ALL")
def policy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = policy.SHIPPED.resolve(V.logs(spark, sf_dir)).withColumnRenamed("dedup_window_seconds", "window_seconds")
    return got.groupBy("service", "error_code", "min_level", "window_seconds", "refire_interval_seconds").agg(F.count("*").alias("n"))


@query(f"WITH {V.gated()} SELECT service, level, count(*) AS n FROM o GROUP BY ALL")
def min_level_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.enriched(spark, sf_dir).groupBy("service", "level").agg(F.count("*").alias("n"))


@query(f"WITH {V.gated()} SELECT event_id, fingerprint FROM o")
def fingerprint_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.enriched(spark, sf_dir).select("event_id", "fingerprint")


@query(f"WITH {V.gated('coarse')} SELECT fingerprint, count(*) AS n FROM o GROUP BY ALL")
def fingerprint_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.enriched(spark, sf_dir, V.COARSE).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query(f"WITH {V.gated('label')} SELECT event_id, fingerprint FROM o")
def fingerprint_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.enriched(spark, sf_dir, ["label:ENV", "message", "error_code", "host", "team"]).select("event_id", "fingerprint")


@query(f"WITH {V.LOGS} SELECT event_id, {V.TITLE} AS title FROM logs")
def title_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.logs(spark, sf_dir).select("event_id", text.title().alias("title"))


# Dedup


@query(f"""WITH {V.LOGS}, d AS (SELECT *, micros - lag(micros) OVER (PARTITION BY service ORDER BY micros, event_id) AS gap FROM logs WHERE level = 'ERROR'),
  s AS (SELECT *, sum(CASE WHEN gap > 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY micros, event_id) AS k FROM d)
  SELECT service, min(micros) AS first_micros, max(micros) AS last_micros, count(*) AS n FROM s GROUP BY service, k""")
def session_gap_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inactivity windows of one length; numbered by days and stitched, so a service with most rows isn't one task."""
    e = V.logs(spark, sf_dir).where("level = 'ERROR'").select("service", "event_id", _micros("timestamp", "micros"), F.lit(300).alias("window_seconds"))
    got = dedup.sessions(e, ["service"]).groupBy("service", "session").agg(F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"), F.count("*").alias("n"))
    return got.drop("session")


@query(f"WITH RECURSIVE {V.chain()} SELECT event_id, fingerprint, action FROM a")
def dedup_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.acted(spark, sf_dir).select("event_id", "fingerprint", "action")


EMIT = "event_id, id, fingerprint, action, first_title AS title, severity, service, first_host AS host, CAST(place AS BIGINT) AS occurrence_count, first_micros, micros AS last_micros, first_code AS error_code, trace_id, message AS sample_message"


def _emit_rows(e: DataFrame, *more: str) -> DataFrame:
    return e.select(
        "event_id", "id", "fingerprint", "action", "title", "severity", "service", "host", "occurrence_count", _micros("first_seen", "first_micros"), _micros("last_seen", "last_micros"), "error_code", "trace_id", "sample_message", *more
    )


@query(f"WITH RECURSIVE {V.chain('coarse', V.CLAMPED)} SELECT event_id, fingerprint, action FROM a")
def dedup_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of a time inside the data: what lies far after it counts as now."""
    return dedup.actions(V.enriched(spark, sf_dir, V.COARSE), V.NOW_MICROS).select("event_id", "fingerprint", "action")


@query(f"WITH RECURSIVE {V.emitted()} SELECT {EMIT} FROM em")
def dedup_emits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emit_rows(V.emits(spark, sf_dir))


@query(f"WITH RECURSIVE {V.chain('coarse')} SELECT service, action, count(*) AS n FROM a GROUP BY ALL")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.acted(spark, sf_dir, V.COARSE).groupBy("service", "action").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {V.emitted('coarse')} SELECT {EMIT}, w AS window_seconds FROM em")
def dedup_mixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error codes with windows of their own meet in one fingerprint."""
    return _emit_rows(V.emits(spark, sf_dir, V.COARSE), "window_seconds")


@query(f"WITH RECURSIVE {V.emitted('service')} SELECT event_id, fingerprint, severity, CAST(place AS BIGINT) AS occurrence_count FROM em")
def severity_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.emits(spark, sf_dir, ["service"]).select("event_id", "fingerprint", "severity", "occurrence_count")


@query(f"WITH RECURSIVE {V.ALERTS} SELECT id, fingerprint, title, service, host, error_code, severity, trace_id, sample_message, first_micros, last_micros, occurrence_count, window_seconds, n_emits FROM alerts")
def incident_state_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.alerts(spark, sf_dir).select("id", "fingerprint", "title", "service", "host", "error_code", "severity", "trace_id", "sample_message", "first_micros", "last_micros", "occurrence_count", "window_seconds", "n_emits")


# The incident table

MERGED = f"""{V.emitted('coarse')}, eo AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY micros, event_id) AS k FROM em),
  m AS (SELECT fingerprint, k, event_id, id, CAST(place AS BIGINT) AS n, true AS is_new, first_title AS title, severity, 'open' AS status, micros AS last_micros, first_micros, trace_id, message AS sample FROM eo WHERE k = 1
  UNION ALL SELECT e.fingerprint, e.k, e.event_id, m.id, CASE WHEN e.action = 'new' OR e.place <= m.n THEN m.n + 1 ELSE e.place END, false, m.title, e.severity, 'updated', e.micros, m.first_micros, e.trace_id, e.message
  FROM m JOIN eo e ON e.fingerprint = m.fingerprint AND e.k = m.k + 1)"""


@query(f"WITH RECURSIVE {MERGED} SELECT id, fingerprint, title, severity, status, n AS occurrence_count, first_micros, last_micros, trace_id, sample AS sample_message FROM m QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY k DESC) = 1")
def incidents_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = incidents.merge(None, V.emits(spark, sf_dir, V.COARSE))
    return after.select("id", "fingerprint", "title", "severity", "status", "occurrence_count", _micros("first_seen", "first_micros"), _micros("last_seen", "last_micros"), "trace_id", "sample_message")


@query(f"WITH RECURSIVE {MERGED} SELECT DISTINCT id || ':' || channel || ':' || n AS idempotency_key, id AS alert_id, channel, 'pending' AS status, CAST(0 AS INT) AS attempts FROM m, (VALUES ('webhook'), ('card')) v(channel)")
def outbox_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stored = incidents.merge(None, V.emits(spark, sf_dir, V.COARSE))
    return outbox.enqueue(stored.where(incidents.should_enqueue()), V.CHANNELS, now=V.now()).select("idempotency_key", "alert_id", "channel", "status", "attempts")


@query(f"WITH RECURSIVE {V.ALERTS} SELECT a.id, CASE WHEN fingerprint IN (SELECT fingerprint FROM alerts WHERE status = 'resolved') AND fingerprint NOT IN (SELECT fingerprint FROM alerts WHERE status = 'updated' AND n_emits > 40) THEN 'reopen_disallowed' END AS reason FROM alerts a")
def reopen_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.alerts(spark, sf_dir)
    table = a.where("status = 'resolved' OR (status = 'updated' AND n_emits > 40)")
    return incidents.reopen_allowed(a.withColumn("allow_reopen_after_resolve", F.lit(False)), table).select("id", "reason")


@query(f"WITH RECURSIVE {V.ALERTS} SELECT fingerprint, count(*) FILTER (status <> 'resolved') > 0 AS has_active, count(*) FILTER (status = 'resolved') > 0 AS has_resolved FROM alerts GROUP BY fingerprint")
def active_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.alerts(spark, sf_dir).groupBy("fingerprint").agg((F.count_if(F.col("status").isin("open", "updated", "acknowledged")) > 0).alias("has_active"), (F.count_if(F.col("status") == "resolved") > 0).alias("has_resolved"))


def _acted_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents after two operators' actions, so that every (previous, new) pair of statuses occurs."""
    a = V.alerts(spark, sf_dir)
    for c, kind in (("acknowledged_at", "timestamp"), ("resolved_at", "timestamp"), ("tta_seconds", "bigint"), ("ttr_seconds", "bigint"), ("updated_at", "timestamp")):
        a = a.withColumn(c, F.lit(None).cast(kind))
    for div, step in ((4, 0), (16, 1)):
        new = V.one_of(V.STATUS, F.floor(F.col("first_event") / div).cast("long"))
        at = F.timestamp_micros(F.col("first_micros") + (F.col("first_event") % 900 - 5 + 100 * step) * 1_000_000)
        a = incidents.with_status(a, new, at)
    return a


def _step(of: str, div: int, step: int) -> str:
    new, at = V._case(f"(first_event // {div})", V.STATUS), f"(first_micros + (first_event % 900 - 5 + {100 * step}) * 1000000)"
    since = f"greatest(0, ({at} - first_micros) // 1000000)"
    ack, res = f"({new} = 'acknowledged' AND status IN ('open', 'updated'))", f"({new} = 'resolved' AND status <> 'resolved')"
    wipe, undo = f"({new} = 'open' AND status = 'acknowledged')", f"({new} IN ('open', 'updated') AND status = 'resolved')"
    return f"""(SELECT id, service, first_event, first_micros, {new} AS status,
      CASE WHEN {ack} OR ({res} AND acked IS NULL) THEN {at} WHEN {wipe} OR {undo} THEN NULL ELSE acked END AS acked, CASE WHEN {ack} OR ({res} AND acked IS NULL) THEN {since} WHEN {wipe} OR {undo} THEN NULL ELSE tta END AS tta,
      CASE WHEN {res} THEN {at} WHEN {undo} THEN NULL ELSE done END AS done, CASE WHEN {res} THEN {since} WHEN {undo} THEN NULL ELSE ttr END AS ttr FROM {of})"""


LIFECYCLE = f"{V.ALERTS}, z AS (SELECT *, CAST(NULL AS BIGINT) AS acked, CAST(NULL AS BIGINT) AS tta, CAST(NULL AS BIGINT) AS done, CAST(NULL AS BIGINT) AS ttr FROM alerts), life AS {_step(_step('z', 4, 0), 16, 1)}"


@query(f"WITH RECURSIVE {LIFECYCLE} SELECT id, status, acked AS acknowledged_micros, tta AS tta_seconds, done AS resolved_micros, ttr AS ttr_seconds FROM life")
def status_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acted_on(spark, sf_dir).select("id", "status", _micros("acknowledged_at", "acknowledged_micros"), "tta_seconds", _micros("resolved_at", "resolved_micros"), "ttr_seconds")


@query(f"WITH RECURSIVE {LIFECYCLE} SELECT service, count(tta) AS n_acknowledged, CAST(sum(tta) AS BIGINT) AS sum_tta, count(ttr) AS n_resolved, CAST(sum(ttr) AS BIGINT) AS sum_ttr FROM life GROUP BY service")
def tta_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and counts for mean times per service (an extension)."""
    return _acted_on(spark, sf_dir).groupBy("service").agg(F.count("tta_seconds").alias("n_acknowledged"), F.sum("tta_seconds").alias("sum_tta"), F.count("ttr_seconds").alias("n_resolved"), F.sum("ttr_seconds").alias("sum_ttr"))


# The outbox


@query(f"""WITH RECURSIVE {V.BOX}, f AS (SELECT *, status = 'processing' AND updated_micros < {V.NOW_MICROS} - 120000000 AS stale FROM box),
  d AS (SELECT idempotency_key, attempts + 1 AS attempts, CASE WHEN stale THEN {V.NOW_MICROS} ELSE next_micros END AS due FROM f WHERE stale OR (status IN ('pending', 'failed') AND next_micros <= {V.NOW_MICROS}))
  SELECT idempotency_key, attempts, 'processing' AS status FROM d ORDER BY due, idempotency_key LIMIT 50""")
def outbox_due_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.claim(V.box(spark, sf_dir), V.now()).select("idempotency_key", "attempts", "status")


@query(f"""WITH RECURSIVE {V.BOX} SELECT idempotency_key, CASE WHEN attempts % 3 = 0 THEN 'sent' WHEN attempts >= 8 THEN 'dead' ELSE 'failed' END AS status,
  CASE WHEN attempts % 3 = 0 OR attempts >= 8 THEN next_micros ELSE {V.NOW_MICROS} + CAST(least(300, pow(2, greatest(1, attempts))) AS BIGINT) * 1000000 END AS next_micros,
  CASE WHEN attempts % 3 <> 0 THEN 'dispatch failed' END AS last_error FROM box""")
def outbox_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = outbox.mark(V.box(spark, sf_dir), F.col("attempts") % 3 == 0, F.lit(None).cast("string"), V.now())
    return got.select("idempotency_key", "status", _micros("next_attempt_at", "next_micros"), "last_error")


@query(f"WITH RECURSIVE {V.BOX} SELECT status, count(*) AS n FROM box GROUP BY status")
def outbox_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.counts(V.box(spark, sf_dir))


@query(f"""WITH RECURSIVE {V.BOX}, q AS (SELECT count(*) AS n, count(*) FILTER (status IN ('pending', 'processing', 'failed')) AS w, count(*) FILTER (status = 'dead') AS d FROM box),
  t AS (SELECT count(*) FILTER (action <> 'suppress') AS e, count(*) FILTER (action = 'suppress') AS s FROM a),
  tried AS (SELECT channel || ':' || CASE WHEN event_id % 7 <> 0 THEN 'success' ELSE 'failure' END AS label, count(*) AS value FROM em, (VALUES ('webhook'), ('card')) v(channel) GROUP BY ALL)
  SELECT 'emitted' AS metric, '' AS label, e AS value FROM t UNION ALL SELECT 'skipped', 'suppressed', s FROM t UNION ALL SELECT 'outbox_enqueued', '', n FROM q
  UNION ALL SELECT 'outbox_pending', '', w FROM q UNION ALL SELECT 'outbox_dead', '', d FROM q UNION ALL SELECT 'dispatch_attempts', label, value FROM tried""")
def pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    acted = checkpointed(V.acted(spark, sf_dir, V.COARSE))  # read three times below
    emits = dedup.emits(acted)
    return metrics.decisions(acted).unionByName(metrics.queue(V.box(spark, sf_dir, emits))).unionByName(metrics.attempts(V.deliveries(spark, sf_dir, emits)))


@query(f"WITH RECURSIVE {V.BOX} SELECT count(*) FILTER (status IN ('pending', 'processing', 'failed')) AS n_open, count(*) FILTER (status = 'dead') AS n_dead FROM box")
def outbox_open_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.open_count(V.box(spark, sf_dir))


@query(f"WITH RECURSIVE {V.BOX} SELECT idempotency_key, status FROM box WHERE status = 'dead' ORDER BY updated_micros DESC, idempotency_key DESC LIMIT 20 OFFSET 5")
def outbox_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.listing(V.box(spark, sf_dir), "dead", 20, 5).select("idempotency_key", "status")


@query(f"WITH RECURSIVE {V.BOX} SELECT idempotency_key, CASE WHEN status = 'dead' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead' THEN 0 ELSE attempts END AS attempts, CASE WHEN status <> 'dead' THEN 'e' END AS last_error FROM box WHERE status <> 'sent'")
def outbox_redrive_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = outbox.delete(outbox.redrive(V.box(spark, sf_dir), V.now()), status="sent")
    return got.select("idempotency_key", "status", "attempts", "last_error")


@query(f"WITH RECURSIVE {V.DELIVERIES} SELECT idempotency_key FROM del WHERE success = 1")
def outbox_already_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.already_sent(V.box(spark, sf_dir), V.deliveries(spark, sf_dir)).select("idempotency_key")


# Reads


@query(f"WITH RECURSIVE {V.DELIVERIES} SELECT alert_id AS id, count(*) FILTER (success = 1) AS dispatch_ok, count(*) FILTER (success = 0) AS dispatch_failed FROM del GROUP BY alert_id")
def dispatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reads.with_dispatch_counts(V.alerts(spark, sf_dir).select("id"), V.deliveries(spark, sf_dir))
    return got.select("id", "dispatch_ok", "dispatch_failed")


@query(f"WITH RECURSIVE {V.DELIVERIES} SELECT alert_id, idempotency_key, row_number() OVER (PARTITION BY alert_id ORDER BY created_micros DESC, idempotency_key DESC) AS place FROM del QUALIFY place <= 50")
def dispatch_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.newest_dispatches(V.deliveries(spark, sf_dir)).select("alert_id", "idempotency_key", F.col("place").cast("long").alias("place"))


@query(f"WITH RECURSIVE {V.DELIVERIES} SELECT alert_id, idempotency_key, created_micros FROM del ORDER BY created_micros DESC, idempotency_key DESC LIMIT 100")
def recent_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.recent_dispatches(V.deliveries(spark, sf_dir)).select("alert_id", "idempotency_key", _micros("created_at", "created_micros"))


@query(f"WITH RECURSIVE {V.DELIVERIES} SELECT alert_id, idempotency_key, created_micros FROM del ORDER BY created_micros DESC, idempotency_key DESC LIMIT 40 OFFSET 80")
def dispatch_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.dispatch_page(V.deliveries(spark, sf_dir), page=3, page_size=40).select("alert_id", "idempotency_key", _micros("created_at", "created_micros"))


SNAP = f"{V.ALERTS}, snap AS (SELECT * FROM alerts ORDER BY last_micros DESC, id LIMIT 2000)"
SHOWN = ("id", "title", "severity", "service", "status", "occurrence_count", "last_micros")
LIST = ", ".join(SHOWN)


@query(f"WITH RECURSIVE {SNAP} SELECT {LIST} FROM snap ORDER BY last_micros DESC, id LIMIT 25 OFFSET 25")
def alerts_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.alerts_page(V.alerts(spark, sf_dir), page=2).select(*SHOWN)


@query(f"WITH RECURSIVE {SNAP} SELECT {LIST} FROM snap WHERE contains(lower(concat_ws(' ', title, sample_message, fingerprint, COALESCE(error_code, ''), service)), 'timed out after') ORDER BY last_micros DESC, id LIMIT 200")
def alerts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.alerts_page(V.alerts(spark, sf_dir), page_size=200, q=" Timed OUT after ").select(*SHOWN)


@query(f"WITH RECURSIVE {SNAP} SELECT {LIST} FROM snap WHERE status IN ('open', 'resolved') AND severity IN ('CRITICAL') AND service = 'checkout' ORDER BY last_micros DESC, id LIMIT 200")
def alerts_status_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.alerts_page(V.alerts(spark, sf_dir), page_size=200, status="open, resolved,OPEN", severity="critical", service="checkout").select(*SHOWN)


@query(f"WITH RECURSIVE {SNAP} SELECT {LIST} FROM snap WHERE env = 'prod' ORDER BY last_micros DESC, id LIMIT 200")
def alerts_label_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [{"key": "ENV", "value": "Prod"}, {"key": "team", "value": ""}, {"key": " ", "value": "x"}]
    return reads.alerts_page(V.alerts(spark, sf_dir), page_size=200, labels=specs, label_key="nothing").select(*SHOWN)


@query(f"""WITH RECURSIVE {V.ALERTS} SELECT count(*) AS total, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'updated') AS n_updated, count(*) FILTER (status = 'acknowledged') AS n_acknowledged,
  count(*) FILTER (status = 'resolved') AS n_resolved, count(*) FILTER (severity IN ('ERROR', 'CRITICAL', 'FATAL')) AS n_severe, max(last_micros) AS last_micros, count(DISTINCT service) AS n_services,
  (SELECT CAST(sum(CASE WHEN event_id % 7 <> 0 THEN 2 ELSE 0 END) AS BIGINT) FROM a WHERE action <> 'suppress') AS dispatch_ok, (SELECT CAST(sum(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END) AS BIGINT) FROM a WHERE action <> 'suppress') AS dispatch_failed FROM alerts""")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reads.stats(V.alerts(spark, sf_dir), V.deliveries(spark, sf_dir))
    return got.withColumn("last_micros", F.unix_micros("last_seen")).drop("last_seen")


@query(f"WITH RECURSIVE {V.ALERTS} SELECT DISTINCT service FROM alerts ORDER BY service")
def services_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.services(V.alerts(spark, sf_dir))


def _widgets(spark: SparkSession) -> DataFrame:
    return spark.sql("""SELECT * FROM VALUES ('w1', 'Prod', array(named_struct('key', 'env', 'value', 'prod')), '', 2),
      ('w2', 'Open staging', array(named_struct('key', 'ENV', 'value', 'STAGING'), named_struct('key', 'team', 'value', '')), 'open, updated', 1), ('w3', 'None', array(named_struct('key', 'zone', 'value', '')), '', 0)
      AS w(id, title, labels, status_filter, sort_order)""")


@query(f"""WITH RECURSIVE {V.ALERTS}, h AS (SELECT 'w1' AS widget_id, * FROM alerts WHERE env = 'prod' UNION ALL SELECT 'w2', * FROM alerts WHERE env = 'staging' AND status IN ('open', 'updated'))
  SELECT widget_id, id, row_number() OVER (PARTITION BY widget_id ORDER BY last_micros DESC, id) AS place FROM h QUALIFY place <= 10""")
def widgets_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.widget_matches(_widgets(spark), V.alerts(spark, sf_dir)).select("widget_id", "id", F.col("place").cast("long").alias("place"))


# Sources


@query(f"WITH {V.LOGS}, u AS (SELECT event_id, 'a' AS origin, trace_id, CAST(NULL AS VARCHAR) AS host FROM logs UNION ALL SELECT event_id, 'b', NULL, host FROM logs) SELECT * FROM u")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.logs(spark, sf_dir)
    return external.union_sources(e.select("event_id", F.lit("a").alias("origin"), "trace_id"), e.select("event_id", F.lit("b").alias("origin"), "host"))


@query(f"WITH {V.LOGS} SELECT DISTINCT micros // 100000000 AS ts_ns, service, level AS line FROM logs")
def source_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.logs(spark, sf_dir).select(F.floor(F.unix_micros("timestamp") / 100_000_000).alias("ts_ns"), "service", F.col("level").alias("line"))
    return external.once(e)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-query answers: plain lines for even events, JSON lines for odd ones, three entries in an answer."""
    e = V.logs(spark, sf_dir).withColumn("ns", (F.unix_micros("timestamp") * 1000).cast("string"))
    line = F.when(F.col("event_id") % 2 == 0, F.col("message")).otherwise(F.to_json(F.struct(F.col("raw_level").alias("severity"), F.col("message").alias("msg"), F.col("error_code").alias("code"), F.struct(F.col("labels")["env"].alias("env")).alias("labels"))))
    stream = F.struct(F.col("service").alias("App"), F.col("host").alias("pod"), F.lit("warn").alias("lvl"))
    streams = e.select(F.floor(F.col("event_id") / 3).alias("k"), F.struct(stream.alias("stream"), F.array(F.array("ns", line), F.array("ns")).alias("values")).alias("s"))
    return streams.groupBy("k").agg(F.collect_list("s").alias("r")).select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("streams").alias("resultType"), F.col("r").alias("result")).alias("data"))).alias("value"))


@query(f"""WITH {V.LOGS} SELECT micros, CASE WHEN event_id % 2 = 0 THEN 'WARN' ELSE upper(raw_level) END AS level, service, host, message, CASE WHEN event_id % 2 = 1 THEN error_code END AS error_code,
  CASE WHEN event_id % 2 = 1 THEN env ELSE '' END AS env, 'grafana-loki' AS source FROM logs""")
def loki_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = external.range_entries(_answers(spark, sf_dir))
    return got.select(F.unix_micros("timestamp").alias("micros"), "level", "service", "host", "message", "error_code", F.coalesce(F.try_element_at("labels", F.lit("env")), F.lit("")).alias("env"), F.col("labels")["source"].alias("source"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.logs(spark, sf_dir)
    severity = F.when(F.col("event_id") % 4 == 0, "high").when(F.col("event_id") % 4 == 1, F.col("raw_level")).when(F.col("event_id") % 4 == 2, "odd")
    item = F.struct(
        F.when(F.col("event_id") % 5 == 0, "resolved").otherwise("firing").alias("status"), F.struct(F.col("service").alias("job"), severity.alias("severity"), F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("alertname")).alias("labels"),
        F.struct(F.col("message").alias("summary")).alias("annotations"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startsAt"),
    )
    whole = F.struct(F.lit("team").alias("receiver"), F.struct(F.lit("x").alias("zone")).alias("groupLabels"), F.array(item).alias("alerts"))
    single = F.struct(F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("alertname"), F.lit("ok").alias("state"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startsAt"))
    return e.select(F.when(F.col("event_id") % 11 == 0, F.to_json(single)).when(F.col("event_id") % 13 == 0, '{"hello":1}').otherwise(F.to_json(whole)).alias("value"))


@query(f"""WITH {V.LOGS}, k AS (SELECT *, event_id % 11 = 0 AS alone, event_id % 11 = 0 OR event_id % 5 = 0 AS done FROM logs WHERE event_id % 11 = 0 OR event_id % 13 <> 0)
  SELECT micros // 1000000 * 1000000 AS micros, CASE WHEN alone THEN 'INFO' WHEN event_id % 4 = 0 THEN 'ERROR' WHEN event_id % 4 = 1 AND raw_level <> 'fatal' THEN CASE upper(raw_level) WHEN 'WARNING' THEN 'WARN' ELSE upper(raw_level) END
    WHEN event_id % 4 = 3 THEN CASE WHEN done THEN 'INFO' ELSE 'CRITICAL' END WHEN done THEN 'INFO' ELSE 'ERROR' END AS level,
  CASE WHEN alone THEN 'A' || event_id ELSE service END AS service, CASE WHEN done THEN '[resolved] ' ELSE '' END || CASE WHEN alone THEN 'A' || event_id ELSE message END AS message, 'A' || event_id AS error_code,
  CASE WHEN alone THEN '' ELSE message END AS annotation, CASE WHEN alone THEN '' ELSE 'x' END AS zone, CASE WHEN alone THEN '' ELSE 'team' END AS receiver, CASE WHEN done THEN 'resolved' ELSE 'firing' END AS state FROM k""")
def alert_webhook_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = external.alert_entries(_bodies(spark, sf_dir), now=V.now())
    label = lambda k, into: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit("")).alias(into)
    return got.select(
        F.unix_micros("timestamp").alias("micros"), "level", "service", "message", "error_code", label("annotation_summary", "annotation"), label("group_zone", "zone"), label("grafana_receiver", "receiver"), label("grafana_status", "state")
    )


# Channel payloads: what their JSON says.


def _said(column, *paths: tuple[str, str]) -> list:
    return [F.get_json_object(column, p).alias(n) for n, p in paths]


@query(f"""WITH RECURSIVE {V.emitted('coarse')} SELECT id, fingerprint, first_title AS title, message AS description, severity, service, first_host AS host, CASE WHEN action = 'new' THEN 'open' ELSE 'updated' END AS status, CAST(place AS VARCHAR) AS n,
  first_micros // 1000000 AS first_second, micros // 1000000 AS last_second, first_code AS error_code, trace_id, env, message AS sample, CASE WHEN action = 'new' THEN 'true' ELSE 'false' END AS is_new FROM em""")
def payload_webhook(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.emits(spark, sf_dir, V.COARSE).select(channels.webhook().alias("j"))
    named = [(c, f"$.{c}") for c in ("id", "fingerprint", "title", "description", "severity", "service", "host", "status", "error_code", "trace_id", "is_new")]
    second = lambda c: F.unix_timestamp(F.to_timestamp(F.get_json_object("j", f"$.{c}_seen"))).alias(f"{c}_second")
    return e.select(*_said("j", *named, ("n", "$.occurrence_count"), ("env", "$.labels.env"), ("sample", "$.sample_message")), second("first"), second("last"))


@query(f"""WITH RECURSIVE {V.emitted('coarse')} SELECT id, '[' || CASE WHEN action = 'new' THEN 'NEW' ELSE 'UPDATED' END || '] ' || first_title AS title, CASE severity WHEN 'CRITICAL' THEN 'FF0000' ELSE 'E81123' END AS colour,
  CAST(place AS VARCHAR) AS n, COALESCE(first_code, '—') AS code, message AS text FROM em""")
def payload_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.emits(spark, sf_dir, V.COARSE).select("id", channels.card().alias("j"))
    return e.select("id", *_said("j", ("title", "$.title"), ("colour", "$.themeColor"), ("n", "$.sections[0].facts[3].value"), ("code", "$.sections[0].facts[5].value"), ("text", "$.sections[0].text")))


@query(f"WITH RECURSIVE {V.emitted('coarse')} SELECT id, first_title AS message, lower(severity) AS severity, 'trigger' AS alert_type, fingerprint AS entity_id, CAST(place AS VARCHAR) AS n, trace_id FROM em")
def payload_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.emits(spark, sf_dir, V.COARSE).select("id", channels.paging().alias("j"))
    return e.select("id", *_said("j", ("message", "$.message"), ("severity", "$.severity"), ("alert_type", "$.alert_type"), ("entity_id", "$.entity_id"), ("n", "$.payload.occurrence_count"), ("trace_id", "$.payload.trace_id")))


# Tables that are there already

TAIL = V.ALERTS.removeprefix(f"{V.chain('coarse')}, ")
INTO = f"""{V.emitted('coarse')}, {TAIL}, t AS (SELECT * FROM alerts WHERE first_micros < {V.NOW_MICROS} QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY first_micros DESC) = 1),
  act AS (SELECT * FROM t WHERE status <> 'resolved'), eo AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY micros, event_id) AS k FROM em WHERE micros >= {V.NOW_MICROS}),
  m AS (SELECT e.fingerprint, e.k, e.event_id, CASE WHEN a.id IS NOT NULL THEN a.id WHEN e.id IN (SELECT id FROM t) THEN substr(sha256(e.id || '|again'), 1, 8) || substr(e.id, 9, 28) ELSE e.id END AS id,
      CASE WHEN a.id IS NULL THEN CAST(e.place AS BIGINT) WHEN e.action = 'new' OR e.place <= a.occurrence_count THEN a.occurrence_count + 1 ELSE e.place END AS n, a.id IS NULL AS is_new,
      CASE WHEN a.id IS NULL THEN 'open' WHEN a.status = 'acknowledged' THEN a.status ELSE 'updated' END AS status, COALESCE(a.first_micros, e.first_micros) AS first_micros, e.micros AS last_micros, e.severity, COALESCE(a.title, e.first_title) AS title
    FROM eo e LEFT JOIN act a ON a.fingerprint = e.fingerprint WHERE e.k = 1
  UNION ALL SELECT e.fingerprint, e.k, e.event_id, m.id, CASE WHEN e.action = 'new' OR e.place <= m.n THEN m.n + 1 ELSE e.place END, false, CASE WHEN m.status = 'acknowledged' THEN m.status ELSE 'updated' END, m.first_micros, e.micros, e.severity, m.title
    FROM m JOIN eo e ON e.fingerprint = m.fingerprint AND e.k = m.k + 1)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incident table as of NOW: of each fingerprint the last session that has begun, active or resolved."""
    last = Window.partitionBy("fingerprint").orderBy(F.desc("first_micros"))
    a = V.alerts(spark, sf_dir).where(F.col("first_micros") < V.NOW_MICROS).withColumn("_k", F.row_number().over(last)).where("_k = 1")
    nothing = {c: F.lit(None).cast(k) for c, k in (("acknowledged_at", "timestamp"), ("resolved_at", "timestamp"), ("tta_seconds", "bigint"), ("ttr_seconds", "bigint"))}
    return a.withColumns(nothing | {"created_at": F.col("first_seen"), "updated_at": F.col("last_seen")}).select(*incidents.COLUMNS)


def _since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.emits(spark, sf_dir, V.COARSE).where(F.col("micros") >= V.NOW_MICROS)


MERGED_ROW = "id, fingerprint, title, severity, status, n AS occurrence_count, first_micros, last_micros"


@query(f"""WITH RECURSIVE {INTO}, z AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY k DESC) = 1) SELECT {MERGED_ROW} FROM z
  UNION ALL SELECT id, fingerprint, title, severity, status, occurrence_count, first_micros, last_micros FROM t WHERE status = 'resolved' OR fingerprint NOT IN (SELECT fingerprint FROM z)""")
def incidents_merged_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emits from NOW on, merged into the table as of NOW."""
    after, _ = incidents.merge(_stored(spark, sf_dir), _since(spark, sf_dir))
    return after.select("id", "fingerprint", "title", "severity", "status", "occurrence_count", _micros("first_seen", "first_micros"), _micros("last_seen", "last_micros"))


@query(f"WITH RECURSIVE {INTO} SELECT event_id, id, n AS occurrence_count, is_new, status, is_new OR status <> 'acknowledged' AS may_send FROM m")
def ack_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emits as stored, and whether an acknowledged incident's policy silences them."""
    _, stored = incidents.merge(_stored(spark, sf_dir), _since(spark, sf_dir))
    return stored.select("event_id", "id", "occurrence_count", "is_new", "status", incidents.should_enqueue().alias("may_send"))


@query(f"WITH RECURSIVE {V.BOX} SELECT idempotency_key, alert_id, channel FROM box WHERE status = 'failed'")
def outbox_enqueue_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that an outbox lacks: it has all but one status's."""
    there = V.box(spark, sf_dir).where("status <> 'failed'")
    return outbox.enqueue(V.emits(spark, sf_dir, V.COARSE), V.CHANNELS, there, V.now()).select("idempotency_key", "alert_id", "channel")


@query(f"WITH RECURSIVE {V.BOX} SELECT idempotency_key, 'pending' AS status, {V.NOW_MICROS} AS next_micros FROM box WHERE status = 'processing' AND updated_micros < {V.NOW_MICROS} - 120000000")
def outbox_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.released(V.box(spark, sf_dir), V.now()).select("idempotency_key", "status", _micros("next_attempt_at", "next_micros"))


@query(f"""WITH RECURSIVE {V.ALERTS}, p AS (SELECT (SELECT min(id) FROM alerts WHERE status = 'open') AS one, (SELECT min(fingerprint) FROM alerts) AS fp),
  s AS (SELECT *, CASE WHEN id = one THEN 'acknowledged' ELSE status END AS step FROM alerts, p)
  SELECT id, CASE WHEN fingerprint = fp AND step <> 'resolved' THEN 'resolved' ELSE step END AS status, CASE WHEN id = one OR (fingerprint = fp AND step <> 'resolved') THEN greatest(0, ({V.NOW_MICROS} - first_micros) // 1000000) END AS tta_seconds,
    CASE WHEN fingerprint = fp AND step <> 'resolved' THEN greatest(0, ({V.NOW_MICROS} - first_micros) // 1000000) END AS ttr_seconds FROM s""")
def operator_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident is acknowledged by its id, then all active ones of a fingerprint are resolved."""
    a = checkpointed(V.alerts(spark, sf_dir))
    one, fp = a.agg(F.min(F.when(F.col("status") == "open", F.col("id"))), F.min("fingerprint")).first()
    for c, kind in (("acknowledged_at", "timestamp"), ("resolved_at", "timestamp"), ("tta_seconds", "bigint"), ("ttr_seconds", "bigint"), ("updated_at", "timestamp")):
        a = a.withColumn(c, F.lit(None).cast(kind))
    acked = incidents.with_status(a, F.lit("acknowledged"), V.now(), F.col("id") == one)
    return incidents.resolve_fingerprint(acked, fp, V.now()).select("id", "status", "tta_seconds", "ttr_seconds")


@query(f"WITH RECURSIVE {V.ALERTS}, snap AS (SELECT * FROM alerts ORDER BY last_micros DESC, id LIMIT 2000) SELECT id, last_micros FROM snap ORDER BY last_micros DESC, id LIMIT 10 OFFSET 20")
def alerts_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offset inside a page is cut down to the page."""
    page, size = reads.page_from_offset(10, 25)
    return reads.alerts_page(V.alerts(spark, sf_dir), page=page, page_size=size).select("id", "last_micros")


@query(f"WITH RECURSIVE {V.emitted('coarse')}, {TAIL}, del AS (SELECT id AS alert_id, id || ':' || channel || ':' || place AS idempotency_key FROM em, (VALUES ('webhook'), ('card')) v(channel)) SELECT alert_id, idempotency_key FROM del WHERE alert_id IN (SELECT id FROM alerts WHERE status = 'open')")
def dispatches_of_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.dispatches_of(V.deliveries(spark, sf_dir), V.alerts(spark, sf_dir).where("status = 'open'")).select("alert_id", "idempotency_key")


@query(f"WITH RECURSIVE {V.ALERTS} SELECT id, CASE WHEN first_event % 3 = 0 THEN '' ELSE env END AS env, CASE WHEN first_event % 2 = 0 THEN 0 ELSE occurrence_count END AS occurrence_count, CASE WHEN first_event % 5 = 0 THEN '' ELSE sample_message END AS sample_message FROM alerts")
def stored_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with labels as JSON text, some of it unreadable, and with missing values."""
    a = V.alerts(spark, sf_dir).withColumns({
        "labels": F.when(F.col("first_event") % 3 == 0, "{no json").otherwise(F.to_json("labels")), "occurrence_count": F.when(F.col("first_event") % 2 != 0, F.col("occurrence_count")),
        "sample_message": F.when(F.col("first_event") % 5 != 0, F.col("sample_message")),
    })
    return reads.view(a).select("id", F.coalesce(F.try_element_at("labels", F.lit("env")), F.lit("")).alias("env"), "occurrence_count", "sample_message")


def _user_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A widget for each user of the events: an environment's incidents, of two statuses for some."""
    u = V.logs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id"), "event_id").select("user_id", F.col("labels")["env"].alias("env")).distinct()
    spec = lambda k, v: F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
    labels = F.when(F.col("user_id") % 3 == 0, F.array(spec("ENV", F.col("env")))).when(F.col("user_id") % 3 == 1, F.array(spec("env", F.upper("env")), spec("team", ""))).otherwise(F.array(spec("env", F.col("env")), spec("zone", "x")))
    return u.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("title"), labels.alias("labels"),
        F.when(F.col("user_id") % 2 == 0, "open, updated").otherwise("").alias("status_filter"), (F.col("user_id") % 5).cast("int").alias("sort_order"),
    )


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT min('u' || user_id) AS gone FROM u)
  SELECT 'u' || user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'Again ' || user_id ELSE 'User ' || user_id END AS title, CAST(user_id % 5 AS INT) AS sort_order, CASE WHEN user_id % 2 = 0 THEN 'open, updated' ELSE '' END AS status_filter FROM u, p WHERE 'u' || user_id <> gone""")
def widgets_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A widget for each user, stored; half of them replaced, one dropped; in their order."""
    from ..streaming.tables import Tables

    tables, rows = Tables(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"), checkpointed(_user_widgets(spark, sf_dir))
    tables.save_widget(rows)
    tables.save_widget(rows.where("status_filter <> ''").withColumn("title", F.replace("title", F.lit("User"), F.lit("Again"))))
    tables.drop_widget(rows.agg(F.min("id")).first()[0])
    return tables.widgets().select("id", "title", "sort_order", "status_filter")


@query(f"""WITH RECURSIVE {V.ALERTS}, u AS (SELECT DISTINCT user_id, env FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS env FROM events)),
  h AS (SELECT 'u' || user_id AS widget_id, a.* FROM u JOIN alerts a ON a.env = u.env AND user_id % 3 <> 2 AND (user_id % 2 <> 0 OR a.status IN ('open', 'updated')))
  SELECT widget_id, id, row_number() OVER (PARTITION BY widget_id ORDER BY last_micros DESC, id) AS place FROM h QUALIFY place <= 10""")
def widgets_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many widgets as there are users; a third asks for a label that no incident has."""
    return reads.widget_matches(_user_widgets(spark, sf_dir), V.alerts(spark, sf_dir)).select("widget_id", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH RECURSIVE {V.ALERTS} SELECT {LIST} FROM alerts ORDER BY last_micros DESC, id LIMIT 25 OFFSET 50")
def alerts_seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page, found from where the second one ended."""
    a = checkpointed(V.alerts(spark, sf_dir))
    page, token = reads.alerts_after(a)
    for _ in range(2):
        page, token = reads.alerts_after(a, token) if token is not None else (page.limit(0), None)  # behind the last page is nothing
    return page.select(*SHOWN)


@query(f"WITH RECURSIVE {V.ALERTS} SELECT {LIST} FROM alerts WHERE contains(lower(concat_ws(' ', title, sample_message, fingerprint, COALESCE(error_code, ''), service)), 'timed out after')")
def alerts_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of all incidents by an index of their trigrams."""
    a, path = checkpointed(V.alerts(spark, sf_dir)), f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}"
    search.build(a, path)
    return search.find(spark, path, a, " Timed OUT after ").rows.select(*SHOWN)


@query(f"WITH {V.LOGS} SELECT event_id, NULLIF(least(event_id % 6000, 4000), 0) AS n_body, NULLIF(least(event_id % 3000, 2000), 0) AS n_error FROM logs")
def audit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda k: F.expr(f"repeat('x', cast(event_id % {k} as int))")
    e = V.logs(spark, sf_dir).select("event_id", long(6000).alias("response_body"), long(3000).alias("error_message"))
    return e.select("event_id", *outbox.audit_row()).select("event_id", F.char_length("response_body").cast("long").alias("n_body"), F.char_length("error_message").cast("long").alias("n_error"))


ODD_POLICY = {
    "defaults": {"min_level": "WARN", "update_interval_seconds": 45, "unknown": 1},
    "services": {"checkout": {"dedup_fields": " service, level ,", "refire_interval_seconds": 7, "update_interval_seconds": 9}, "inventory": {"dedup_fields": ""}},
    "error_codes": {"NPE": {"dedup_fields": ["service", "label:env"], "dedup_window_seconds": 77}},
}


@query(f"""WITH {V.LOGS} SELECT service, error_code, 'WARN' AS min_level, CASE WHEN error_code = 'NPE' THEN 77 ELSE 300 END AS window_seconds, CASE service WHEN 'checkout' THEN 7 ELSE 45 END AS refire_interval_seconds,
  CASE WHEN error_code = 'NPE' THEN 'service,label:env' WHEN service = 'checkout' THEN 'service,level' WHEN service = 'inventory' THEN 'service,level,labels,message' END AS dedup_fields, count(*) AS n FROM logs GROUP BY ALL""")
def policy_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown keys are left out, the old name of a key counts where the new one is missing, field lists are texts or lists."""
    got = policy.Policy.of(ODD_POLICY).resolve(V.logs(spark, sf_dir)).withColumnRenamed("dedup_window_seconds", "window_seconds")
    return got.groupBy("service", "error_code", "min_level", "window_seconds", "refire_interval_seconds", "dedup_fields").agg(F.count("*").alias("n"))


@query(f"WITH {V.LOGS} SELECT event_id, CASE WHEN micros > {V.NOW_MICROS} + 300000000 THEN {V.NOW_MICROS} ELSE micros END AS clock FROM logs")
def clock_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.logs(spark, sf_dir).select("event_id", dedup.event_clock(F.unix_micros("timestamp"), V.NOW_MICROS).alias("clock"))


@query(f"WITH {V.LOGS} SELECT service AS key, micros, level, service, host, message, error_code, trace_id, env FROM logs")
def wire_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a log topic takes them, and what a reader of that topic makes of them."""
    sent = parse.wire(V.logs(spark, sf_dir).select("timestamp", "level", "service", "host", "message", "error_code", "trace_id", "labels"))
    got = parse.events(parse.parse(sent))
    return got.select("key", F.unix_micros("timestamp").alias("micros"), "level", "service", "host", "message", "error_code", "trace_id", F.col("labels")["env"].alias("env"))


@query(f"WITH {V.LOGS} SELECT event_id, {BAD} AS reason, CASE WHEN event_id % 50 = 7 THEN 'not json ' || event_id WHEN event_id % 53 = 9 THEN '[1,2]' ELSE '{{\"timestamp\":\"yesterday\",\"message\":\"m\"}}' END AS payload FROM logs WHERE ({BAD}) IS NOT NULL")
def dead_letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.dead_letters(parse.parse(raw_records(spark, sf_dir))).select("event_id", "reason", "payload")


@query(f"WITH {V.LOGS} SELECT event_id, CASE event_id % 4 WHEN 0 THEN service ELSE '' END AS header FROM logs")
def header_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers are a JSON object; anything else means none."""
    k = F.col("event_id") % 4
    given = F.when(k == 0, F.to_json(F.struct(F.col("service").alias("X-Service")))).when(k == 1, "[1]").when(k == 2, "no json")
    return V.logs(spark, sf_dir).select("event_id", F.coalesce(F.try_element_at(text.headers(given), F.lit("X-Service")), F.lit("")).alias("header"))


@query(f"""WITH RECURSIVE {V.emitted('coarse')}, eo AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY micros, event_id) AS k FROM em WHERE micros >= {V.NOW_MICROS}),
  m AS (SELECT fingerprint, k, id, CAST(place AS BIGINT) AS n, 'open' AS status, severity, micros AS last_micros FROM eo WHERE k = 1
  UNION ALL SELECT e.fingerprint, e.k, m.id, CASE WHEN e.action = 'new' OR e.place <= m.n THEN m.n + 1 ELSE e.place END, 'updated', e.severity, e.micros FROM m JOIN eo e ON e.fingerprint = m.fingerprint AND e.k = m.k + 1),
  z AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY k DESC) = 1), ob AS (SELECT DISTINCT id || ':' || n AS key, id FROM m)
  SELECT id, fingerprint, severity, status, n AS occurrence_count, last_micros, (SELECT count(*) FROM ob WHERE ob.id = z.id) AS n_outbox FROM z""")
def table_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of emits before NOW, all of it cleared, then a batch of those since: incidents with their outbox rows."""
    from ..streaming.tables import Tables

    tables = Tables(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    emits = checkpointed(V.emits(spark, sf_dir, V.COARSE))
    tables.apply(emits.where(F.col("micros") < V.NOW_MICROS), 0)
    tables.clear()
    tables.apply(emits.where(F.col("micros") >= V.NOW_MICROS), 1)
    queued = tables.read("outbox").groupBy(F.col("alert_id").alias("id")).agg(F.count("*").alias("n_outbox"))
    return tables.read("incidents").join(queued, "id").select("id", "fingerprint", "severity", "status", "occurrence_count", _micros("last_seen", "last_micros"), "n_outbox")


def _new_tables(spark: SparkSession):
    from ..streaming.tables import Tables

    return Tables(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", V.CHANNELS)


OLDEST = f"""WITH RECURSIVE {MERGED}, ob AS (SELECT DISTINCT ON (key) id || ':' || channel || ':' || n AS key, m.last_micros FROM m, (VALUES ('webhook'), ('card')) v(channel) ORDER BY key, m.last_micros),
  r AS (SELECT *, row_number() OVER (ORDER BY last_micros, key) AS place FROM ob)"""


@query(f"""{OLDEST} SELECT key AS idempotency_key, CASE WHEN place BETWEEN 31 AND 40 THEN 'sent' ELSE 'pending' END AS status, CAST(CASE WHEN place <= 40 THEN 1 ELSE 0 END AS INT) AS attempts, CASE WHEN place <= 40 THEN 1 ELSE 0 END AS n_audit FROM r""")
def outbox_overtaken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker claims 30 rows and falls asleep; another one's claim releases them and takes ten others. The first one's results come late:
    they don't count, as its rows have changed since, but its deliveries are in the audit."""
    tables, now = _new_tables(spark), V.now() + F.expr("INTERVAL 3650 DAYS")
    tables.apply(checkpointed(V.emits(spark, sf_dir, V.COARSE)), 0)
    log = lambda rows: rows.select("alert_id", "channel", F.lit(1).alias("success"), "idempotency_key", now.alias("created_at"))
    sent = lambda rows: outbox.mark(rows, F.lit(True), F.lit(None).cast("string"), now)
    first = checkpointed(tables.claim(now, 30))
    second = checkpointed(tables.claim(now + F.expr("INTERVAL 1 HOUR"), 10))
    tables.results(sent(first), log(first))
    tables.results(sent(second), log(second))
    counted = tables.read("audit").groupBy("idempotency_key").agg(F.count("*").alias("n_audit"))
    return tables.read("outbox").join(counted, "idempotency_key", "left").select("idempotency_key", "status", "attempts", F.coalesce("n_audit", F.lit(0)).alias("n_audit"))


@query(f"""WITH RECURSIVE {MERGED}, z AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY k DESC) = 1), y AS (SELECT z.*, e.service, CASE WHEN z.fingerprint = (SELECT min(fingerprint) FROM z) THEN 'resolved' ELSE z.status END AS now_status FROM z JOIN em e USING (event_id)),
  del AS (SELECT event_id % 7 <> 0 AS ok FROM em, (VALUES ('webhook'), ('card')) v(channel))
  SELECT count(*) AS total, count(*) FILTER (now_status = 'open') AS n_open, count(*) FILTER (now_status = 'updated') AS n_updated, count(*) FILTER (now_status = 'acknowledged') AS n_acknowledged, count(*) FILTER (now_status = 'resolved') AS n_resolved,
  count(*) FILTER (severity IN ('ERROR', 'CRITICAL', 'FATAL')) AS n_severe, count(DISTINCT service) AS n_services, (SELECT count(*) FILTER (ok) FROM del) AS dispatch_ok, (SELECT count(*) FILTER (NOT ok) FROM del) AS dispatch_failed, max(last_micros) AS last_micros FROM y""")
def stats_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics from sums that every commit keeps: all emits, all cleared, again in two batches, their deliveries, an operator's action."""
    tables, emits = _new_tables(spark), checkpointed(V.emits(spark, sf_dir, V.COARSE))
    tables.apply(emits, 0)
    tables.clear()
    tables.apply(emits.where(F.col("micros") < V.NOW_MICROS), 1)
    tables.apply(emits.where(F.col("micros") >= V.NOW_MICROS), 2)
    audit = V.deliveries(spark, sf_dir, emits)
    tables.commit(lambda base: {"audit": audit})
    tables.resolve_fingerprint(tables.read("incidents").agg(F.min("fingerprint")).first()[0], V.now())
    return tables.stats().withColumn("last_micros", F.unix_micros("last_seen")).drop("last_seen")


# Streaming

#: Events that a run of a stream takes in at most (but for those of one instant): what its batch holds at once doesn't grow with the table.
SLICE_ROWS = 1_000_000


#: Rows of a slice's row groups: a batch reads its file in several tasks.
GROUP_ROWS = 50_000


def _slices(spark: SparkSession, sf_dir: str, folder: str) -> tuple[list[str], list[int]]:
    """The events as files in the order of their times, SLICE_ROWS or so in each; and the times (microseconds) up to which all but the last go."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, at = max(1, -(-e.count() // SLICE_ROWS)), F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = e.agg(F.percentile_approx(at, [k / n for k in range(1, n)])).first()[0] if n > 1 else []
    slot = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < at)) if cuts else F.lit(0)
    out = e.withColumn("slice", slot).repartition(n, "slice").write.option("maxRecordsPerFile", 0).option("parquet.block.row.count.limit", GROUP_ROWS)
    out.partitionBy("slice").parquet(f"{folder}/slices")
    return [f"{folder}/slices/slice={k}" for k in range(n)], cuts


def _in_turn(spark: SparkSession, slices: list[str], into: str, run: Callable[[], object]) -> list[str]:
    """Slices come into a stream's folder as files whose own times are in their order, by which a stream takes them one to a batch (see ``_sliced``);
    then it runs. Returns where they are now."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(into).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path(into))
    moved, begin = [f"{into}/{k}" for k in range(len(slices))], (int(time.time()) - len(slices)) * 1000
    for k, (a, b) in enumerate(zip(slices, moved, strict=True)):
        if fs.exists(path(a)):
            files = [x.getPath() for x in fs.listStatus(path(a))]
            for file in files:
                fs.setTimes(file, begin + 1000 * k, -1)
            if len(files) != 1 or fs.getFileStatus(files[0]).getModificationTime() != begin + 1000 * k:
                raise OSError(f"{a} isn't one file whose time can be set")
            if not fs.rename(path(a), path(b)):
                raise OSError(f"{a} can't be moved to {b}")
    run()
    return moved


def _sliced(spark: SparkSession, sf_dir: str, into: str, wanted: list[int]) -> DataFrame:
    """A stream over some of the slices in a folder, one to a batch."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{into}/{{{','.join(map(str, wanted))}}}")


@query(f"WITH RECURSIVE {V.emitted('coarse')} SELECT event_id, id, fingerprint, action, severity, CAST(place AS BIGINT) AS occurrence_count FROM em")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful operator on a file stream over the events, in slices of time, read to its end; its changes are gathered in the shared folder."""
    from ..streaming import dedup as stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    slices, _ = _slices(spark, sf_dir, folder)

    def run() -> None:
        events = _sliced(spark, sf_dir, f"{folder}/in", list(range(len(slices))))
        changes = stream.emits(policy.enrich(V.logs_of(events), fields=V.COARSE)).select("event_id", "id", "fingerprint", "action", "severity", "occurrence_count")
        stream.run_available(changes, f"{folder}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))

    _in_turn(spark, slices, f"{folder}/in", run)
    return spark.read.schema("event_id bigint, id string, fingerprint string, action string, severity string, occurrence_count bigint").parquet(f"{folder}/out/*")


@query(f"WITH {V.LOGS} SELECT DISTINCT micros // 100000000 AS ts_ns, service, level AS line FROM logs")
def stream_source_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polls of a source: entries since NOW, then those up to three days after it, which are late, and of which some have come before."""
    from ..streaming import dedup as stream

    folder = f"{shared_folder(spark)}/polls-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    slot = F.floor(F.unix_micros("timestamp") / 100_000_000)
    e = V.logs(spark, sf_dir).select(F.timestamp_seconds(slot * 100).alias("timestamp"), slot.alias("ts_ns"), "service", F.col("level").alias("line"))
    for n, when in enumerate((F.col("timestamp") >= V.now(), F.col("timestamp") < V.now() + F.expr("INTERVAL 3 DAYS"))):
        e.where(when).coalesce(1).write.parquet(f"{folder}/in/poll={n}")
    polls = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    stream.run_available(external.once(polls), f"{folder}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    return spark.read.schema(e.schema).parquet(f"{folder}/out/*").select("ts_ns", "service", "line")


@query(f"WITH RECURSIVE {V.emitted('coarse')} SELECT event_id, id, fingerprint, action, severity, CAST(place AS BIGINT) AS occurrence_count FROM em")
def stream_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream up to NOW, whose states go to a table and leave the operator when they have settled; then one without its checkpoint,
    which begins with the table."""
    from ..streaming import dedup as stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, tables = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", _new_tables(spark)
    slices, cuts = _slices(spark, sf_dir, folder)
    names = ["event_id", "id", "fingerprint", "action", "severity", "occurrence_count"]

    def run(name: str, wanted: list[int], when, initial: DataFrame | None) -> None:
        events = _sliced(spark, sf_dir, f"{folder}/in", wanted)
        enriched = policy.enrich(V.logs_of(events), fields=V.COARSE)

        def write(changes: DataFrame, batch: int) -> None:
            changes.persist()
            changes.where(F.col("action").isin(*stream.EMITTED)).select(*names).write.mode("overwrite").parquet(f"{folder}/out/{name}-{batch}")
            states = stream.latest_states(changes)
            tables.commit(lambda base: {"states": states}, (name, batch))
            changes.unpersist()

        changes = stream.emits(enriched.where(when), settle_seconds=7 * 86_400, keep_states=True, initial=initial)
        stream.run_available(changes, f"{folder}/{name}", write)

    def both() -> None:
        # Slices that have no event of a run aren't batches of it.
        run("before", [0, *[k + 1 for k, c in enumerate(cuts) if c < V.NOW_MICROS]], F.col("timestamp") < V.now(), None)
        run("after", [*[k for k, c in enumerate(cuts) if c >= V.NOW_MICROS], len(slices) - 1], F.col("timestamp") >= V.now(), checkpointed(tables.read("states")))

    _in_turn(spark, slices, f"{folder}/in", both)
    return spark.read.parquet(f"{folder}/out/*")
