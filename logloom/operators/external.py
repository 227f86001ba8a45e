"""Answers of a range-query log store and bodies of an alert webhook, flattened to log_event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import epoch_guess

#: Label keys of each field, in order; where a level's name isn't known (see ``alert_level``).
SERVICE_KEYS = ("service", "app", "application", "job", "container", "name", "k8s_app")
HOST_KEYS = ("host", "hostname", "pod", "instance", "node", "k8s_pod_name")
LEVEL_KEYS = ("level", "severity", "log_level", "lvl")
TRACE_KEYS = ("trace_id", "traceId", "traceid", "tid")
CODE_KEYS = ("error_code", "code", "errorCode")
MESSAGE_KEYS = ("message", "msg", "error", "text", "log")
TIME_KEYS = ("timestamp", "@timestamp", "time")
RANGE_SOURCE, ALERT_SOURCE = "grafana-loki", "grafana-alerting"

RANGE_ANSWER = "status string, data struct<resultType:string, result:array<struct<stream:map<string,string>, values:array<array<string>>>>>"
ALERT_ITEM = "struct<status:string, labels:map<string,string>, annotations:map<string,string>, startsAt:string, starts_at:string, fingerprint:string>"
ALERT_BODY = f"receiver string, status string, state string, alertname string, groupLabels map<string,string>, group_labels map<string,string>, labels map<string,string>, annotations map<string,string>, startsAt string, fingerprint string, alerts array<{ALERT_ITEM}>"


def present(m: Column) -> Column:
    """A label map without null values; null counts as empty."""
    return F.coalesce(F.map_filter(m, lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>"))


def pick(m: Column, keys: Sequence[str]) -> Column:
    """The first value that isn't empty: for each key its exact form, then any case."""
    found = []
    for key in keys:
        found.append(F.nullif(F.try_element_at(m, F.lit(key)), F.lit("")))
        found.append(F.nullif(F.try_element_at(_folded(m, key), F.lit(-1))["value"], F.lit("")))
    return F.coalesce(*found)


def _folded(m: Column, key: str) -> Column:
    return F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == key.lower())


def merged(*maps: Column) -> Column:
    """Later maps win."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without(out, m), m)
    return out


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(other), k))


def range_entries(answers: DataFrame, value_col: str = "value", now: Column | None = None, in_order: bool = False) -> DataFrame:
    """answers' JSON texts to log_event rows (with source, line and raw), malformed entries left out.

    A time that can't be read is now. raw is the record as it came: a JSON line as it is, another one with its stream's labels.
    With in_order rows are sorted by time, which only a reader of single answers needs.
    """
    now = F.current_timestamp() if now is None else now
    got = answers.select(F.from_json(F.col(value_col), RANGE_ANSWER).alias("a")).select(F.explode("a.data.result").alias("s"))
    rows = got.select(present(F.col("s.stream")).alias("stream"), F.explode("s.values").alias("pair")).where(F.size("pair") >= 2)
    rows = rows.select("stream", F.col("pair")[0].alias("ts_ns"), F.col("pair")[1].alias("line"))
    nested = F.when(F.regexp_replace("line", r"(?U)^\s+", "").startswith("{"), F.try_parse_json("line"))
    rows = rows.withColumn("n", F.when(F.schema_of_variant(nested).startswith("OBJECT"), nested))
    text = lambda key: F.try_variant_get("n", f"$['{key}']", "string")
    some = lambda keys: F.coalesce(*[F.nullif(text(k), F.lit("")) for k in keys])
    inner = F.col("n").isNotNull()
    extra = F.when(inner, present(F.from_json(F.get_json_object("line", "$.labels"), "map<string,string>"))).otherwise(F.create_map().cast("map<string,string>"))
    exact = lambda keys: F.coalesce(*[F.try_element_at("stream", F.lit(k)) for k in keys])
    stamp = F.coalesce(F.when(inner, F.try_to_timestamp(some(TIME_KEYS))), epoch_guess(F.col("ts_ns").try_cast("decimal(38,0)")), now)
    raw = F.when(inner, F.col("line")).otherwise(F.to_json(F.struct("line", F.col("stream").alias("labels"))))
    labels = merged(F.col("stream"), extra)
    labels = F.when(F.array_contains(F.map_keys(labels), "source"), labels).otherwise(F.map_concat(labels, F.create_map(F.lit("source"), F.lit(RANGE_SOURCE))))
    out = rows.select(
        stamp.alias("timestamp"), F.upper(F.coalesce(F.when(inner, F.coalesce(*[text(k) for k in LEVEL_KEYS])), pick(F.col("stream"), LEVEL_KEYS), F.lit("INFO"))).alias("level"),
        F.coalesce(F.when(inner, some(SERVICE_KEYS)), pick(F.col("stream"), SERVICE_KEYS), F.lit("unknown")).alias("service"),
        F.coalesce(F.when(inner, some(HOST_KEYS)), pick(F.col("stream"), HOST_KEYS), F.lit("unknown")).alias("host"),
        F.coalesce(F.when(inner, some(MESSAGE_KEYS)), F.col("line"), F.lit("")).alias("message"),
        F.when(inner, F.coalesce(*[text(k) for k in CODE_KEYS])).otherwise(exact(CODE_KEYS)).alias("error_code"),
        F.when(inner, F.coalesce(*[text(k) for k in TRACE_KEYS])).otherwise(exact(TRACE_KEYS)).alias("trace_id"),
        labels.alias("labels"), F.lit(RANGE_SOURCE).alias("source"), "ts_ns", "line", raw.alias("raw"),
    )
    return out.orderBy("timestamp", "ts_ns", "line") if in_order else out


def alert_level(severity: Column, firing: Column) -> Column:
    up = F.upper(severity)
    known = F.when(up == "HIGH", "ERROR").when(up == "WARNING", "WARN").when(up.isin("CRITICAL", "ERROR", "WARN", "INFO", "DEBUG"), up)
    return F.coalesce(F.when(severity.isNull(), F.when(firing, "CRITICAL").otherwise("INFO")), known, F.when(firing, "ERROR").otherwise("INFO"))


def alert_entries(bodies: DataFrame, value_col: str = "value", now: Column | None = None) -> DataFrame:
    """Webhook bodies to log_event rows: each of ``alerts``, else the body as a single alert if it looks like one."""
    now = F.current_timestamp() if now is None else now
    b = F.from_json(F.col(value_col), ALERT_BODY)
    src = bodies.select(b.alias("b"))
    state = F.lower(F.coalesce("b.state", F.lit("firing")))
    status = F.coalesce("b.status", F.when(state.isin("ok", "resolved", "normal"), "resolved").otherwise("firing"))
    labels = F.coalesce("b.labels", F.when(F.col("b.alertname").isNotNull(), F.create_map(F.lit("alertname"), F.col("b.alertname"))))
    alone = F.struct(status.alias("status"), labels.alias("labels"), F.col("b.annotations").alias("annotations"), F.col("b.startsAt").alias("startsAt"), F.lit(None).cast("string").alias("starts_at"), F.col("b.fingerprint").alias("fingerprint"))
    looks = F.col("b.labels").isNotNull() | F.col("b.alertname").isNotNull() | F.col("b.state").isNotNull()
    items = F.when(F.size(F.coalesce("b.alerts", F.expr("array()"))) > 0, F.col("b.alerts")).when(looks, F.array(alone))
    rows = src.select(F.col("b.receiver").alias("receiver"), F.coalesce("b.groupLabels", "b.group_labels").alias("group"), F.explode(items).alias("a")).where("a is not null")
    rows = rows.select("receiver", present(F.col("group")).alias("group"), present(F.col("a.labels")).alias("l"), present(F.col("a.annotations")).alias("n"), F.lower(F.coalesce(F.nullif(F.col("a.status"), F.lit("")), F.lit("firing"))).alias("state"), F.coalesce(F.nullif(F.col("a.startsAt"), F.lit("")), F.nullif(F.col("a.starts_at"), F.lit(""))).alias("starts"), F.col("a.fingerprint").alias("fp"))
    entry = lambda m, key: F.nullif(F.try_element_at(m, F.lit(key)), F.lit(""))
    said = F.coalesce(*[entry("n", k) for k in ("summary", "description", "message")], entry("l", "alertname"), F.lit("Grafana alert"))
    renamed = lambda m, lead: F.transform_keys(m, lambda k, v: F.concat(F.lit(lead), k))
    own = F.create_map(F.lit("source"), F.lit(ALERT_SOURCE), F.lit("grafana_status"), F.col("state"))
    optional = lambda key, c: F.when(F.coalesce(c, F.lit("")) != "", F.create_map(F.lit(key), c)).otherwise(F.create_map().cast("map<string,string>"))
    base = merged(renamed(F.col("n"), "annotation_"), F.col("l"), own, optional("grafana_receiver", F.col("receiver")))
    everything = merged(renamed(F.col("group"), "group_"), base, optional("grafana_fingerprint", F.col("fp")))
    return rows.select(
        F.when(F.col("starts").contains("T"), F.try_to_timestamp("starts")).otherwise(now).alias("timestamp"), alert_level(pick(F.col("l"), LEVEL_KEYS), F.col("state") == "firing").alias("level"),
        F.coalesce(pick(F.col("l"), SERVICE_KEYS), pick(F.col("l"), ("alertname",)), F.lit("grafana")).alias("service"), F.coalesce(pick(F.col("l"), HOST_KEYS), F.lit("unknown")).alias("host"),
        F.when(F.col("state") == "resolved", F.concat(F.lit("[resolved] "), said)).otherwise(said).alias("message"), F.coalesce(entry("l", "error_code"), F.try_element_at("l", F.lit("alertname"))).alias("error_code"),
        F.coalesce(entry("l", "trace_id"), F.try_element_at("l", F.lit("traceId"))).alias("trace_id"), everything.alias("labels"), F.lit(ALERT_SOURCE).alias("source"),
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of several sources; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def once(entries: DataFrame, keys: Sequence[str] = ("ts_ns", "service", "line"), ttl_seconds: int = 86_400) -> DataFrame:
    """Entries without repeats; on a stream a repeat is what comes again within ttl_seconds of its first arrival, and nothing is too late."""
    if entries.isStreaming:
        from ..streaming.once import once as on_stream

        return on_stream(entries, keys, ttl_seconds=ttl_seconds)
    return entries.dropDuplicates(list(keys))
