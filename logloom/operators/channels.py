"""Payloads of the notification channels, as JSON columns over alert rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import level

#: Card colours by severity.
COLOURS = {"CRITICAL": "FF0000", "ERROR": "E81123", "WARN": "FFB900", "INFO": "0078D4", "DEBUG": "69797E"}
DASH = "—"


def webhook() -> Column:
    names = ("id", "fingerprint", "title", "description", "severity", "service", "host", "status", "occurrence_count", "first_seen", "last_seen", "error_code", "trace_id", "labels", "sample_message", "is_new")
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def _text() -> Column:
    return F.when(F.coalesce("sample_message", F.lit("")) != "", F.col("sample_message")).otherwise(F.col("description"))


def colour() -> Column:
    out = F.lit("E81123")
    for name, value in COLOURS.items():
        out = F.when(level(F.col("severity")) == name, value).otherwise(out)
    return out


def card() -> Column:
    state = F.when(F.col("is_new"), "NEW").otherwise(F.upper("status"))
    shown = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(DASH)
    facts = {
        "Service": F.col("service"), "Host": F.col("host"), "Severity": F.col("severity"), "Occurrences": F.col("occurrence_count").cast("string"),
        "Fingerprint": F.col("fingerprint"), "Error code": shown("error_code"), "Trace ID": shown("trace_id"),
    }
    section = F.struct(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in facts.items()]).alias("facts"), _text().alias("text"))
    return F.to_json(F.struct(
        F.lit("MessageCard").alias("@type"), F.lit("http://schema.org/extensions").alias("@context"), colour().alias("themeColor"), F.col("title").alias("summary"),
        F.concat(F.lit("["), state, F.lit("] "), F.col("title")).alias("title"), F.array(section).alias("sections"),
    ))


def paging_severity() -> Column:
    s = F.lower("severity")
    return F.when(s.isin("warn", "warning"), "warning").when(s.isin("fatal", "critical"), "critical").when(s == "error", "error").otherwise("info")


def paging() -> Column:
    inner = F.struct(F.col("id").alias("alert_id"), "service", "host", "occurrence_count", "error_code", "trace_id", "labels")
    return F.to_json(F.struct(
        F.col("title").alias("message"), _text().alias("summary"), F.when(F.col("status") == "resolved", "resolve").otherwise("trigger").alias("alert_type"),
        paging_severity().alias("severity"), F.col("fingerprint").alias("entity_id"), inner.alias("payload"),
    ), {"ignoreNullFields": "false"})
