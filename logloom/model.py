"""Closed domains and schemas of the data model."""

from __future__ import annotations

#: Severity ranks, by normalised level.
LEVEL_RANK = {"DEBUG": 10, "INFO": 20, "WARN": 30, "ERROR": 40, "CRITICAL": 50}
LEVEL_ALIASES = {"WARNING": "WARN", "FATAL": "CRITICAL"}

SEVERE = ("ERROR", "CRITICAL", "FATAL")

ACTIVE = ("open", "updated", "acknowledged")
SETTABLE = (*ACTIVE, "resolved")
OUTBOX_OPEN = ("pending", "processing", "failed")
CLAIMABLE = ("pending", "failed")
REDRIVABLE = ("dead", "failed")
OUTBOX_STATUSES = ("pending", "processing", "sent", "failed", "dead")

DEDUP_FIELDS = ("service", "level", "labels", "message")
WINDOW_SECONDS, REFIRE_SECONDS, FUTURE_SECONDS = 300, 60, 300

ALERT = (
    "id STRING, fingerprint STRING, title STRING, description STRING, severity STRING, service STRING, host STRING, status STRING, occurrence_count BIGINT, "
    "first_seen TIMESTAMP, last_seen TIMESTAMP, error_code STRING, trace_id STRING, labels MAP<STRING, STRING>, sample_message STRING, is_new BOOLEAN"
)
ALERT_ROW = ALERT.removesuffix(", is_new BOOLEAN") + ", acknowledged_at TIMESTAMP, resolved_at TIMESTAMP, tta_seconds BIGINT, ttr_seconds BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP"
OUTBOX = (
    "idempotency_key STRING, alert_id STRING, channel STRING, payload_json STRING, status STRING, attempts INT, next_attempt_at TIMESTAMP, last_error STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
DISPATCH = "alert_id STRING, channel STRING, success INT, status_code INT, response_body STRING, error_message STRING, idempotency_key STRING, created_at TIMESTAMP"
