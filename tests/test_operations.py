"""Settings, metrics, and tables that are cleared."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.operators import metrics, reads
from logloom.settings import Settings


def test_settings_from_environment():
    got = Settings.from_env({"LOGLOOM_CHANNELS": "webhook, card,", "LOGLOOM_OUTBOX_BATCH": "7", "LOGLOOM_TABLES": "", "OTHER": "x"})
    assert (got.channels, got.outbox_batch, got.tables, got.max_attempts) == (("webhook", "card"), 7, "", 8)
    for bad in ({"LOGLOOM_OUTBOX_BATCH": "many"}, {"LOGLOOM_MAX_ATTEMPTS": "0"}, {"LOGLOOM_RANGE_URL": "ftp://x"}):
        with pytest.raises(ValueError):
            Settings.from_env(bad)


def test_counters_of_a_running_query(spark):
    df, seen = metrics.observed(spark.createDataFrame([("new",), ("suppress",), ("update",)], "action string"), suppressed=F.col("action") == "suppress")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "suppressed": 1}


def test_metrics_of_empty_and_small_tables(spark):
    acted = spark.createDataFrame([("new",), ("suppress",), ("update",), ("suppress",)], "action string")
    assert {tuple(r) for r in metrics.decisions(acted).collect()} == {("emitted", "", 2), ("skipped", "suppressed", 2)}
    box = spark.createDataFrame([("pending",), ("sent",), ("dead",), ("failed",)], "status string")
    assert {r.metric: r.value for r in metrics.queue(box).collect()} == {"outbox_enqueued": 4, "outbox_pending": 2, "outbox_dead": 1}
    assert {r.value for r in metrics.queue(box.limit(0)).collect()} == {0}
    audit = spark.createDataFrame([("card", 1), ("card", 0), ("card", 1)], "channel string, success int")
    assert {r.label: r.value for r in metrics.attempts(audit).collect()} == {"card:success": 2, "card:failure": 1}
    assert metrics.attempts(audit.limit(0)).count() == 0


def test_dispatch_pages_and_lookups(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", "a:1", at(1)), ("b", "b:1", at(2)), ("a", "a:2", at(3)), ("a", "a:3", at(3))], "alert_id string, idempotency_key string, created_at timestamp")
    keys = lambda df: [r.idempotency_key for r in df.collect()]
    assert keys(reads.dispatch_page(rows, "a", 1, 2)) == ["a:3", "a:2"]
    assert keys(reads.dispatch_page(rows, "a", 2, 2)) == ["a:1"]
    assert keys(reads.dispatch_page(rows, None, 0, 3)) == ["a:3", "a:2", "b:1"]
    alerts = spark.createDataFrame([("b",), ("c",)], "id string")
    assert keys(reads.dispatches_of(rows, alerts)) == ["b:1"]
    assert [r.id for r in reads.alert_by_id(alerts, "c").collect()] == ["c"]
