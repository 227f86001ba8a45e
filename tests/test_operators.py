"""Parsing, policies, fingerprints, incidents, outbox, reads, sources."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.operators import external, incidents, outbox, parse, policy, reads
from logloom.sources.range_logs import RangeLogs, Reader, pages

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
EMIT = (
    "event_id bigint, micros bigint, id string, fingerprint string, title string, description string, severity string, service string, host string, status string, occurrence_count bigint, first_seen timestamp, "
    "last_seen timestamp, error_code string, trace_id string, labels map<string,string>, sample_message string, is_new boolean, suppress_dispatch_while_acknowledged boolean, allow_reopen_after_resolve boolean"
)


def emit(spark, *items):
    """items: (id, fingerprint, count, is_new)."""
    return spark.createDataFrame([
        (k, k, i, fp, "t", "d", "ERROR", "svc", "h", "open" if new else "updated", n, T0, T0 + timedelta(seconds=k), None, "", {"env": "prod"}, f"m{k}", new, True, allow)
        for k, (i, fp, n, new, allow) in enumerate((*x, True)[:5] for x in items)
    ], EMIT)


def parsed(spark, *records):
    df = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "k int, value string")
    return {r.k: r for r in parse.parse(df, now=F.lit("2024-05-01 00:00:00").cast("timestamp")).collect()}


def test_parse(spark):
    got = parsed(spark, {"level": "Warning", "msg": "", "text": "x", "code": 0, "labels": {"service": "s", "n": 1.0, "t": True}, "time": 1717243200}, "oops", "[1]", {"timestamp": "never"}, {"message": 0, "error": "e", "service": [], "app": "a"}, {"timestamp": ""}, {"code": ""})
    one = got[0].event
    assert (one.level, one.message, one.service, one.error_code, one.labels["n"], one.labels["t"]) == ("WARN", "x", "s", "0", "1.0", "true")
    assert [got[i].reason for i in range(7)] == [None, "unparseable", "unparseable", "invalid_timestamp", None, None, None]
    assert (got[4].event.message, got[4].event.service, got[4].event.level) == ("e", "a", "INFO")
    assert got[6].event.error_code == "" and got[5].event.timestamp is not None


def test_message_normaliser(spark):
    uid = "123E4567-e89b-12d3-a456-426614174000"
    given = f"\t Failed {uid} at 2024-01-02T03:04:05Z  request_id=ab-9 hash {'a' * 32}\n"
    assert spark.range(1).select(text.message(F.lit(given))).first()[0] == "failed <uuid> at <ts> <req> hash <hex>"


def test_fingerprints(spark):
    rows = [("ERROR", "S ", "h1", "boom req_id=1", {"B": "2", "a": "1"}), ("ERROR", "s", "h2", "boom req_id=2", {"a": "1", "b": "2"}), ("ERROR", "s", "h1", "other", {"a": "1", "b": "2"})]
    df = spark.createDataFrame([(i, *r, None, None) for i, r in enumerate(rows)], "k int, level string, service string, host string, message string, labels map<string,string>, error_code string, trace_id string")
    got = [r[0] for r in df.orderBy("k").select(text.fingerprint()).collect()]
    assert got[0] == got[1] != got[2]
    only = [r[0] for r in df.orderBy("k").select(text.fingerprint(["label:A", "host"])).collect()]
    assert only[0] == only[2] != only[1]


def test_policy_layers(spark):
    p = policy.Policy.of({"defaults": {"dedup_fields": "message, level"}, "services": {"a": {"update_interval_seconds": 7}}, "error_codes": {"X": {"dedup_window_seconds": 9}}})
    got = p.resolve(spark.createDataFrame([("a", "X"), ("b", None)], "service string, error_code string")).collect()
    assert [(r.refire_interval_seconds, r.dedup_window_seconds, r.dedup_fields) for r in got] == [(7, 9, "message,level"), (60, 300, "message,level")]
    with pytest.raises(ValueError):
        policy.Policy.of({"defaults": {"dedup_window_seconds": 0}})


def test_merge_counts(spark):
    after, stored = incidents.merge(None, emit(spark, ("a", "f", 1, True), ("a", "f", 10, False), ("b", "f", 1, True)))
    assert [(r.id, r.occurrence_count, r.status) for r in after.collect()] == [("a", 11, "updated")]
    assert [(r.id, r.occurrence_count, r.is_new) for r in stored.orderBy("micros").collect()] == [("a", 1, True), ("a", 10, False), ("a", 11, False)]
    acked = incidents.set_status(after, "a", "acknowledged")
    again, stored = incidents.merge(acked, emit(spark, ("c", "f", 1, True)))
    assert [(r.id, r.occurrence_count, r.status) for r in again.collect()] == [("a", 12, "acknowledged")]
    assert stored.where(incidents.should_enqueue()).count() == 0


def test_same_id_twice(spark):
    after, _ = incidents.merge(None, emit(spark, ("a", "f", 1, True)))
    done = incidents.resolve_fingerprint(after, "f")
    again, _ = incidents.merge(done, emit(spark, ("a", "f", 1, True)))
    ids = [r.id for r in again.collect()]
    assert len(ids) == 2 and len(set(ids)) == 2
    assert incidents.active_rows(again).count() == 1
    first = next(r.id for r in again.collect() if r.status == "resolved")
    with pytest.raises(ValueError):
        incidents.set_status(again, first, "open")
    with pytest.raises(ValueError):
        incidents.set_status(again, first, "suppressed")
    assert incidents.reopen_allowed(emit(spark, ("z", "f", 1, True, False)), done).first().reason == "reopen_disallowed"


def test_lifecycle_times(spark):
    after, _ = incidents.merge(None, emit(spark, ("a", "f", 1, True)))
    at = lambda s: F.lit(T0 + timedelta(seconds=s))
    acked = incidents.set_status(after, "a", "acknowledged", at(90))
    done = incidents.set_status(acked, "a", "resolved", at(300)).first()
    assert (done.tta_seconds, done.ttr_seconds) == (90, 300)
    fast = incidents.set_status(after, "a", "resolved", at(40))
    assert (fast.first().tta_seconds, fast.first().ttr_seconds) == (40, 40)
    back = incidents.set_status(fast, "a", "open", at(50)).first()
    assert back.tta_seconds is back.ttr_seconds is back.resolved_at is back.acknowledged_at is None


def test_outbox(spark):
    now = F.lit(T0)
    e = emit(spark, ("a", "f", 1, True), ("b", "g", 3, True))
    box = outbox.enqueue(e, ["webhook", "card"], now=now)
    assert box.count() == 4 and outbox.enqueue(e, ["webhook", "card"], box, now).count() == 0
    one = outbox.claim(box, now, 3).checkpoint()
    box = outbox.apply_rows(box, one)
    two = outbox.claim(box, now, 3)
    assert (one.count(), two.count()) == (3, 1) and one.where("attempts = 1").count() == 3
    audit = spark.createDataFrame([(one.first().idempotency_key, 1)], "idempotency_key string, success int")
    done, log = outbox.deliver(one, audit, {"webhook": lambda row: {"success": True, "status_code": 200, "response_body": "x" * 5000}}, now)
    got = {r.idempotency_key: r.status for r in done.collect()}
    assert got[one.first().idempotency_key] == "sent" and len(got) == 3
    for r in log.collect():
        assert (r.channel == "webhook") == bool(r.success) and (r.response_body is None or len(r.response_body) == 4000)
    failed = done.where("status = 'failed'")
    assert all(r.next_attempt_at.replace(tzinfo=timezone.utc) == T0 + timedelta(seconds=2) for r in failed.collect())
    assert {r.status for r in outbox.mark(one.withColumn("attempts", F.lit(8)), F.lit(False), F.lit("e"), now).collect()} == {"dead"}
    dead = one.withColumn("status", F.lit("dead"))
    assert outbox.redrive(dead, now).where("status = 'pending' and attempts = 0 and last_error is null").count() == 3
    assert outbox.delete(dead, status="dead").count() == 0


def test_pages(spark):
    df = spark.range(5).withColumnRenamed("id", "n")
    p = reads.page_of(df, ["n"], 3, 2)
    assert (p.pages, p.total, p.has_next, p.has_prev, p.rows.count()) == (3, 5, False, True, 1)
    assert reads.page_from_offset(10, 25) == (3, 10)
    assert reads.page_of(df.where("n < 0"), ["n"]).pages == 0


def test_widgets_need_labels(spark):
    w = spark.createDataFrame([("a", "A", [], "", 1)], "id string, title string, labels array<struct<key:string,value:string>>, status_filter string, sort_order int")
    with pytest.raises(ValueError):
        reads.save_widget(w.limit(0), w)


def test_alert_levels(spark):
    rows = [("fatal", True, "ERROR"), ("fatal", False, "INFO"), ("High", True, "ERROR"), ("warning", True, "WARN"), (None, True, "CRITICAL"), (None, False, "INFO")]
    df = spark.createDataFrame(rows, "s string, firing boolean, want string")
    assert df.where(external.alert_level(F.col("s"), F.col("firing")) != F.col("want")).count() == 0


def test_range_pages_until_drained():
    entries = [(i, f"l{i}") for i in range(25)]

    def get(start, end):
        return {"data": {"result": [{"values": [[str(t), x] for t, x in entries if start <= t < end][:10]}]}}

    seen = {p[1] for a in pages(get, 0, 100, 10) for s in a["data"]["result"] for p in s["values"]}
    assert len(seen) == 25


def test_range_source(spark, tmp_path):
    now = 1_700_000_000 * 10**9
    answer = {"status": "success", "data": {"resultType": "streams", "result": [{"stream": {"app": "a"}, "values": [[str(now - 5 * 10**9), "boom"], [str(now - 500 * 10**9), "old"]]}]}}
    (tmp_path / "a.json").write_text(json.dumps(answer))
    spark.dataSource.register(RangeLogs)
    src = spark.readStream.format("range_logs").option("answers", str(tmp_path / "a.json")).option("start_ns", str(now - 60 * 10**9)).option("now_ns", str(now)).load()
    got = []
    q = src.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: got.extend(external.range_entries(df).collect())).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.service, r.message, r.level) for r in got} == {("a", "boom", "INFO")}


def test_range_slices(tmp_path):
    """Every entry is in exactly one slice of a poll, also where more than the limit share a time."""
    entries = [[str(10 + t // 3), f"l{t}"] for t in range(200)]
    (tmp_path / "a.json").write_text(json.dumps({"data": {"result": [{"stream": {"app": "a"}, "values": entries}]}}))
    reader = Reader({"answers": str(tmp_path / "a.json"), "limit": "2", "overlap_seconds": "0", "slices": "4", "now_ns": "1000", "start_ns": "0"})
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert len(parts) == 4
    seen = [p[1] for part in parts for (text,) in reader.read(part) for s in json.loads(text)["data"]["result"] for p in s["values"]]
    assert set(seen) == {x for _, x in entries}


def test_bad_range_times_and_order(spark):
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    answer = json.dumps({"data": {"result": [{"stream": {"app": "a"}, "values": [["1700000002000000000", "b"], ["bad", "x"], ["1700000001000000000", "{\"msg\":\"a\"}"]]}]}})
    got = external.range_entries(spark.createDataFrame([(answer,)], "value string"), now=now, in_order=True).collect()
    assert [r.message for r in got] == ["a", "b", "x"] and got[2].timestamp == datetime(2024, 5, 1)
    assert json.loads(got[0].raw) == {"msg": "a"} and json.loads(got[1].raw) == {"line": "b", "labels": {"app": "a"}}


def test_records_with_odd_forms(spark):
    """Keys that occur twice count with their last value; ISO 8601 in basic form."""
    got = parsed(spark, '{"message":"a","message":"b","level":"error"}', {"time": "20260615T083000"}, {"time": "20260615T0830Z"}, {"time": "20260615T083000.25+0200"}, {"time": "20260615"}, {"time": "2026061"})
    assert got[0].event.message == "b" and got[0].event.level == "ERROR"
    stamps = [got[k].event.timestamp for k in range(1, 5)]
    assert stamps == [datetime(2026, 6, 15, 8, 30), datetime(2026, 6, 15, 8, 30), datetime(2026, 6, 15, 6, 30, 0, 250000), datetime(2026, 6, 15)]
    assert got[5].reason == "invalid_timestamp"
