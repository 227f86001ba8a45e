"""The table store, the stream application, the worker and the senders."""

import json
import time
import urllib.error
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from logloom.operators.policy import Policy
from logloom.settings import Settings
from logloom.sinks.logs import FileSink, emit_all
from logloom.sinks.senders import HttpSender, registry, with_payload
from logloom.sources import files, kafka
from logloom.streaming import app
from logloom.streaming.tables import Conflict, ReadModel, Tables
from tests.test_operators import emit

def at(hour):
    return F.lit(datetime(2024, 5, 1, hour, tzinfo=timezone.utc))


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/tables", ["webhook"])


def counts(t):
    return sorted((r.id, r.status, r.occurrence_count) for r in t.read("incidents").collect())


def test_batches(spark, tables):
    for n, e in enumerate([emit(spark, ("a", "f", 1, True)), emit(spark, ("a", "f", 4, False), ("b", "g", 1, True))]):
        tables.apply(e, n)
        tables.apply(e, n)  # a batch that runs again changes nothing
    assert counts(tables) == [("a", "updated", 4), ("b", "open", 1)] and tables.generation() == 2
    assert sorted(r.idempotency_key for r in tables.read("outbox").collect()) == ["a:webhook:1", "a:webhook:4", "b:webhook:1"]
    assert [r.id for r in tables.read("incidents", 1).collect()] == ["a"]  # older generations stay readable
    generation, rows = tables.snapshot(1)
    assert generation == 2 and rows.count() == 1


def test_failure_between_the_tables(spark, tables, monkeypatch):
    """A batch that fails after its incidents are written leaves nothing, and is whole when it runs again."""
    tables.apply(emit(spark, ("a", "f", 1, True)), 0)
    whole = Tables._append

    def broken(self, name, df, seq):
        if name == "outbox":
            raise OSError("lost")
        whole(self, name, df, seq)

    second = emit(spark, ("a", "f", 4, False))
    monkeypatch.setattr(Tables, "_append", broken)
    with pytest.raises(OSError):
        tables.apply(second, 1)
    assert counts(tables) == [("a", "open", 1)] and tables.read("outbox").count() == 1
    monkeypatch.setattr(Tables, "_append", whole)
    tables.apply(second, 1)
    assert counts(tables) == [("a", "updated", 4)] and tables.read("outbox").count() == 2


def test_clear_stays(spark, tables):
    tables.apply(emit(spark, ("a", "f", 1, True)), 0)
    assert tables.clear() == {"incidents": 1, "outbox": 1, "audit": 0}
    tables.apply(emit(spark, ("b", "g", 1, True)), 1)
    assert counts(tables) == [("b", "open", 1)] and tables.read("outbox").count() == 1


def test_operators_write(spark, tables):
    tables.apply(emit(spark, ("a", "f", 1, True), ("b", "g", 1, True)), 0)
    assert tables.set_status("a", "acknowledged", at(1)).first().status == "acknowledged"
    assert tables.set_status("none", "resolved", at(1)) is None
    with pytest.raises(ValueError):
        tables.set_status("a", "suppressed", at(1))
    tables.apply(emit(spark, ("a", "f", 5, False)), 1)  # stays acknowledged, and its policy keeps it out of the outbox
    assert counts(tables)[0] == ("a", "acknowledged", 5) and tables.read("outbox").count() == 2
    assert tables.resolve_fingerprint("g", at(1)) == 1 and tables.resolve_fingerprint("g", at(1)) == 0
    assert counts(tables)[1] == ("b", "resolved", 1)
    tables.apply(emit(spark, ("c", "g", 1, True, False)), 2)  # reopening is not allowed
    assert len(counts(tables)) == 2


def test_two_writers(spark, tables):
    """A commit on an old generation is made again on top of the newer one."""
    other = Tables(spark, tables.folder, ["webhook"])
    tables.apply(emit(spark, ("a", "f", 1, True)), 0)
    seen = []

    def change(base):
        seen.append(base)
        if len(seen) == 1:
            other.set_status("a", "acknowledged", at(1))
        return {"widgets": spark.createDataFrame([("w", "W", [("env", "prod")])], "id string, title string, labels array<struct<key:string,value:string>>")}

    assert tables.commit(change) == 3 and seen == [1, 2]
    with pytest.raises(Conflict):
        tables._record(3, {})
    assert counts(tables) == [("a", "acknowledged", 1)] and tables.widgets().count() == 1


def test_compaction(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t", ["webhook"], compact_every=3)
    for n in range(6):
        t.apply(emit(spark, ("a", "f", n + 1, n == 0)), n)
    assert counts(t) == [("a", "updated", 6)] and t.read("outbox").count() == 6
    assert len(t.entry(t.generation())["tables"]["incidents"]) <= 4
    t.compact()
    assert t.vacuum() > 0 and counts(t) == [("a", "updated", 6)] and t.read("outbox").count() == 6


def test_widgets(spark, tables):
    kind = "id string, title string, labels array<struct<key:string,value:string>>, status_filter string, sort_order int"
    row = lambda i, title, order: spark.createDataFrame([(i, title, [("env", "prod")], "", order)], kind)
    tables.save_widget(row("a", "A", 2), at(1))
    tables.save_widget(row("b", "B", 1))
    tables.save_widget(row("a", "A2", 0))
    got = tables.widgets().collect()
    assert [(r.id, r.title) for r in got] == [("a", "A2"), ("b", "B")] and got[0].created_at < got[0].updated_at
    with pytest.raises(ValueError):
        tables.save_widget(spark.createDataFrame([("c", "C", [], "", 1)], kind))
    assert tables.drop_widget("a") and not tables.drop_widget("a") and [r.id for r in tables.widgets().collect()] == ["b"]


def test_worker(spark, tables):
    """Rows are delivered, failures come again later, what the audit has as sent isn't sent twice."""
    tables.apply(emit(spark, ("a", "f", 1, True), ("b", "g", 1, True)), 0)
    worker = app.Worker(tables, Settings(max_attempts=2), {"webhook": lambda row: {"success": "\"id\":\"a\"" in row["payload"], "status_code": 200 if "\"id\":\"a\"" in row["payload"] else 503}})
    assert worker.run_once(at(1)) == {"sent": 1, "failed": 1}
    assert worker.run_once(at(1)) == {}
    assert sorted((r.alert_id, r.success) for r in tables.read("audit").collect()) == [("a", 1), ("b", 0)]
    later = at(2)
    assert worker.run_once(later) == {"dead": 1}
    assert tables.redrive(later) == 1 and tables.redrive(later, status="sent") == 1  # the sent one is in the audit
    assert worker.run_once(later) == {"sent": 1, "failed": 1} and tables.read("audit").count() == 4
    stuck = tables.claim(at(3))
    assert stuck.count() == 1
    much = at(4)
    assert tables.claim(much, 1).count() == 1  # released after its time
    assert tables.delete_outbox(status="sent") == 1 and tables.read("outbox").count() == 1
    with pytest.raises(ValueError):
        tables.delete_outbox()


def test_senders():
    asked, waits = [], []

    def answers(*given):
        left = list(given)

        def post(url, body, headers, timeout):
            asked.append((url, json.loads(body), dict(headers), timeout))
            got = left.pop(0)
            if isinstance(got, Exception):
                raise got
            return got

        return post

    send = lambda *given: HttpSender("http://x/y", {"A": "b"}, 3.0, post=answers(*given), sleep=waits.append)({"payload_json": "{\"k\":1}"})
    assert send((200, "ok")) == {"success": True, "status_code": 200, "response_body": "ok", "error_message": None}
    assert asked == [("http://x/y", {"k": 1}, {"A": "b"}, 3.0)]
    assert send(urllib.error.URLError("down"), (503, "busy"), (201, "made"))["success"] and waits == [0.5, 1.0]
    assert send((400, "no"))["error_message"] == "HTTP 400" and len(asked) == 5
    lost = send(*[TimeoutError("late")] * 3)
    assert not lost["success"] and lost["status_code"] is None and lost["error_message"] == "late"
    made = registry({"webhook": "http://a", "card": ""}, "{\"X\": 1}")
    assert list(made) == ["webhook"] and made["webhook"].headers == {"X": "1"} and registry({"w": "http://a"}, "no json")["w"].headers == {}


def test_payloads_by_channel(spark, tables):
    tables.channels = ["webhook", "card", "ops", "other"]
    tables.apply(emit(spark, ("a", "f", 1, True)), 0)
    got = {r.channel: json.loads(r.payload) for r in with_payload(tables.read("outbox"), {"ops": "paging"}).collect()}
    assert got["webhook"]["id"] == "a" and got["card"]["@type"] == "MessageCard" and got["ops"]["entity_id"] == "f" and got["other"]["id"] == "a"


def lines(*events):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n"


def event(second, message="boom", level="ERROR", service="s"):
    return {"timestamp": (datetime(2024, 5, 1, tzinfo=timezone.utc) + timedelta(seconds=second)).isoformat(), "level": level, "service": service, "message": message}


def test_application(spark, tmp_path):
    """Files to incidents, outbox and dead letters; a restart goes on where the last run ended; a late event is merged."""
    (tmp_path / "in").mkdir()
    settings = Settings(input_path=f"file://{tmp_path}/in", tables=f"file://{tmp_path}/tables", checkpoint=f"file://{tmp_path}/c")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(name, *events):
        (tmp_path / "in" / name).write_text(lines(*events))
        made = app.App(spark, settings, Policy.of({"defaults": {"dedup_window_seconds": 300, "refire_interval_seconds": 60}}))
        made.run_available()
        return made

    first = run("1.json", event(0), event(10), event(100), event(5, level="info"), "no json", {"timestamp": "never", "message": "x"})
    got = first.tables.read("incidents").collect()
    assert [(r.occurrence_count, r.status) for r in got] == [(3, "updated")] and first.tables.read("outbox").count() == 2
    assert sorted((r.reason, r.payload) for r in first.letters().collect()) == [("invalid_timestamp", '{"timestamp": "never", "message": "x"}'), ("unparseable", "no json")]
    second = run("2.json", event(90), event(170))  # the first one is late: it is counted, and moves last_seen back
    got = second.tables.read("incidents").collect()
    assert [(r.occurrence_count, r.id == got[0].id) for r in got] == [(5, True)]
    third = run("3.json", event(900))
    assert len(third.tables.read("incidents").collect()) == 1 and third.tables.read("outbox").count() == 4
    again = run("3.json", event(900))
    assert again.tables.generation() == third.tables.generation()


def test_settings_choose_the_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.warns(UserWarning):
        assert app.records(spark, Settings(source="range", input_path=str(tmp_path / "in"))).columns == ["value"]
    assert app.records(spark, Settings(range_url="http://localhost:1", input_path="x")).columns == ["value"]
    with pytest.raises(ValueError):
        app.records(spark, Settings())
    with pytest.raises(ValueError):
        Settings(source="else")
    with pytest.warns(UserWarning):
        assert app.load_policy(Settings(policy_paths=(str(tmp_path / "none.yaml"),))) == Policy()
    (tmp_path / "p.yaml").write_text("defaults: {min_level: WARN}\n")
    assert app.load_policy(Settings(policy_paths=(str(tmp_path / "none.yaml"), str(tmp_path / "p.yaml")))).defaults == {"min_level": "WARN"}


def test_read_model(spark, tables):
    model = ReadModel(tables, 10, 3600)
    assert model.get().count() == 0
    tables.apply(emit(spark, ("a", "f", 1, True)), 0)
    assert model.get().count() == 0  # not looked again yet
    model.invalidate()
    assert [r.id for r in model.page().collect()] == ["a"] and model.about()["generation"] == 1 and model.about()["rows"] == 1
    kept = model.get()
    model.invalidate()
    assert model.get() is kept  # nothing has changed


def test_sinks_feed_sources(spark, tmp_path):
    """What sources publish as files is what a file stream of the application reads."""
    rows = spark.createDataFrame([(datetime(2024, 5, 1, 0, 0, 0, 123456), "ERROR", "s", "boom")], "timestamp timestamp, level string, service string, message string")
    emit_all(FileSink(f"file://{tmp_path}/in"), rows, rows.withColumn("service", F.lit("t")))
    settings = Settings(input_path=f"file://{tmp_path}/in/*.txt", tables=f"file://{tmp_path}/tables", checkpoint=f"file://{tmp_path}/c")
    made = app.App(spark, settings, Policy.of({}))
    made.run_available()
    got = made.tables.read("incidents").orderBy("service").collect()
    assert [(r.service, r.last_seen) for r in got] == [(s, datetime(2024, 5, 1, 0, 0, 0, 123456)) for s in ("s", "t")]


class StubReader(SimpleDataSourceStreamReader):
    def initialOffset(self):
        return {"n": 0}

    def read(self, start):
        return iter([(b"s", b'{"message":"m"}')] if start["n"] == 0 else []), {"n": 1}

    def readBetweenOffsets(self, start, end):
        return iter([(b"s", b'{"message":"m"}')] if start["n"] == 0 and end["n"] == 1 else [])


class StubTopic(DataSource):
    """Stands in for a topic connector: it wants the same options."""

    @classmethod
    def name(cls):
        return "stub_topic"

    def schema(self):
        return "key binary, value binary"

    def simpleStreamReader(self, schema):
        assert {"kafka.bootstrap.servers", "subscribe", "startingoffsets"} <= {k.lower() for k in self.options}
        return StubReader()


def test_topic_with_a_stub(spark, tmp_path):
    spark.dataSource.register(StubTopic)
    got = []
    q = kafka.read_topic(spark, "h:1", "logs", "earliest", source="stub_topic").writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: got.extend(df.collect())).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.key, r.value) for r in got} == {("s", '{"message":"m"}')}


def test_demo_records(spark, tmp_path):
    got = []
    q = files.demo_logs(spark, 100).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: got.extend(df.collect())).start()
    try:
        while len(got) < 50 and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    made = [json.loads(r.value) for r in got]
    assert {r["service"] for r in made} <= {"payments-api", "checkout", "inventory", "auth-service"} and {"INFO", "ERROR"} <= {r["level"] for r in made}
