"""Writers that overtake each other, reads by key, kept sums, the change feed, and states of a stream that leave and come back."""

import random
import shutil
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logloom.operators import external, incidents, outbox, reads, search
from logloom.settings import Settings
from logloom.streaming import app
from logloom.streaming import dedup as stream
from logloom.streaming.store import Kind, Store
from logloom.streaming.tables import ReadModel, Tables
from tests.test_dedup import ENRICHED, START, expected, rows
from tests.test_operators import emit


def at(hour):
    return F.lit(datetime(2024, 5, 1, hour, tzinfo=timezone.utc))


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/tables", ["webhook"])


def box(t):
    return {r.idempotency_key: (r.status, r.attempts) for r in t.read("outbox").collect()}


def sent(rows):
    log = rows.select("alert_id", "channel", F.lit(1).alias("success"), "idempotency_key", at(1).alias("created_at"))
    return outbox.mark(rows, F.lit(True), F.lit(None).cast("string"), at(1)), log


# Compare and set


def test_results_after_clear(spark, tables):
    """What was cleared while a worker delivered it stays away; the delivery is in the audit."""
    tables.apply(emit(spark, ("a", "f", 1, True)), 0)
    claimed = tables.claim(at(1)).checkpoint()
    assert claimed.count() == 1
    tables.clear()
    tables.results(*sent(claimed))
    assert box(tables) == {} and [r.idempotency_key for r in tables.read("audit").collect()] == ["a:webhook:1"]
    with pytest.raises(ValueError):
        tables.results(claimed.drop("_version"), claimed)


def test_redrive_against_a_worker(spark, tables):
    """A worker's commit comes between the reading and the commit of a redrive: the redrive is made from what it left."""
    tables.apply(emit(spark, ("a", "f", 1, True), ("b", "g", 1, True)), 0)
    claimed = tables.claim(at(1)).checkpoint()
    failed = outbox.mark(claimed, F.lit(False), F.lit("no"), at(1))
    tables.results(failed, sent(claimed)[1].limit(0))
    assert {s for s, _ in box(tables).values()} == {"failed"}
    worker, again = Tables(spark, tables.folder), tables.claim(at(2)).checkpoint()
    tables.results(outbox.mark(again, F.lit(False), F.lit("no"), at(2)), sent(again)[1].limit(0))
    last = tables.claim(at(3)).checkpoint()
    whole, seen = Tables.read, []

    def read(self, name, *more):
        out = whole(self, name, *more)
        if self is tables and name == "outbox" and not seen:
            seen.append(1)
            out = out.checkpoint()
            worker.results(*sent(last))
        return out

    tables.read = read.__get__(tables)
    try:
        assert tables.redrive(at(4), status="processing") == 0
    finally:
        del tables.read
    assert box(tables) == {"a:webhook:1": ("sent", 3), "b:webhook:1": ("sent", 3)} and tables.claim(at(5)).isEmpty()


def test_two_workers_and_a_stale_release(spark, tables):
    """The first worker sleeps until its rows are released and claimed again: only the second one's results count."""
    tables.apply(emit(spark, ("a", "f", 1, True)), 0)
    first = tables.claim(at(1)).checkpoint()
    second = tables.claim(at(2)).checkpoint()
    assert [(r.attempts, r.status) for r in second.collect()] == [(2, "processing")]
    tables.results(outbox.mark(first, F.lit(False), F.lit("late"), at(2)), sent(first)[1].withColumn("success", F.lit(0)))
    assert box(tables) == {"a:webhook:1": ("processing", 2)}
    tables.results(*sent(second))
    assert box(tables) == {"a:webhook:1": ("sent", 2)} and tables.read("audit").count() == 2
    tables.compact()
    assert tables.delete_outbox(["a:webhook:1", "none"]) == 1 and box(tables) == {}


def test_versions_survive_compaction(spark, tables):
    tables.apply(emit(spark, ("a", "f", 1, True)), 0)
    claimed = tables.claim(at(1)).checkpoint()
    tables.apply(emit(spark, ("b", "g", 1, True)), 1)
    tables.compact()
    tables.results(*sent(claimed))
    assert box(tables) == {"a:webhook:1": ("sent", 1), "b:webhook:1": ("pending", 0)}


def test_writers_of_one_number(spark, tables):
    """Two writers that build on the same generation don't touch each other's folders."""
    other = Tables(spark, tables.folder)
    kind = "id string, title string, labels array<struct<key:string,value:string>>"
    tried = []

    def change(base):
        tried.append(base)
        if len(tried) == 1:
            other.save_widget(spark.createDataFrame([("b", "B", [("k", "v")])], kind))
        return {"widgets": spark.createDataFrame([("a", "A", [("k", "v")])], kind)}

    assert tables.commit(change) == 2 and tried == [0, 1] and sorted(r.id for r in tables.widgets().collect()) == ["a", "b"]


# Reads by key


class Small(Store):
    KINDS = {"t": Kind("k STRING, v BIGINT", "k", "k"), "s": Kind("g STRING, n BIGINT", sums=("n",))}


def test_a_probe_reads_its_buckets(spark, tmp_path):
    """A probe of one key reads as many rows and files of a large table as of a small one."""
    found = []
    for n in (400, 6400):
        t = Small(spark, f"file://{tmp_path}/{n}", buckets=4, bucket_rows=100)
        for k in range(2):
            t.commit(lambda base, n=n, k=k: {"t": spark.range(k, n, 2).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))})
        t.compact()
        t.commit(lambda base: {"t": spark.sql("SELECT '7' AS k, 70L AS v")})
        near = spark.sql("SELECT '7' AS k")
        assert [(r.k, r.v) for r in t.read("t", near=near).where("k = '7'").collect()] == [("7", 70)]
        rows_ = t.rows("t", near=near)
        found.append((rows_.select(F.input_file_name()).distinct().count(), rows_.count()))
        assert t.rows("t").count() == n + 1 and "PartitionFilters: [" in rows_._jdf.queryExecution().toString()
        assert t.read("t").agg(F.sum("v")).first()[0] == n * (n - 1) // 2 + 63
    assert found[0][0] == found[1][0] == 2 and found[1][1] < 2 * 100


def test_sums_and_deleted_rows(spark, tmp_path):
    t = Small(spark, f"file://{tmp_path}/t", compact_every=3)
    for k in range(6):
        t.commit(lambda base, k=k: {"s": spark.createDataFrame([("a", k), ("b", -k), ("c", 1 if k % 2 else -1)], "g string, n bigint"), "t": spark.createDataFrame([(str(k % 2), k, k == 5)], "k string, v bigint, _gone boolean")})
    assert {(r.g, r.n) for r in t.read("s").collect()} == {("a", 15), ("b", -15)} and {(r.k, r.v) for r in t.read("t").collect()} == {("0", 4)}
    assert len(t.entry(t.generation())["tables"]["s"]) <= 4


# The change feed


def test_change_feed(spark, tmp_path):
    """After 50 commits a reader reads the folders of those since its own generation, compactions left out."""
    t = Small(spark, f"file://{tmp_path}/t", compact_every=20)
    for k in range(50):
        t.commit(lambda base, k=k: {"t": spark.createDataFrame([(str(k % 5), k)], "k string, v bigint").coalesce(1)})
    end = t.generation()
    got = t.changes("t", end - 3)
    assert {(r.k, r.v) for r in got.collect()} == {(str(k % 5), k) for k in range(47, 50)} and len(got.inputFiles()) == 3
    assert {(r.k, r.v) for r in t.changes("t", 0).collect()} == {(str(k % 5), k) for k in range(45, 50)}
    assert t.changes("t", end).count() == 0
    t.compact()
    t.vacuum()
    assert t.changes("t", end - 3) is None and t.changes("t", end + 1).count() == 0


def alert(spark, *of):
    return spark.createDataFrame([(i, i, "open", datetime(2024, 5, 1, tzinfo=timezone.utc) + timedelta(minutes=m)) for i, m in of], "id string, fingerprint string, status string, last_seen timestamp")


def test_read_model_takes_changes_over(spark, tables, monkeypatch):
    """The kept rows follow the changes; where the last place is in doubt, and after clear, the table is read again."""
    monkeypatch.setattr(Tables, "follow", lambda self, base, wrote: {})
    model = ReadModel(tables, 3, 3600)
    r, place = random.Random(2), {}
    for step in range(7):
        for i in r.sample("abcdefgh", 2):
            place[i] = r.randrange(1000)
        tables.commit(lambda base: {"incidents": alert(spark, *place.items())})
        model.invalidate()
        want = sorted(place, key=lambda i: (-place[i], i))[:3]
        assert [x.id for x in model.get().orderBy(F.desc("last_seen"), "id").collect()] == want, step
    assert model.reloads < 7
    before = model.reloads
    tables.commit(lambda base: {"incidents": alert(spark, ("z", 5000))})
    model.invalidate()
    assert model.page().first().id == "z" and model.reloads == before
    tables.clear()
    model.invalidate()
    assert model.get().count() == 0 and model.reloads == before + 1 and model.about()["age"] is not None


# Kept sums


def whole(t):
    a = t.read("incidents").withColumn("severity", F.col("severity"))
    return reads.stats(a, t.read("audit")).first().asDict()


def test_sums_follow_every_write(spark, tables):
    def check():
        assert tables.stats().first().asDict() == whole(tables)
        assert {r.service for r in tables.services().collect()} == {r.service for r in reads.services(tables.read("incidents")).collect()}
        assert {(r.status, r.n) for r in tables.outbox_counts().collect()} == {(r.status, r.n) for r in outbox.counts(tables.read("outbox")).collect()}
        assert tables.outbox_open().first() == outbox.open_count(tables.read("outbox")).first()

    check()
    tables.apply(emit(spark, ("a", "f", 1, True), ("b", "g", 1, True)), 0)
    tables.apply(emit(spark, ("a", "f", 4, False)), 1)
    tables.set_status("a", "resolved", at(1))
    worker = app.Worker(tables, Settings(), {"webhook": lambda row: {"success": "\"id\":\"a\"" in row["payload"]}})
    worker.run_once(at(1))
    tables.delete_outbox(status="failed")
    check()
    both = tables.with_dispatch_counts(tables.read("incidents")).select("id", "dispatch_ok", "dispatch_failed")
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in reads.with_dispatch_counts(tables.read("incidents").select("id"), tables.read("audit")).select("id", "dispatch_ok", "dispatch_failed").collect()}
    tables.compact()
    check()
    tables.clear()
    check()


# States


def changes_of(spark, tmp_path, events, name, **more):
    table = spark.createDataFrame(rows(events), ENRICHED)
    for k in range(0, len(events), 12):
        table.where(F.col("event_id").between(k, k + 11)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    src = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    got = []
    stream.run_available(stream.emits(src, **more), str(tmp_path / f"{name}-check"), lambda df, n: got.extend(df.collect()))
    return got


def test_states_leave(spark, tmp_path):
    """Each fingerprint is seen for a while only: states are bounded, closing rows say what was, and decisions are those without timers."""
    events = [(i // 6, 400 * i, 300, 60, "ERROR") for i in range(96)]
    events[90] = (14, 400 * 89 - 5, 300, 60, "ERROR")  # late, in the last batches
    got = changes_of(spark, tmp_path, events, "in", settle_seconds=1000)
    want = {i: x for i, x in expected(events).items() if x[0] != "suppress"}
    assert {r.event_id: (r.action, r.occurrence_count, r.severity, r.trace_id) for r in got if r.action in stream.EMITTED} == want
    closed = [r for r in got if r.action == "closed"]
    assert len(closed) >= 10 and all(r.description for r in closed)
    left = spark.read.format("statestore").option("path", str(tmp_path / "in-check")).option("stateVarName", "incident").load().count()
    assert left == 16 - len({r.fingerprint for r in closed}) and left < 6


def test_late_rows_are_kept_with_timers(spark, tmp_path):
    """An event far behind the watermark begins a new incident once its state has left; it isn't dropped."""
    events = [(0, 0, 300, 60, "ERROR")] + [(1, 1000 * i, 300, 60, "ERROR") for i in range(1, 30)] + [(0, 100, 300, 60, "ERROR"), (2, 5, 300, 60, "ERROR")]
    got = {r.event_id: r.action for r in changes_of(spark, tmp_path, events, "in", settle_seconds=1000) if r.action in stream.EMITTED}
    assert got[30] == "new" and got[31] == "new"


def test_a_lost_checkpoint(spark, tmp_path):
    """The application goes on with the states of its tables, as if nothing had happened; suppressed events count."""
    import json

    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(folder, tables, name, *seconds):
        (tmp_path / folder).mkdir(exist_ok=True)
        line = lambda s: json.dumps({"timestamp": (datetime(2024, 5, 1, tzinfo=timezone.utc) + timedelta(seconds=s)).isoformat(), "level": "ERROR", "service": "s", "message": "boom"})
        (tmp_path / folder / name).write_text("\n".join(line(s) for s in seconds) + "\n")
        settings = Settings(input_path=f"file://{tmp_path}/{folder}", tables=f"file://{tmp_path}/{tables}", checkpoint=f"file://{tmp_path}/c-{tables}")
        made = app.App(spark, settings, app.Policy.of({"defaults": {"dedup_window_seconds": 100, "refire_interval_seconds": 150}}))
        made.run_available()
        return made

    run("in", "lost", "1.json", 0, 90)  # the second one is suppressed, and moves the window on
    states = spark.read.format("statestore").option("path", f"{tmp_path}/c-lost/incidents").option("stateVarName", "incident").load().select("value.*")
    kept = Tables(spark, f"file://{tmp_path}/lost").read("states")
    same = [c for c in kept.columns if c != "labels"]  # a state store gives an empty map back as null
    assert [tuple(r) for r in states.select(*same).collect()] == [tuple(r) for r in kept.select(*same).collect()]
    shutil.rmtree(tmp_path / "c-lost")
    lost = run("in2", "lost", "2.json", 170)
    run("all", "kept", "1.json", 0, 90)
    same = run("all", "kept", "2.json", 170)
    show = lambda a: [(r.status, r.occurrence_count, r.last_seen) for r in a.tables.read("incidents").collect()]
    assert show(lost) == show(same) and show(lost)[0][:2] == ("updated", 3)
    again = run("in2", "lost", "3.json", 171)  # a restart with the new checkpoint
    assert show(again) == show(lost) and again.tables.read("states").first().occurrence_count == 4


def test_the_application_clamps(spark, tmp_path):
    """Times far ahead of the wall clock count as now, so the next event of today isn't a second incident."""
    import json

    (tmp_path / "in").mkdir()
    now = datetime.now(timezone.utc)
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"timestamp": (now + timedelta(seconds=s)).isoformat(), "level": "ERROR", "service": "s", "message": "boom"}) for s in (0, 86_400)) + "\n")
    made = app.App(spark, Settings(input_path=f"file://{tmp_path}/in", tables=f"file://{tmp_path}/t", checkpoint=f"file://{tmp_path}/c"), app.Policy.of({}))
    made.run_available()
    assert made.tables.read("incidents").count() == 1


# Sources


def test_late_entries_and_repeats(spark, tmp_path):
    """An entry an hour late is kept, repeats over polls go, whichever comes first."""
    kind = "timestamp timestamp, ts_ns string, service string, line string, labels map<string,string>"
    entry = lambda second, line, service="s": (START + timedelta(seconds=second), str(second), service, line, {"a": line})
    polls = [[entry(7200, "x"), entry(7201, "y"), entry(7201, "y")], [entry(7201, "y"), entry(3600, "late"), entry(7202, "z"), entry(7201, "y", None)], [entry(3600, "late"), entry(7201, "y", None), entry(7203, "end")]]
    for p in polls:
        spark.createDataFrame(p, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    stream.run_available(external.once(src), str(tmp_path / "c"), lambda df, n: got.extend(df.collect()))
    assert sorted((r.ts_ns, r.service or "", r.line, r.labels["a"]) for r in got) == sorted({(e[1], e[2] or "", e[3], e[3]) for p in polls for e in p})


# Reads


def some_alerts(spark, n=60):
    r = random.Random(1)
    t = lambda i: datetime(2024, 5, 1, tzinfo=timezone.utc) + timedelta(seconds=r.randrange(20), microseconds=i % 3)
    kind = "id string, title string, sample_message string, fingerprint string, error_code string, service string, status string, severity string, labels map<string,string>, last_seen timestamp"
    rows_ = [(f"i{i:03d}", f"Disk {i} full", None if i % 7 == 0 else f"Überlauf nr {i * i}", f"fp{i % 9}", None if i % 2 else "E", "s", ("open", "resolved")[i % 2], "ERROR", {"Env": ("Prod", "dev")[i % 2], "zone": str(i % 4)}, None if i == 5 else t(i)) for i in range(n)]
    return spark.createDataFrame(rows_, kind)


def test_pages_by_tokens(spark):
    """Pages chained by tokens are those by numbers; rows that come before the place move nothing."""
    a = some_alerts(spark).checkpoint()
    order = [F.desc_nulls_last("last_seen"), F.col("id")]
    want = [r.id for r in a.orderBy(*order).collect()]
    got, token, pages = [], None, 0
    while True:
        page, token = reads.alerts_after(a, token, 25)
        got += [r.id for r in page.orderBy(*order).collect()]
        pages += 1
        if token is None:
            break
    assert got == want and pages == 3
    _, token = reads.alerts_after(a, None, 25)
    more = a.unionByName(a.limit(3).withColumns({"id": F.concat(F.lit("new"), "id"), "last_seen": F.lit(datetime(2025, 1, 1))}))
    assert [r.id for r in reads.alerts_after(more, token, 25)[0].orderBy(*order).collect()] == want[25:50]
    assert [r.id for r in reads.alerts_after(a, None, 25, status="open")[0].orderBy(*order).collect()] == [r.id for r in a.where("status = 'open'").orderBy(*order).limit(25).collect()]
    with pytest.raises(ValueError):
        reads.alerts_after(a, "nonsense")
    with pytest.raises(ValueError):
        reads.seek(a, reads.NEWEST_ALERTS, reads.token_of(a.first(), (("id", True),)))


def test_search_by_trigrams(spark, tmp_path):
    a = some_alerts(spark).checkpoint()
    path = f"file://{tmp_path}/index"
    search.build(a, path)
    for q in ("full", "DISK 1", " überlauf NR 4", "nr 36", "fp3", "E s", "none of this", "l", "", "aaaa", "1 full"):
        found = search.find(spark, path, a, q)
        assert {r.id for r in found.rows.collect()} == {r.id for r in (a.where(reads.contains(q)) if q.strip() else a).collect()}, q
    report = search.find(spark, path, a, "überlauf nr 25").report()
    assert report["matches"] <= report["candidates"] < 20 and 0 < report["postings"] < search.postings(a).count() / 2


def test_many_widgets(spark):
    a = some_alerts(spark).where("last_seen is not null").checkpoint()
    r, made = random.Random(4), []
    for i in range(5000):
        specs = [(r.choice(["env", " ENV ", "zone", "none", " "]), r.choice(["prod", "DEV", "", "1", "3"])) for _ in range(r.randrange(1, 4))]
        made.append((f"w{i}", specs, r.choice(["", None, "open", " resolved , open", "closed"])))
    table = spark.createDataFrame([(w, [{"key": k, "value": v} for k, v in s], f) for w, s, f in made], "id string, labels array<struct<key:string,value:string>>, status_filter string")
    got = {}
    for x in reads.widget_matches(table, a).select("widget_id", "id", "place").orderBy("widget_id", "place").collect():
        got.setdefault(x.widget_id, []).append(x.id)
    alerts = a.orderBy(F.desc("last_seen"), "id").collect()
    want = {}
    for w, specs, given in made:
        states = [x.strip() for x in (given or "").split(",") if x.strip()]
        asked = [(k.strip().lower(), v.strip().lower()) for k, v in specs if k.strip()]
        labels = lambda x: [(k.lower(), v.lower()) for k, v in x.labels.items()]
        fit = [x.id for x in alerts if (not states or x.status in states) and all(any(k == key and (not value or v == value) for k, v in labels(x)) for key, value in asked)]
        if fit:
            want[w] = fit[:10]
    assert got == want


def test_the_range_mode_runs(spark, tmp_path):
    """The application polls a store; an entry whose own time is an hour ago, in a later poll, is an incident like the others."""
    import json
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    now = datetime.now(timezone.utc)
    entries = []

    def add(message, ago):
        at_ = (now - timedelta(seconds=ago)).isoformat()
        entries.append((time.time_ns(), json.dumps({"time": at_, "level": "ERROR", "service": "s", "msg": message})))

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            values = [[str(t), line] for t, line in list(entries) if int(asked["start"]) <= t < int(asked["end"])][: int(asked["limit"])]
            body = json.dumps({"status": "success", "data": {"resultType": "streams", "result": [{"stream": {"job": "j"}, "values": values}]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *more):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    add("first", 0)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    made = app.App(spark, Settings(range_url=f"http://127.0.0.1:{server.server_port}", range_seconds=1, tables=f"file://{tmp_path}/t", checkpoint=f"file://{tmp_path}/c"), app.Policy.of({}))
    queries = made.start()

    def wait(n):
        until = time.time() + 120
        while time.time() < until and all(q.isActive for q in queries) and made.tables.read("incidents").count() < n:
            time.sleep(1)

    try:
        wait(1)
        add("an hour late", 3600)
        wait(2)
    finally:
        for q in queries:
            q.stop()
        server.shutdown()
    got = {r.sample_message: r.last_seen.astimezone(timezone.utc) for r in made.tables.read("incidents").collect()}
    assert set(got) == {"first", "an hour late"} and abs((now - got["an hour late"]).total_seconds() - 3600) < 2


def test_merge_over_slices_of_time(spark):
    """Counts of a storm that lies in many slices are those of one emit after another, with an active row before it and without."""
    r = random.Random(8)
    made = [(f"i{k}", r.choice("fgh"), r.choice([1, 2, 5, 9, 40]), r.random() < 0.2) for k in range(90)]
    spread = lambda df: df.withColumn("micros", F.col("event_id") * 1_500_000_000)
    table, _ = incidents.merge(None, emit(spark, ("old", "f", 6, True)))
    after, stored = incidents.merge(table, spread(emit(spark, *made)))
    count, want = {"f": 6}, []
    for k, (_, fp, n, new) in enumerate(made):
        count[fp] = n if fp not in count else count[fp] + 1 if new else max(n, count[fp] + 1)
        want.append(count[fp])
    assert [x.occurrence_count for x in stored.orderBy("event_id").collect()] == want
    assert {x.fingerprint: x.occurrence_count for x in after.collect()} == count
    assert [x.fingerprint for x in stored.where("is_new").orderBy("fingerprint").collect()] == ["g", "h"]
