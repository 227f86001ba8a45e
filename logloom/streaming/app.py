"""The application: a stream of records through parsing, the level gate and dedup into the tables, with dead letters aside, and the
worker that delivers what the outbox holds. Everything follows from ``Settings``."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import level
from ..operators import external, outbox, parse
from ..operators.policy import Policy, enrich
from ..settings import Settings
from ..sinks.senders import registry, with_payload
from ..sources import files, kafka
from ..sources.range_logs import RangeLogs
from . import dedup
from .tables import Tables

#: Where a policy is looked for after the configured paths.
SEARCH = ("config/alerts.yaml", "/etc/logloom/alerts.yaml")


def load_policy(settings: Settings) -> Policy:
    """The first policy file that exists; built-in defaults, with a warning, if none does."""
    paths = [*settings.policy_paths, *SEARCH]
    if not any(Path(p).is_file() for p in paths):
        warnings.warn(f"no policy in {', '.join(paths)}: built-in defaults are used", stacklevel=2)
    return Policy.load(*paths)


def mode_of(settings: Settings) -> str:
    """files, topic or range; ``auto`` is the first one that is configured, and a range without an address falls back to files."""
    mode = settings.source
    if mode == "auto":
        mode = "range" if settings.range_url else "topic" if settings.topic_servers else "files"
    if mode == "range" and not settings.range_url:
        warnings.warn("no range_url: records are read from files", stacklevel=3)
        mode = "files"
    return mode


def entries(spark: SparkSession, settings: Settings) -> DataFrame:
    """The log events of a range-query store, each once, however late it comes."""
    spark.dataSource.register(RangeLogs)
    options = {"url": settings.range_url, "query": settings.range_query, "lookback_seconds": str(settings.range_lookback), "limit": str(settings.range_limit)}
    return external.once(external.range_entries(spark.readStream.format("range_logs").options(**options).load()))


def records(spark: SparkSession, settings: Settings) -> DataFrame:
    """The stream of JSON records in ``value`` that the settings name: files, a topic, or a range-query store."""
    mode = mode_of(settings)
    if mode == "range":
        return entries(spark, settings).select(F.to_json(F.struct("timestamp", "level", "service", "host", "message", "error_code", "trace_id", "labels"), {"timestampFormat": parse.WIRE_TIME}).alias("value"))
    if mode == "topic":
        return kafka.read_topic(spark, settings.topic_servers, settings.topic).select("value")
    if not settings.input_path:
        raise ValueError("input_path must be set")
    return files.stream_lines(spark, settings.input_path, settings.files_per_batch)


class App:
    """Times more than ``future_seconds`` ahead of the batch's wall clock (or of ``now_micros``, if given) count as now.

    The state of each fingerprint is also kept in the tables. Where the checkpoint is gone but the tables are there, the stream begins with
    that state, so that its next decisions are those that it would have made.
    """

    def __init__(self, spark: SparkSession, settings: Settings, policy: Policy | None = None, stream: DataFrame | None = None, now_micros: int | Column | None = None) -> None:
        if not settings.tables or not settings.checkpoint:
            raise ValueError("tables and checkpoint must be set")
        self.spark, self.settings = spark, settings
        self.now_micros = F.unix_micros(F.current_timestamp()) if now_micros is None else now_micros
        self.policy = load_policy(settings) if policy is None else policy
        self.tables = Tables(spark, settings.tables, settings.channels)
        #: Entries of a range-query store are events already: they aren't written as JSON to be parsed again, and none is a dead letter.
        self.entries = entries(spark, settings) if stream is None and mode_of(settings) == "range" else None
        self.stream = stream if stream is not None or self.entries is not None else records(spark, settings)

    def enriched(self) -> DataFrame:
        """Records that can be used and pass their level, with policy and fingerprint; a record's number is a hash of it."""
        if self.entries is not None:
            number = F.xxhash64("ts_ns", "service", "line").alias("event_id")
            return enrich(self.entries.select(number, "timestamp", level(F.col("level")).alias("level"), "service", "host", "message", "error_code", "trace_id", "labels"), self.policy)
        parsed = parse.events(parse.parse(self.stream.select("value", F.xxhash64("value").alias("event_id"))))
        return enrich(parsed, self.policy)

    def dead_letters(self) -> DataFrame:
        return parse.dead_letters(parse.parse(self.stream.select("value")))

    def _start(self, df: DataFrame, name: str, write: Callable[[DataFrame, int], None], available: bool) -> StreamingQuery:
        trigger = {"availableNow": True} if available else {"processingTime": f"{self.settings.range_seconds} seconds"}
        return df.writeStream.queryName(f"{name}-{time.time_ns()}").option("checkpointLocation", f"{self.settings.checkpoint}/{name}").trigger(**trigger).foreachBatch(write).start()

    def _run_name(self) -> str:
        """The name of the stream's batches in the tables' log: another one for each checkpoint, whose batches count from 0."""
        return self.spark.read.text(f"{self.settings.checkpoint}/name").first().value

    def _initial(self) -> DataFrame | None:
        """States for a stream without a checkpoint; None where there is one, or nothing to begin with."""
        path = self.tables._hadoop.Path(f"{self.settings.checkpoint}/name")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            return None
        self.spark.createDataFrame([(f"dedup-{uuid.uuid4().hex}",)], "value string").coalesce(1).write.text(f"{self.settings.checkpoint}/name")
        states = self.tables.read("states")
        return None if states.isEmpty() else states

    def _store_changes(self, name: str) -> Callable[[DataFrame, int], None]:
        def store(changes: DataFrame, batch: int) -> None:
            changes.persist()
            try:
                self.tables.apply(changes.where(F.col("action").isin(*dedup.EMITTED)), batch, name, dedup.latest_states(changes))
            finally:
                changes.unpersist()

        return store

    def _store_letters(self, letters: DataFrame, batch: int) -> None:
        letters.withColumn("batch", F.lit(batch)).write.mode("overwrite").json(f"{self.settings.tables}/dead_letters/batch={batch}")

    def start(self, available: bool = False) -> list[StreamingQuery]:
        """The two queries: incidents, and (but for a range-query store) dead letters; with available over all that is there, else for ever."""
        initial = self._initial()
        changes = dedup.emits(self.enriched(), self.now_micros, self.settings.settle_seconds, True, initial, self.settings.future_seconds, timed=self.entries is not None)
        queries = [self._start(changes, "incidents", self._store_changes(self._run_name()), available)]
        return queries if self.entries is not None else [*queries, self._start(self.dead_letters(), "dead-letters", self._store_letters, available)]

    def run_available(self) -> None:
        for query in self.start(True):
            query.awaitTermination()

    def letters(self) -> DataFrame:
        return self.spark.read.schema("reason string, payload string, batch int").json(f"{self.settings.tables}/dead_letters/*")


class Worker:
    """Delivers what is due, a batch at a time. Claims and results are commits of the tables, so several workers may run."""

    def __init__(self, tables: Tables, settings: Settings, senders: Mapping[str, Callable[[dict], dict]] | None = None, kinds: Mapping[str, str] | None = None) -> None:
        self.tables, self.settings, self.kinds = tables, settings, kinds
        self.senders = dict(registry(dict(x.split("=", 1) for x in settings.addresses)) if senders is None else senders)

    def run_once(self, now: Column | None = None) -> dict[str, int]:
        """Claims a batch, delivers it, records the results; how many rows came to which status."""
        now = F.current_timestamp() if now is None else now
        claimed = self.tables.claim(now, self.settings.outbox_batch).checkpoint()
        if claimed.isEmpty():
            return {}
        body = with_payload(claimed, self.kinds)
        done, log = outbox.deliver(body, self.tables.read("audit"), self.senders, now, max_attempts=self.settings.max_attempts)
        done = done.drop("payload").checkpoint()
        self.tables.results(done, log)
        return {r.status: r.n for r in outbox.counts(done).collect()}

    def run(self, stop: Callable[[], bool], pause: float = 1.0) -> None:
        while not stop():
            if not self.run_once():
                time.sleep(pause)
