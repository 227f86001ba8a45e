"""Tables of rows with keys in one folder, with a commit log that several writers share.

Each commit has a number. It appends the rows that it changes (``<table>/part=<number>-<token>/bucket=<b>``, a deleted row as its key
with ``_gone``) and then creates ``_log/<number>.json``, which names the folders that belong to it. A reader looks at committed folders
alone, so a commit is there as a whole or not at all. Of a key's rows the newest counts. Creating a log entry fails if it is there
already; then another writer was first, and the change is made again from the tables as that commit left them. Folders have a token
of their own, so a writer that is late can't overwrite what the other one has written.

**Compare and set.** A row carries ``_version``, the number of the commit that last changed it; compaction keeps it. ``unchanged``
leaves of some rows, read earlier, those that nobody has changed since.

**Buckets.** Rows are laid out by a hash of the table's ``by`` column (Spark's ``partitionBy``). ``near``, rows with that column, limits
a read to the buckets that can hold their keys: one small job finds the buckets, and Spark prunes the others' folders. Compaction sets
the number of buckets by the number of rows, so that a bucket's size doesn't grow with the table.

**Sums.** Tables without a key and with ``sums`` hold numbers to be added up by their other columns; compaction adds them up.

A log entry is as atomic as the file system's rename. ``compact`` writes a table's newest rows to one folder, from where readers
begin; ``vacuum`` then deletes older folders and log entries.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

COMPACT_EVERY, TRIES = 50, 20
#: Log entries that vacuum leaves: far more than a writer can fall behind.
LOG_KEPT = 1000
#: Buckets of a table at first and at most, and rows of a bucket that a compaction aims at.
BUCKETS, MAX_BUCKETS, BUCKET_ROWS = 8, 4096, 100_000
OWN = ("_gone", "_version", "part", "bucket")


class Conflict(Exception):
    """Another writer has made the commit with this number."""


@dataclass(frozen=True)
class Kind:
    """A table: its schema, its key (None: rows are only appended), the column of its buckets, columns that are sums."""

    schema: str
    key: str | None = None
    by: str | None = None
    sums: tuple[str, ...] = ()

    def fields(self) -> StructType:
        return StructType.fromDDL(self.schema)


def bucket_of(by: str | None, n: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(n)).cast("int") if by else F.lit(0)


class Store:
    KINDS: dict[str, Kind] = {}

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = COMPACT_EVERY, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.folder, self.compact_every, self.buckets, self.bucket_rows = spark, folder.rstrip("/"), compact_every, buckets, bucket_rows
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    # The log

    def _numbers(self) -> list[int]:
        log = self._path("_log")
        names = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def generation(self) -> int:
        """The number of the newest commit; 0 before the first one."""
        return max(self._numbers(), default=0)

    def entry(self, seq: int) -> dict[str, Any]:
        """What is there after commit seq: the folders and buckets of each table, the batches that have been applied; and what the commit wrote."""
        if not seq:
            return {"tables": {name: [] for name in self.KINDS}, "buckets": {}, "batches": {}, "wrote": {}, "kind": "change"}
        stream = self._fs.open(self._path(f"_log/{seq:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _record(self, seq: int, entry: dict[str, Any]) -> None:
        """Whole entries only: written under another name, which then becomes the entry's, if nobody has made it."""
        target, made = self._path(f"_log/{seq:012d}.json"), self._path(f"_log/.{seq:012d}-{time.time_ns()}")
        self._fs.mkdirs(self._path("_log"))
        stream = self._fs.create(made, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(made, target):
            self._fs.delete(made, False)
            raise Conflict(seq)

    # Reading

    def _columns(self, name: str) -> list[str]:
        return self.KINDS[name].fields().names

    def _folders(self, name: str, parts: Iterable[str]) -> DataFrame:
        """All row versions in some folders, with ``_gone``, ``_version``, ``part`` and ``bucket``."""
        schema, parts = f"{self.KINDS[name].schema}, _gone BOOLEAN, _version INT, part STRING, bucket INT", list(parts)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/part={p}" for p in parts])

    def _pruned(self, name: str, entry: dict[str, Any], near: DataFrame) -> Column:
        """A condition on part and bucket that holds for every row whose ``by`` value is in near."""
        by, parts = self.KINDS[name].by, entry["tables"][name]
        of = {p: entry["buckets"][p] for p in parts}
        sizes = sorted(set(of.values()))
        found = near.agg(*[F.collect_set(bucket_of(by, n)).alias(f"b{n}") for n in sizes]).first() if sizes else {}
        wanted = F.lit(False)
        for n in sizes:
            hit = sorted(found[f"b{n}"])
            if hit:
                here = F.col("part").isin(*[p for p in parts if of[p] == n])
                wanted = wanted | (here if len(hit) == n else here & F.col("bucket").isin(*hit))
        return wanted

    def rows(self, name: str, at: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """All committed row versions of a table, with near only those of its buckets."""
        entry = self.entry(self.generation() if at is None else at)
        found = self._folders(name, entry["tables"][name])
        return found if near is None or not self.KINDS[name].by else found.where(self._pruned(name, entry, near))

    def current(self, name: str, at: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """A table as of a commit with ``_version``: of each key the newest row, without deleted ones."""
        kind, columns = self.KINDS[name], self._columns(name)
        found = self.rows(name, at, near)
        if kind.key:
            rest = [c for c in columns if c != kind.key]
            newest = found.groupBy(kind.key).agg(F.max_by(F.struct(*rest, "_gone", "_version"), "part").alias("r"))
            found = newest.select(kind.key, "r.*")
        found = found.where("_gone is not true").select(*columns, "_version")
        if kind.sums:
            found = found.groupBy(*[c for c in columns if c not in kind.sums]).agg(*[F.sum(c).alias(c) for c in kind.sums], F.max("_version").alias("_version"))
            found = found.where(" or ".join(f"{c} <> 0" for c in kind.sums)).select(*columns, "_version")
        return found

    def read(self, name: str, at: int | None = None, near: DataFrame | None = None) -> DataFrame:
        return self.current(name, at, near).drop("_version")

    def unchanged(self, name: str, rows: DataFrame, base: int) -> DataFrame:
        """Of rows that carry the ``_version`` they were read with, those that are still there as they were read."""
        key = self.KINDS[name].key
        now = self.current(name, base, rows).select(key, "_version")
        return rows.join(now, [key, "_version"], "left_semi").drop("_version")

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame | None:
        """The rows that commits after since changed, each as the last of them left it, with ``_gone``; only those commits' folders are read.

        None where that can't be told: the table was emptied in between, or vacuum has taken what is needed.
        """
        until, key, parts = self.generation() if until is None else until, self.KINDS[name].key, []
        there = set(self._numbers())
        for seq in range(since + 1, until + 1):
            entry = self.entry(seq) if seq in there else None
            if entry is None or name in entry.get("hid", ()):
                return None
            if entry["kind"] == "change" and name in entry["wrote"]:
                parts.append(entry["wrote"][name])
        if not all(self._fs.exists(self._path(f"{name}/part={p}")) for p in parts):
            return None
        rest = [c for c in self._columns(name) if c != key] + ["_gone"]
        return self._folders(name, parts).groupBy(key).agg(F.max_by(F.struct(*rest), "part").alias("r")).select(key, "r.*")

    # Writing

    def commit(self, change: Callable[[int], dict[str, DataFrame]], batch: tuple[str, int] | None = None, hide: Sequence[str] = ()) -> int:
        """Applies a change, a function from the generation that it builds on to changed rows by table, and gives the new generation.

        The function is called again on the newer tables where another writer was first: what it changes must come from its argument.
        Columns that a change doesn't have are null; ``hide`` names tables whose earlier rows are to be gone. No rows: no commit.
        """
        for _ in range(TRIES):
            base = self.generation()
            entry = self.entry(base)
            if batch and entry["batches"].get(batch[0], -1) >= batch[1]:
                return base
            seq, rows = base + 1, change(base)
            if not rows and not batch and not hide:
                return base
            for name in hide:
                entry["tables"][name] = []
            wrote = {name: self._append(name, df, seq) for name, df in rows.items()}
            for name, df in self.follow(base, wrote).items():
                wrote[name] = self._append(name, df, seq)
            for name, part in wrote.items():
                entry["tables"][name].append(part)
                entry["buckets"][part] = self._size(name, entry)
            if batch:
                entry["batches"][batch[0]] = batch[1]
            try:
                self._record(seq, self._tidy(entry) | {"wrote": wrote, "kind": "change", "hid": list(hide)})
            except Conflict:
                continue
            if self.compact_every and any(len(x) > self.compact_every for x in entry["tables"].values()):
                self.compact(self.compact_every)
            return seq
        raise Conflict(f"no commit after {TRIES} tries")

    def follow(self, base: int, wrote: dict[str, str]) -> dict[str, DataFrame]:
        """Rows of other tables that follow from what a commit wrote (folders by table)."""
        return {}

    def _size(self, name: str, entry: dict[str, Any]) -> int:
        """Buckets of a folder that is appended: as many as the newest compaction chose."""
        sizes = [entry["buckets"][p] for p in entry["tables"][name] if p in entry["buckets"]]
        return max([*sizes, self.buckets]) if self.KINDS[name].by else 1

    @staticmethod
    def _tidy(entry: dict[str, Any]) -> dict[str, Any]:
        live = {p for parts in entry["tables"].values() for p in parts}
        return entry | {"buckets": {p: n for p, n in entry["buckets"].items() if p in live}}

    def _append(self, name: str, df: DataFrame, seq: int, size: int | None = None) -> str:
        """Writes rows to a new folder and gives its name; a bucket is a task's work, a large one that of several."""
        kind, have, part = self.KINDS[name], set(df.columns), f"{seq:012d}-{uuid.uuid4().hex[:12]}"
        size = self._size(name, self.entry(seq - 1)) if size is None else size
        fields = [*kind.fields(), StructField("_gone", BooleanType())]
        version = F.coalesce(F.col("_version"), F.lit(seq)) if "_version" in have else F.lit(seq)
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        out = df.select(*columns, version.cast("int").alias("_version")).withColumn("bucket", bucket_of(kind.by, size)).hint("rebalance", "bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/part={part}")
        return part

    def compact(self, over: int = 1) -> int:
        """A commit in which each table of more than ``over`` folders is one folder, with as many buckets as its rows need."""
        for _ in range(TRIES):
            base = self.generation()
            entry, seq = self.entry(base), base + 1
            for name in [n for n, x in entry["tables"].items() if len(x) > over]:
                rows = self.current(name, base)
                size = self.buckets
                if self.KINDS[name].by:
                    n = rows.count()
                    while size < MAX_BUCKETS and size * self.bucket_rows < n:
                        size *= 2
                part = self._append(name, rows, seq, size if self.KINDS[name].by else 1)
                entry["tables"][name] = [part]
                entry["buckets"][part] = size if self.KINDS[name].by else 1
            try:
                self._record(seq, self._tidy(entry) | {"wrote": {}, "kind": "compact", "hid": []})
                return seq
            except Conflict:
                continue
        raise Conflict(f"no compaction after {TRIES} tries")

    def vacuum(self) -> int:
        """Deletes the folders that the newest commit doesn't need, and old log entries; readers of older generations lose theirs. The number of folders."""
        now = self.generation()
        entry, gone = self.entry(now), 0
        for name in self.KINDS:
            if self._fs.exists(self._path(name)):
                for s in self._fs.listStatus(self._path(name)):
                    part = s.getPath().getName()[5:]
                    if int(part[:12]) <= now and part not in entry["tables"][name]:
                        self._fs.delete(s.getPath(), True)
                        gone += 1
        for seq in self._numbers():
            if seq <= now - LOG_KEPT:
                self._fs.delete(self._path(f"_log/{seq:012d}.json"), False)
        return gone
