"""A Python data source that polls a log store's range queries; its offset is the end of the time that has been read.

    spark.dataSource.register(RangeLogs)
    spark.readStream.format("range_logs").option("url", ...).option("query", ...).load()

A batch covers the time from the last end to now, and is cut into ``slices`` of time that tasks read side by side: answers go
from the store to the executors, none through the driver. Each batch begins ``overlap_seconds`` before the last end, so entries may come
twice: ``operators.external.once`` drops repeats. A slice asks again from its last entry on while the store answers with as many
entries as the limit; where a full answer holds one time only, it asks for that time with a larger limit until the answer isn't full.
Spark writes a batch's bounds down before it reads: entries of a batch that fails come again.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SECOND = 1_000_000_000


def http_get(url: str, options: dict[str, str]) -> dict:
    request = urllib.request.Request(url, headers={"Accept": "application/json"})
    if options.get("bearertoken"):
        request.add_header("Authorization", f"Bearer {options['bearertoken']}")
    elif options.get("username"):
        request.add_header("Authorization", "Basic " + base64.b64encode(f"{options['username']}:{options.get('password', '')}".encode()).decode())
    if options.get("orgid"):
        request.add_header("X-Scope-OrgID", options["orgid"])
    with urllib.request.urlopen(request, timeout=float(options.get("timeout", 30))) as answer:
        return json.load(answer)


def _stamps(answer: dict) -> list[int]:
    return [int(pair[0]) for s in answer.get("data", {}).get("result", []) for pair in s.get("values", [])]


def pages(get: Callable[..., dict], start: int, end: int, limit: int) -> Iterator[dict]:
    """Answers for [start, end): while one is full, the next begins at its newest entry."""
    while start < end:
        answer, asked = get(start, end), limit
        stamps = _stamps(answer)
        while len(stamps) >= asked and min(stamps) == max(stamps) == start:  # a full answer of one time: all of that time
            asked *= 2
            answer = get(start, start + 1, asked)
            stamps = _stamps(answer)
        yield answer
        if asked > limit:
            start += 1
            continue
        if len(stamps) < limit:
            return
        start = max(stamps)


@dataclass
class Slice(InputPartition):
    start: int
    end: int


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def now(self) -> int:
        return int(self.options["now_ns"]) if "now_ns" in self.options else time.time_ns()

    def get(self, start: int, end: int, limit: int | None = None) -> dict:
        limit = int(self.options.get("limit", 1000)) if limit is None else limit
        if "answers" in self.options:  # a file with one answer, for tests
            with open(self.options["answers"]) as f:
                answer = json.load(f)
            left = limit
            for s in answer["data"]["result"]:
                s["values"] = sorted((p for p in s["values"] if start <= int(p[0]) < end), key=lambda p: int(p[0]))[:left]
                left -= len(s["values"])
            return answer
        asked = {"query": self.options["query"], "start": start, "end": end, "limit": limit, "direction": "forward"}
        return http_get(self.options["url"].rstrip("/") + "/loki/api/v1/query_range?" + urllib.parse.urlencode(asked), self.options)

    def initialOffset(self) -> dict:
        if "start_ns" in self.options:
            return {"end": int(self.options["start_ns"])}
        return {"end": self.now() - int(self.options.get("lookback_seconds", 60)) * SECOND}

    def latestOffset(self) -> dict:
        return {"end": self.now()}

    def partitions(self, start: dict, end: dict) -> Sequence[Slice]:
        if end["end"] <= start["end"]:
            return []
        low, n = start["end"] - int(self.options.get("overlap_seconds", 1)) * SECOND, max(1, int(self.options.get("slices", 8)))
        cuts = [low + (end["end"] - low) * k // n for k in range(n + 1)]
        return [Slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for answer in pages(self.get, partition.start, partition.end, int(self.options.get("limit", 1000))):
            yield (json.dumps(answer),)


class RangeLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "range_logs"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))
