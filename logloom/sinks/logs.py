"""Sinks of log rows for sources that run as jobs of their own: files of JSON lines, and topics."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from ..operators.parse import wire


class LogSink(Protocol):
    """Takes log rows; what it has taken is there once publish returns, so there is nothing to flush."""

    def publish(self, logs: DataFrame) -> None: ...


class FileSink:
    """JSON records, one a line, in a folder that a file stream may read."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def publish(self, logs: DataFrame) -> None:
        wire(logs).select("value").write.mode("append").text(self.folder)


class TopicSink:
    """JSON records in a topic, keyed by service."""

    def __init__(self, servers: str, topic: str, sink: str = "kafka") -> None:
        self.servers, self.topic, self.sink = servers, topic, sink

    def publish(self, logs: DataFrame) -> None:
        wire(logs).write.format(self.sink).option("kafka.bootstrap.servers", self.servers).option("topic", self.topic).save()


def emit_all(sink: LogSink, *sources: DataFrame) -> None:
    """Rows of several sources to one sink."""
    for logs in sources:
        sink.publish(logs)
