"""Log topics. The connector is a package of its own, given to the session at start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.parse import wire


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "latest", source: str = "kafka", **options: str) -> DataFrame:
    """A stream of key and value of a topic; ``starting`` is earliest or latest where no checkpoint says more.

    ``source`` is the connector's name: another one with the same options may take its place.
    """
    got = spark.readStream.format(source).option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    return got.options(**options).load().selectExpr("cast(key as string) as key", "cast(value as string) as value")


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, sink: str = "kafka"):
    """Log rows as JSON records, keyed by service."""
    return wire(df).writeStream.format(sink).option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
