"""Log records in files: one JSON object a line, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def demo_logs(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of made-up records; which service and message depends on the row's number, with repeats."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    pick = lambda values, shift: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.hash(F.shiftright("value", shift)), F.lit(len(values))) + 1).cast("int"))
    level = F.when(F.pmod(F.hash("value"), F.lit(100)) < 15, "INFO").otherwise(pick(("ERROR", "CRITICAL", "WARN"), 2))
    record = F.struct(F.col("timestamp"), level.alias("level"), pick(("payments-api", "checkout", "inventory", "auth-service"), 3).alias("service"), pick(("pod-0", "pod-1", "pod-2"), 1).alias("host"), pick(("replica lags", "job timed out", "checksum differs"), 4).alias("message"))
    return rate.select(F.to_json(record).alias("value"))
