"""Substring search over incidents by an index of trigrams.

A term's matches hold all of its trigrams, so they are among the incidents whose postings for the term's trigrams are complete; these
few are then compared with the term itself. Postings are stored by a hash of the trigram (Spark's ``partitionBy``), so a search reads
only the folders of its trigrams. A term of less than three characters has no trigram: then all incidents are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reads import contains, searched

GRAM, BUCKETS = 3, 64


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def postings(alerts: DataFrame) -> DataFrame:
    """(gram, id) of every trigram of every incident's text, once each."""
    text = searched()
    grams = F.when(F.char_length(text) >= GRAM, F.transform(F.sequence(F.lit(1), F.char_length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM))))
    return alerts.select("id", F.explode(F.array_distinct(grams)).alias("gram"))


def build(alerts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of some incidents; a bucket of frequent trigrams is several tasks' work."""
    rows = postings(alerts).withColumn("bucket", _bucket(F.col("gram"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


@dataclass
class Found:
    rows: DataFrame
    postings: DataFrame | None
    candidates: DataFrame

    def report(self) -> dict[str, int]:
        """How many postings were read, how many incidents they left, and how many of these match."""
        return {"postings": 0 if self.postings is None else self.postings.count(), "candidates": self.candidates.count(), "matches": self.rows.count()}


def find(spark: SparkSession, path: str, alerts: DataFrame, q: str, buckets: int = BUCKETS) -> Found:
    """The incidents whose text holds q, in any case, without regard to spaces around it."""
    term = q.strip().lower()
    grams = sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})
    if not grams:
        return Found(alerts.where(contains(q)) if term else alerts, None, alerts)
    asked = spark.createDataFrame([(g,) for g in grams], "gram string")
    places = sorted({r.b for r in asked.select(_bucket(F.col("gram"), buckets).alias("b")).collect()})
    read = spark.read.schema("id string, gram string, bucket int").parquet(path).where(F.col("bucket").isin(*places) & F.col("gram").isin(*grams))
    whole = read.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")
    candidates = alerts.join(whole, "id", "left_semi")
    return Found(candidates.where(contains(q)), read, candidates)
