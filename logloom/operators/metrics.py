"""Counters and gauges of the pipeline: rows (metric, label, value), and counters that are taken while a query runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _rows(counts: DataFrame, values: dict[tuple[str, str], str]) -> DataFrame:
    """The columns of one row as rows (metric, label, value)."""
    items = [F.struct(F.lit(metric).alias("metric"), F.lit(label).alias("label"), F.col(c).cast("long").alias("value")) for (metric, label), c in values.items()]
    return counts.select(F.inline(F.array(*items)))


def decisions(acted: DataFrame) -> DataFrame:
    """How many events were emitted, and how many the refire interval held back."""
    got = acted.agg(F.count_if(F.col("action") != "suppress").alias("e"), F.count_if(F.col("action") == "suppress").alias("s"))
    return _rows(got, {("emitted", ""): "e", ("skipped", "suppressed"): "s"})


def queue(outbox: DataFrame) -> DataFrame:
    """The outbox's gauges: rows in all, waiting (pending, processing or failed) and dead ones."""
    status = F.col("status")
    got = outbox.agg(F.count("*").alias("n"), F.count_if(status.isin("pending", "processing", "failed")).alias("w"), F.count_if(status == "dead").alias("d"))
    return _rows(got, {("outbox_enqueued", ""): "n", ("outbox_pending", ""): "w", ("outbox_dead", ""): "d"})


def attempts(audit: DataFrame) -> DataFrame:
    """Deliveries by channel and outcome; those that weren't tried have no row."""
    label = F.concat_ws(":", "channel", F.when(F.col("success") == 1, "success").otherwise("failure"))
    return audit.groupBy(label.alias("label")).agg(F.count("*").alias("value")).select(F.lit("dispatch_attempts").alias("metric"), "label", "value")


def observed(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds the counters once an action on df has ended; df isn't read a second time.

    counters: conditions by name; the number of rows is ``rows``. For a stream, pass a name to ``df.observe`` and a listener instead.
    """
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counters.items()]), seen
