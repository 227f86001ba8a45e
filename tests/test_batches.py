"""What a stream over slices of events costs: one run, a batch for each slice that it needs, few partitions of the state."""

import duckdb
import pytest

from logloom.plans import catalog
from logloom.streaming import dedup as stream


@pytest.mark.parametrize(("name", "runs", "more"), [("stream_dedup", 1, 0), ("stream_restored", 2, 3)])
def test_a_batch_to_a_slice(spark, tiny, monkeypatch, name, runs, more):
    """slices are batches of one run, in order; no run has batches for slices of the other; more: the one that both have, and a last one of timers for each."""
    monkeypatch.setattr(catalog, "SLICE_ROWS", 200)
    monkeypatch.setattr(stream, "PER_CORE", 1)
    seen, run = [], stream.run_available

    def watched(*given):
        query = run(*given)
        seen.append([(p["numInputRows"], p["stateOperators"][0]["numShufflePartitions"]) for p in query.recentProgress])
        return query

    monkeypatch.setattr(stream, "run_available", watched)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        got = sorted(tuple(r) for r in catalog.queries()[name](spark, tiny).collect())
        assert spark.conf.get("spark.sql.shuffle.partitions") == "20"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tiny}/events.parquet'")
    assert got == sorted(db.execute(catalog.oracle_sql()[name]).fetchall())
    assert len(seen) == runs and sum(len(x) for x in seen) <= 5 + more
    assert all(parts == spark.sparkContext.defaultParallelism for x in seen for _, parts in x)
