"""Streams over events that arrive in several slices of time."""

import duckdb
import pytest

from logloom.plans import catalog


@pytest.mark.parametrize("name", ["stream_dedup", "stream_restored"])
def test_slices(spark, tiny, monkeypatch, name):
    """a run takes in no more than a slice, and the changes are those of the whole table."""
    monkeypatch.setattr(catalog, "SLICE_ROWS", 400)
    sizes, moved = [], catalog._in_turn

    def seen(spark, slices, into, run):
        sizes.append([spark.read.parquet(x).count() for x in slices])
        return moved(spark, slices, into, run)

    monkeypatch.setattr(catalog, "_in_turn", seen)
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, tiny).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tiny}/events.parquet'")
    assert got == sorted(db.execute(catalog.oracle_sql()[name]).fetchall())
    assert all(len(x) == 3 and max(x) <= 500 for x in sizes) and {sum(x) for x in sizes} == {spark.read.parquet(f"{tiny}/events.parquet").count()}
