"""Shards of the positional index come to a task one at a time, however many its partition has."""

import pyarrow as pa
import pyarrow.parquet as pq

from logloom.llm import decontaminate


def test_a_shard_at_a_time(spark, monkeypatch):
    """a shard is a row group, and an Arrow batch of its own."""
    search = decontaminate._search

    def alone(windows, slack):
        go = search(windows, slack)

        def one(batches):
            for batch in batches:
                if batch.num_rows != 1:
                    raise ValueError(f"{batch.num_rows} shards at once")
                yield from go(iter([batch]))

        return one

    monkeypatch.setattr(decontaminate, "_search", alone)
    text = "one two three four " * (decontaminate.SHARD // 16)
    docs = spark.createDataFrame([(k, text + "five" * (k % 2)) for k in range(4)] + [(9, None)], "doc_id long, text string").coalesce(1)
    index = decontaminate.build_index(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert sum(f.num_rows for f in files) > len([f for f in files if f.num_rows]) and all(f.num_row_groups == f.num_rows for f in files)
    assert not any(f.row_group(k).column(c).is_stats_set for f in files for k in range(f.num_row_groups) for c in range(f.num_columns))
    items = spark.createDataFrame([("a", "four five"), ("b", "five one")], "item_id string, text string")
    n = len(text.split())
    assert sorted(tuple(r) for r in decontaminate.find(index, items).select("doc_id", "n_words", "n_hit", "n_items").collect()) == [(0, n, 0, 0), (1, n + 1, 2, 1), (2, n, 0, 0), (3, n + 1, 2, 1), (9, 0, 0, 0)]


def test_shards_across_batches(monkeypatch):
    """Small batches fill a shard together; a longer document comes alone; no document is lost or moved."""
    monkeypatch.setattr(decontaminate, "SHARD", 10)
    texts = ["abc", "", "def", None, "ghij", "k", "a long one, longer than a shard", "l", "m"]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], ["id", "body"]) for i, t in enumerate(texts)]
    assert [x.column("id").to_pylist() for x in decontaminate._shards(iter(batches))] == [[0, 1, 2, 3, 4], [5], [6], [7, 8]]
    assert list(decontaminate._shards(iter([batches[0].slice(0, 0)]))) == []
