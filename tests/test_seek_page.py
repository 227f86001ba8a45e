"""Pages by place where there are few incidents."""

import duckdb

from __spark_entry__ import oracle_sql, queries


def test_seek_page_behind_the_last(spark, tmp_path, tiny):
    """where all incidents are on the first page, the third page is empty; it was the first page again."""
    spark.read.parquet(f"{tiny}/events.parquet").orderBy("event_id").limit(20).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert db.execute(oracle_sql()["alerts_list_page"].replace("LIMIT 25 OFFSET 25", "LIMIT 25")).fetchall()
    assert queries()["alerts_seek_page"](spark, str(tmp_path)).collect() == db.execute(oracle_sql()["alerts_seek_page"]).fetchall() == []
