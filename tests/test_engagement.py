"""Engagement queries on planted tables."""

import datetime as dt

import duckdb

from paperlume.operators import engagement
from paperlume.plans import registry


def test_all_files_are_ranked(spark, tmp_path):
    spark.range(100, 110).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    found = registry.QUERIES["files_engagement"](spark, str(tmp_path)).collect()
    assert [(r["file_id"], r["n_events"]) for r in found] == [(k, 0) for k in range(100, 106)]


def test_most_events_come_first(spark):
    log = spark.createDataFrame([(k, "opened", 10, s) for k, n in ((500, 3), (70, 2), (1, 1)) for s in range(n)], "file_id long, kind string, duration_ms long, session_id long")
    files = spark.range(1000).withColumnRenamed("id", "file_id")
    assert [tuple(r) for r in engagement.files_engagement(log, files, 4).collect()] == [(500, 3, 3, 30, 3), (70, 2, 2, 20, 2), (1, 1, 1, 10, 1), (0, 0, 0, 0, 0)]


def test_rows_without_a_value_are_samples(spark, tmp_path):
    """28 days are counted from the newest row, the first instant included; a kind needs 20 rows, not 20 values."""
    newest, rows = dt.datetime(2024, 3, 1), []
    for kind, back, values in (
        ("view", dt.timedelta(0), [None if k % 5 < 2 else k / 10 for k in range(25)]), ("click", dt.timedelta(0), [None] * 20), ("error", dt.timedelta(0), [1.0] * 19),
        ("purchase", dt.timedelta(days=28), [float(k) for k in range(20)]), ("signup", dt.timedelta(days=28, microseconds=1), [1.0] * 30), ("other", dt.timedelta(1), [None] * 5 + [float(k) for k in range(5, 21)]),
    ):
        rows += [(len(rows) + k, newest - back, 1, kind, value, '{"k": 1}') for k, value in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = {tuple(r) for r in registry.QUERIES["vitals_p75"](spark, str(tmp_path)).select("kind", "samples", "p75").collect()}
    assert found == {("opened", 25, 1850.0), ("asked", 20, None), ("downloaded", 20, 14250.0), (None, 21, 16250.0)}
    con = duckdb.connect()
    for name, path in (("events", tmp_path / "events.parquet" / "*.parquet"), ("orders", "/root/testdata/sf0.001/orders.parquet"), ("lineitem", "/root/testdata/sf0.001/lineitem.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    assert set(con.execute(registry.ORACLE_SQL["vitals_p75"]).fetchall()) == found
