"""State that ends, streams that start again, and sinks that get a batch twice."""

import datetime as dt
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from paperlume.streaming import sinks, state

T0 = dt.datetime(2024, 1, 1)
HITS = "key string, at timestamp, cost long"


@pytest.fixture()
def store(spark):
    state.use_state_store(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """Files given one by one to a stream that is stopped and started again for each of them."""

    def __init__(self, spark, folder, schema, make, mode, **trigger):
        self.spark, self.folder, self.schema, self.make, self.mode, self.trigger, self.n = spark, folder, schema, make, mode, trigger, 0
        os.makedirs(f"{folder}/in")

    def give(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/new{self.n}")
        for name in os.listdir(f"{self.folder}/new{self.n}"):
            if name.endswith(".parquet"):
                shutil.move(f"{self.folder}/new{self.n}/{name}", f"{self.folder}/in/{self.n}.parquet")
        got = []
        stream = self.make(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        query = stream.writeStream.foreachBatch(lambda df, batch: got.extend(df.collect())).outputMode(self.mode).option("checkpointLocation", f"{self.folder}/state").trigger(**self.trigger).start()
        assert query.awaitTermination(180)
        return got


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_windows_end_and_survive_a_restart(store, tmp_path):
    feed = Feed(store, str(tmp_path), HITS, lambda s: state.rate_limited(s, 3, 60, cost="cost", delay="10 seconds"), "append", availableNow=True)
    show = lambda rows: sorted((r["key"], (r["at"] - T0).seconds, r["allowed"], r["remaining"], r["reset_seconds"]) for r in rows)
    assert show(feed.give([("a", at(0), 1), ("a", at(1), 2), ("a", at(2), None), ("b", at(2), 9)])) == [("a", 0, True, 2, 60), ("a", 1, True, 0, 59), ("a", 2, False, 0, 58), ("b", 2, False, 0, 60)]
    # The window of a goes on after the restart, and a new one begins where it ends.
    assert show(feed.give([("a", at(59), 1), ("a", at(60), 1)])) == [("a", 59, False, 0, 1), ("a", 60, True, 2, 60)]
    # Far later, both windows have ended and their state with them; late hits are dropped.
    feed.give([("c", at(1000), 1)])
    assert show(feed.give([("a", at(1001), 3), ("a", at(5), 1), ("b", at(1001), 1)])) == [("a", 1001, True, 0, 60), ("b", 1001, True, 2, 60)]


REQUESTS = "session string, at timestamp, attempt boolean, quoted long, unit string, answered boolean"


def test_sessions_fold_and_expire(store, tmp_path):
    # State that lives by the clock asks for a batch after each batch, so the stream runs one for each file.
    feed = Feed(store, str(tmp_path), REQUESTS, lambda s: state.session_fold(s, idle_ms=25_000), "update", once=True)
    show = lambda rows: sorted(tuple(r) for r in rows)
    assert show(feed.give([("s", at(0), True, 120, "a", True), ("s", at(1), False, -50, "b", False), ("t", at(0), None, None, None, None)])) == [("s", 1, 120, 1, 2), ("t", 0, 0, 0, 0)]
    assert show(feed.give([("s", at(2), True, 10, "a", True), ("s", at(3), False, 0, "c", True)])) == [("s", 2, 130, 3, 3)]
    many = [("u", at(k), False, 1, f"unit{k}", True) for k in range(state.KEPT_UNITS + 7)]
    assert show(feed.give(many)) == [("u", 0, state.KEPT_UNITS + 7, state.KEPT_UNITS + 7, state.KEPT_UNITS)]
    time.sleep(26)
    assert show(feed.give([("s", at(9), True, 5, "z", False)])) == [("s", 1, 5, 0, 1)]


def frames(spark, *batches, schema="k string, n long"):
    return [spark.createDataFrame(b, schema) for b in batches]


def test_appended_batches_count_once(spark, tmp_path):
    write, path = sinks.append(str(tmp_path / "log")), str(tmp_path / "log")
    first, second = frames(spark, [("a", 1), ("a", 1)], [("b", 2)])
    for df, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write(df, batch)
    assert sorted(map(tuple, sinks.rows(spark, path).collect())) == [("a", 1), ("a", 1), ("b", 2)]


def test_totals_are_exact_under_replay(spark, tmp_path):
    path = str(tmp_path / "quota")
    write = sinks.adjust(path, "k", ["n"])
    batches = frames(spark, [("a", 5), ("b", 1), (None, 9)], [("a", -9), ("a", None)], [("a", 2), ("c", 4)])
    seen = []
    for df, batch in ((batches[0], 0), (batches[1], 1), (batches[1], 1), (batches[2], 2), (batches[2], 2)):
        write(df, batch)
        seen.append({r["k"]: r["n"] for r in sinks.snapshot(spark, path).collect()})
    assert seen == [{"a": 5, "b": 1}, {"a": 0, "b": 1}, {"a": 0, "b": 1}, {"a": 2, "b": 1, "c": 4}, {"a": 2, "b": 1, "c": 4}]
    for k in range(3, 7):
        write(batches[2], k)
    assert len([n for n in os.listdir(path) if n.startswith("batch=")]) == 3


def test_versions_never_go_back(spark, tmp_path):
    path = str(tmp_path / "files")
    write = sinks.replace_versions(path, "f", "v")
    batches = frames(spark, [("x", 1, "one"), ("y", 7, "seven")], [("x", 3, "three"), ("x", 2, "two")], [("y", 6, "six"), ("z", 1, None)], schema="f string, v long, t string")
    for df, batch in ((batches[0], 0), (batches[1], 1), (batches[1], 1), (batches[2], 2)):
        write(df, batch)
    assert sorted(map(tuple, sinks.snapshot(spark, path).collect()), key=str) == [("x", 3, "three"), ("y", 7, "seven"), ("z", 1, None)]


def test_days_are_replaced(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "days")
    day = lambda d: dt.date(2024, 1, d)
    append, roll = sinks.append(log), sinks.daily_rollup(lambda: sinks.rows(spark, log), path, ["w"])
    batches = frames(spark, [(day(1), "a", 1), (day(5), "a", 2)], [(day(5), "a", 10), (day(5), "b", 1)], [], schema="day date, w string, n2 long")
    for df, batch in ((batches[0], 0), (batches[1], 1), (batches[1], 1), (batches[2], 2)):
        append(df, batch)
        roll(df, batch)
    assert sorted(map(tuple, spark.read.parquet(path).select("day", "w", "n", "n2").collect())) == [(day(1), "a", 1, 1), (day(5), "a", 2, 12), (day(5), "b", 1, 1)]


def test_a_stream_that_lost_its_last_commit_writes_it_again(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).withColumn("k", F.col("id") % 3).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    source = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    path, checkpoint = str(tmp_path / "totals"), str(tmp_path / "state")
    sinks.run_available(source.withColumn("n", F.lit(1)), sinks.adjust(path, "k", ["n"]), checkpoint)
    before = sorted(map(tuple, sinks.snapshot(spark, path).collect()))
    assert sum(n for _, n in before) == 30
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    sinks.run_available(source.withColumn("n", F.lit(1)), sinks.adjust(path, "k", ["n"]), checkpoint)
    assert sorted(map(tuple, sinks.snapshot(spark, path).collect())) == before
