"""Sinks for ``foreachBatch`` that are exact when a batch comes again.

A micro-batch that was cut off is given again with its number and its rows. So what a batch writes is
named by that number and replaces what an earlier try of it left: appended rows are a partition of the
batch, running totals and current versions a snapshot made from the one before it. Days of a rollup are
partitions that are replaced as a whole. Tables are read back through ``rows`` and ``snapshot``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Sink = Callable[[DataFrame, int], None]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares, or below the warehouse where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/sinks-{uuid.uuid4().hex}"


def _partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(path: str) -> Sink:
    """Rows of each batch once, in a partition of its own: events, vitals and other logs."""

    def write(df: DataFrame, batch: int) -> None:
        _partitioned(df.withColumn("batch", F.lit(batch)), path, "batch")

    return write


def rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def _held(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The snapshot of the last batch (before this one), or None."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if before is not None:
        table = table.where(F.col("batch") < before)
    last = table.agg(F.max("batch")).first()[0]
    return None if last is None else table.where(F.col("batch") == last).drop("batch")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """What the last batch left."""
    return _held(spark, path)


def _forget(spark: SparkSession, path: str, batch: int, keep: int) -> None:
    """Delete snapshots that no replay can ask for any more: all but the last ``keep``."""
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = sorted(int(s.getPath().getName()[6:]) for s in system.listStatus(folder) if s.getPath().getName().startswith("batch="))
    for old in [n for n in numbers if n < batch][: -keep or None]:
        system.delete(fs.Path(f"{path}/batch={old}"), True)


def adjust(path: str, key: str, amounts: list[str], keep: int = 2) -> Sink:
    """Running totals by key, none below zero after a batch: quotas and counters.

    Each batch writes the totals anew, so it is for totals that are few next to the log (one a workspace).
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.sum(F.coalesce(a, F.lit(0))).alias(a) for a in amounts))
        held = _held(spark, path, batch)
        if held is not None:
            sums = held.unionByName(sums).groupBy(key).agg(*(F.sum(a).alias(a) for a in amounts))
        sums = sums.select(key, *(F.greatest(F.col(a), F.lit(0)).alias(a) for a in amounts))
        _partitioned(sums.withColumn("batch", F.lit(batch)), path, "batch")
        _forget(spark, path, batch, keep)

    return write


def replace_versions(path: str, key: str, version: str, keep: int = 2) -> Sink:
    """The current row of each key, that of the greatest version: a batch replaces older ones and never brings one back."""

    def write(df: DataFrame, batch: int) -> None:
        spark, columns = df.sparkSession, df.columns
        held = _held(spark, path, batch)
        every = df if held is None else held.select(columns).unionByName(df)
        others = F.struct(*(c for c in columns if c != key))
        newest = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(version).alias("by"), others.alias("row"))).alias("newest"))
        current = newest.select(key, "newest.row.*").select(columns)
        _partitioned(current.withColumn("batch", F.lit(batch)), path, "batch")
        _forget(spark, path, batch, keep)

    return write


def daily_rollup(log: Callable[[], DataFrame], path: str, keys: list[str], day: str = "day", days: int = 3) -> Sink:
    """Rollups of the days a batch touches and the ``days`` - 1 before its last, made anew from the whole log and replaced.

    ``log`` reads (day, keys, amounts) of the log as it is now, the batch's rows included; only the named days are read.
    """

    def write(df: DataFrame, batch: int) -> None:
        touched = [r[0] for r in df.select(day).distinct().orderBy(F.desc(day)).limit(1000).collect() if r[0] is not None]
        if not touched:
            return
        recent = F.col(day).isin(touched) | ((F.col(day) > F.date_sub(F.lit(touched[0]), days)) & (F.col(day) <= F.lit(touched[0])))
        own = log().where(recent)
        amounts = [c for c, t in own.dtypes if c not in (day, *keys) and t in ("int", "bigint", "double")]
        _partitioned(own.groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(a).alias(a) for a in amounts)), path, day)

    return write


def run_available(source: DataFrame, sink: Sink, checkpoint: str) -> None:
    """Give all that is there to the sink, in batches, and go on where the last run ended."""
    query = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
