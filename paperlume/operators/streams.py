"""The event log as a stream into sinks: what the tables hold once every batch has come, some of them twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table
from ..streaming import sinks
from .quality import DECLARED_SQL, evaluations

#: Of the files of a stream, how many make a batch.
FILES = 4


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # As a pattern the path may be one file or a folder of files.
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/{name}.parque[t]")


def _twice(sink: sinks.Sink) -> sinks.Sink:
    """A sink that gets every batch twice, as after a failure between its write and its commit."""

    def write(df: DataFrame, batch: int) -> None:
        sink(df, batch)
        sink(df, batch)

    return write


def _vitals(log: DataFrame) -> DataFrame:
    return log.where("value IS NOT NULL").select("event_id", F.col("event_type").alias("metric"), "value", F.col("ts").alias("occurred_at"))


@query("sink_vitals", "SELECT event_id, event_type AS metric, value, ts AS occurred_at FROM events WHERE value IS NOT NULL")
def sink_vitals(spark, sf_dir):
    """Measurements that arrive in batches, appended once each."""
    folder = sinks.shared_folder(spark)
    sinks.run_available(_vitals(_stream(spark, sf_dir, "events")), _twice(sinks.append(f"{folder}/vitals")), f"{folder}/state")
    return sinks.rows(spark, f"{folder}/vitals")


@query("adjust_quota", "SELECT user_id % 50 AS tenant, greatest(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 1000) AS BIGINT) END), 0)::BIGINT AS bytes, count(*) AS files FROM events WHERE user_id IS NOT NULL GROUP BY tenant")
def adjust_quota(spark, sf_dir):
    """Running totals of each tenant after all batches of its events."""
    folder = sinks.shared_folder(spark)
    bytes_of = F.when(F.col("event_type") == "error", 0).otherwise(F.round(F.col("value") * 1000).cast("long"))
    log = _stream(spark, sf_dir, "events").where("user_id IS NOT NULL").select((F.col("user_id") % 50).alias("tenant"), bytes_of.alias("bytes"), F.lit(1).cast("long").alias("files"))
    sinks.run_available(log, _twice(sinks.adjust(f"{folder}/quota", "tenant", ["bytes", "files"])), f"{folder}/state")
    return sinks.snapshot(spark, f"{folder}/quota")


@query("version_replace", "SELECT file, arg_max(event_id, event_id) AS version, arg_max(event_type, event_id) AS state FROM (SELECT user_id AS file, event_id, event_type FROM events WHERE user_id IS NOT NULL) GROUP BY file")
def version_replace(spark, sf_dir):
    """The current version of each file, the last of all that came."""
    folder = sinks.shared_folder(spark)
    log = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("version"), F.col("event_type").alias("state"))
    sinks.run_available(log, _twice(sinks.replace_versions(f"{folder}/files", "file", "version")), f"{folder}/state")
    return sinks.snapshot(spark, f"{folder}/files")


@query("daily_rollup_sink", "SELECT CAST(ts AS DATE) AS day, user_id % 20 AS tenant, count(*) AS n, sum(CAST(round(value * 1000) AS BIGINT))::BIGINT AS dwell FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def daily_rollup_sink(spark, sf_dir):
    """Days of the log, made anew and replaced as their events come."""
    folder = sinks.shared_folder(spark)
    days = lambda log: log.where("ts IS NOT NULL").select(F.to_date("ts").alias("day"), (F.col("user_id") % 20).alias("tenant"), F.round(F.col("value") * 1000).cast("long").alias("dwell"))
    sink = sinks.daily_rollup(lambda: days(table(spark, sf_dir, "events")), f"{folder}/days", ["tenant"])
    sinks.run_available(days(_stream(spark, sf_dir, "events")), _twice(sink), f"{folder}/state")
    return spark.read.parquet(f"{folder}/days")


@query("sink_quality", f"WITH {DECLARED_SQL} SELECT metric_id, value, samples, measured_at, evidence, severity, samples < least AS skipped, state FROM log")
def sink_quality(spark, sf_dir):
    """Measurements judged by the declared metrics as they come, and appended once each."""
    folder = sinks.shared_folder(spark)
    append = sinks.append(f"{folder}/evaluations")
    judged = lambda df, batch: append(evaluations(df), batch)
    sinks.run_available(_stream(spark, sf_dir, "events"), _twice(judged), f"{folder}/state")
    return sinks.rows(spark, f"{folder}/evaluations").select("metric_id", "value", "samples", "measured_at", "evidence", "severity", "skipped", "state")
