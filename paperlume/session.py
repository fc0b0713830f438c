"""Session factory with the settings every job in this library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Bytes of an Arrow batch of a Python function. Without a bound a batch has 10,000 rows, whatever texts they hold.
BATCH_BYTES = "1m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python functions to ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def build_session(master: str | None = None, **overrides: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``overrides`` win over the defaults."""
    builder = SparkSession.builder.appName("paperlume")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
