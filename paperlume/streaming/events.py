"""Streaming forms of the event log: deduplication, counters and rollups; see state.py for sessions and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(log: DataFrame, key: str = "idempotency_key", at: str = "occurred_at", delay: str = "1 hour") -> DataFrame:
    """Each key once. State is bounded by the watermark: a replay later than ``delay`` counts again."""
    return log.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counters(log: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts by key and kind, for update mode."""
    return log.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))


def windowed_rollup(log: DataFrame, at: str = "occurred_at", width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts and dwell by window and tenant, for append mode once a window is closed."""
    return log.withWatermark(at, delay).groupBy(F.window(at, width), "tenant").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("dwell_ms"))
