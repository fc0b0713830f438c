"""Stateful streams with state that ends: rate limits by timers of event time, sessions by a time to live.

Both need a state store with column families; ``use_state_store`` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Units that a session remembers at most: the last ones. Fixed value.
KEPT_UNITS = 500
LIMITED = "key string, at timestamp, allowed boolean, remaining long, reset_seconds long"
SESSION = "session string, attempts long, quoted_chars long, answers long, units long"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Windows(StatefulProcessor):
    """A fixed window of ``seconds`` from a key's first hit on; a hit passes as long as the window's cost is at most ``most``.

    A timer at the window's end forgets the key once the watermark has passed it, so the state holds the keys of open windows only.
    """

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "ends_ms long, used long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ends, used = self.window.get() if self.window.exists() else (None, 0)
        before, out = ends, []
        hits = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        for at, cost in zip(hits["at"], hits["cost"]):
            now = at.value // 1_000_000
            if ends is None or ends <= now:
                ends, used = now + self.seconds * 1000, 0
            used += int(cost)
            out.append((key[0], at, used <= self.most, max(self.most - used, 0), -(-(ends - now) // 1000)))
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)
        self.window.update((ends, used))
        yield pd.DataFrame(out, columns=["key", "at", "allowed", "remaining", "reset_seconds"])

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.window.exists() and self.window.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(hits: DataFrame, most: int, seconds: int, key: str = "key", at: str = "at", cost: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Every hit with whether it passes, what is left of its window and when that ends: the columns of ``LIMITED``.

    Hits that come later than ``delay`` behind the latest are dropped, as their window is forgotten.
    """
    weight = F.lit(1) if cost is None else F.col(cost)
    rows = hits.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.coalesce(weight, F.lit(1)).cast("long").alias("cost"))
    return rows.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(Windows(most, seconds), LIMITED, "Append", "EventTime")


class Sessions(StatefulProcessor):
    """What a session has asked, quoted and been answered so far; forgotten ``idle_ms`` after its last request."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "attempts long, quoted long, answers long", ttlDurationMs=self.idle_ms)
        self.units = handle.getListState("units", "unit string", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        attempts, quoted, answers = self.counts.get() if self.counts.exists() else (0, 0, 0)
        seen = dict.fromkeys(u[0] for u in self.units.get()) if self.units.exists() else {}
        requests = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        attempts += int(requests["attempt"].fillna(False).sum())
        quoted += int(requests["quoted"].fillna(0).clip(lower=0).sum())
        answers += int(requests["answered"].fillna(False).sum())
        seen |= dict.fromkeys(requests["unit"].dropna())
        kept = list(seen)[-KEPT_UNITS:]
        self.counts.update((attempts, quoted, answers))
        if kept:
            self.units.put([(u,) for u in kept])
        yield pd.DataFrame({"session": [key[0]], "attempts": [attempts], "quoted_chars": [quoted], "answers": [answers], "units": [len(kept)]})

    def close(self) -> None:
        pass


def session_fold(requests: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """Sessions after each batch of (session, at, attempt, quoted, unit, answered): the columns of ``SESSION``.

    Quoted characters below zero count as none. A session's counters and its last ``KEPT_UNITS`` distinct units live
    ``idle_ms`` of processing time after its last request.
    """
    rows = requests.select(F.col("session").cast("string").alias("session"), "at", *(F.col(c).cast(t).alias(c) for c, t in (("attempt", "boolean"), ("quoted", "long"), ("unit", "string"), ("answered", "boolean"))))
    return rows.groupBy("session").transformWithStateInPandas(Sessions(idle_ms), SESSION, "Update", "ProcessingTime")
