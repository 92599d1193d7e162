"""ST2 with corrections: requests and verdicts as one keyed state, in any order.

Each request id holds its request row and its newest verdict as value state.
A trigger emits one row per id whose answer changed:

* a request with a verdict, as soon as both are there;
* a request without one, when ``max_delay`` has passed since its time
  (an event-time timer);
* a correction, whenever a newer verdict arrives after that.

State of an id is removed ``keep`` after its time (an event-time timer too, so
a replay behaves alike).  A verdict that comes later still, or one without a
request, is emitted by itself when its state is removed.  ``current`` merges
the emitted rows: the request columns of an id with its newest verdict.  Every
verdict reaches the sink, so ``current`` equals the batch merge K7 / J3,
whatever the order, repetition or delay of the input.

The timers follow the watermark, but no row is dropped for being behind it:
the event-time column is cut off before the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.verdicts import latest_verdicts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGES = ("id long, ts timestamp, routed_model string, cost_usd decimal(18,8), quality_score double, verified_at timestamp")


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


class VerdictState(StatefulProcessor):
    """Value state per request id: the request, its newest verdict, and what was emitted last."""

    def __init__(self, max_delay: timedelta, keep: timedelta) -> None:
        self.delay_us, self.keep_us = (int(d / timedelta(microseconds=1)) for d in (max_delay, keep))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", "ts_us long, routed_model string, cost string")
        self.verdict = handle.getValueState("verdict", "at_us long, score double")
        self.due = handle.getValueState("due", "null_ms long, end_ms long")

    def _row(self, key: tuple) -> pd.DataFrame:
        request = self.request.get() if self.request.exists() else (None, None, None)
        verdict = self.verdict.get() if self.verdict.exists() else (None, None)
        time = lambda us: None if us is None else pd.Timestamp(us, unit="us")
        return pd.DataFrame({"id": [key[0]], "ts": pd.Series([time(request[0])], dtype="datetime64[us]"), "routed_model": [request[1]],
                             "cost": [request[2]], "quality_score": pd.Series([verdict[1]], dtype="float64"),
                             "verified_at": pd.Series([time(verdict[0])], dtype="datetime64[us]")})

    def _timers(self, start_us: int, wait: bool) -> None:
        if self.due.exists():
            for at in set(self.due.get()) - {0}:
                self.handle.deleteTimer(at)
        end = (start_us + self.keep_us) // 1000
        null = (start_us + self.delay_us) // 1000 if wait else 0
        self.due.update((null, end))
        for at in {null, end} - {0}:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, first = self.request.exists(), self.request.get() if self.request.exists() else None
        best = old = tuple(self.verdict.get()) if self.verdict.exists() else None
        for part in rows:
            for r in part.itertuples(index=False):
                if not pd.isna(r.ts):
                    mine = (_micros(r.ts), r.routed_model, r.cost)
                    # of repeated deliveries the least row is the request, in whatever order they come
                    key_of = lambda x: (x[0], x[1] or "", x[2] or "")
                    first = mine if first is None else min(tuple(first), mine, key=key_of)
                if not pd.isna(r.verified_at):
                    seen = (_micros(r.verified_at), None if pd.isna(r.quality_score) else float(r.quality_score))
                    best = seen if best is None else max(best, seen, key=lambda v: (v[0], v[1] is not None, v[1] or 0.0))
        changed = best != old
        if first is not None:
            self.request.update(tuple(first))
        if best is not None and changed:
            self.verdict.update(best)
        if first is not None and (not known or changed):
            self._timers(first[0], wait=best is None)
        elif first is None and not self.due.exists():
            self._timers(best[0], wait=False)
        if first is not None and best is not None and (changed or not known):
            yield self._row(key)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.due.exists():
            return
        null, end = self.due.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        alone = self.request.exists() != self.verdict.exists()
        if at == null and alone:
            yield self._row(key)
        if at >= end:
            if not self.request.exists() and self.verdict.exists():
                yield self._row(key)
            for state in (self.request, self.verdict, self.due):
                state.clear()

    def close(self) -> None:
        pass


def verdict_changes(requests: DataFrame, verdicts: DataFrame, sink_path: str, checkpoint: str, lateness: str = "1 hour",
                    max_delay: timedelta = timedelta(hours=1), keep: timedelta = timedelta(days=30),
                    trigger: dict | None = None) -> StreamingQuery:
    """Start the stream of request / verdict changes into ``sink_path`` (see :func:`current`)."""
    spark = requests.sparkSession
    none = lambda kind: F.lit(None).cast(kind)
    r = requests.select("id", "ts", "routed_model", F.col("cost_usd").cast("string").alias("cost"), none("double").alias("quality_score"),
                        none("timestamp").alias("verified_at"), F.col("ts").alias("at"))
    v = verdicts.select("id", none("timestamp").alias("ts"), none("string").alias("routed_model"), none("string").alias("cost"), "quality_score",
                        "verified_at", F.col("verified_at").alias("at"))
    events = r.unionByName(v).withWatermark("at", lateness).drop("at")
    out = (events.groupBy("id").transformWithStateInPandas(
        VerdictState(max_delay, keep), "id long, ts timestamp, routed_model string, cost string, quality_score double, verified_at timestamp",
        outputMode="append", timeMode="EventTime").withColumn("cost_usd", F.col("cost").cast("decimal(18,8)")).drop("cost"))
    w = (out.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint).outputMode("append"))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the query keeps the setting that it was started with
    try:
        return w.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def current(changes: DataFrame) -> DataFrame:
    """One row per request of the emitted changes: its columns and its newest verdict."""
    rows = changes.where(F.col("ts").isNotNull()).groupBy("id").agg(F.min(F.struct("ts", "routed_model", "cost_usd")).alias("__r")).select("id", "__r.*")
    judged = latest_verdicts(changes.where(F.col("verified_at").isNotNull()).select("id", "quality_score", "verified_at"))
    return rows.join(judged, "id", "left")
