"""Incremental versions: sync in micro-batches, repeated ids, request counts, duration histograms, freshness.

Rows later than the watermark are dropped by Spark; the batch forms of the same functions see all rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def request_counts(requests: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Requests by window, endpoint and status."""
    r = requests.withWatermark("ts", late) if late else requests
    out = r.groupBy(F.window("ts", width), "endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))
    return out.select(F.col("window.start").alias("start"), "endpoint", "status", "requests")


def duration_histogram(requests: DataFrame, bounds: tuple[float, ...] = BOUNDS, width: str = "1 hour", late: str | None = None, value: str = "seconds") -> DataFrame:
    """Cumulative buckets: requests of a window and endpoint that took no longer than each bound."""
    r = requests.withWatermark("ts", late) if late else requests
    r = r.withColumn("le", F.explode(F.array(*[F.lit(float(b)) for b in bounds])))
    out = r.groupBy(F.window("ts", width), "endpoint", "le").agg(F.count_if(F.col(value) <= F.col("le")).alias("requests"))
    return out.select(F.col("window.start").alias("start"), "endpoint", "le", "requests")


def gauges(runs: DataFrame) -> DataFrame:
    """Latest success, latest error and its message (160 characters at most) of each source."""
    failed = F.col("status") == "failed"
    return runs.groupBy("source").agg(F.max(F.when(~failed, F.col("ts"))).alias("last_success"), F.max(F.when(failed, F.col("ts"))).alias("last_error"), F.substring(F.max_by(F.when(failed, F.col("message")), F.when(failed, F.col("ts"))), 1, 160).alias("last_message"))


def seen_ids(docs: DataFrame, late: str = "1 hour", id_: str = "_id") -> DataFrame:
    """The stream without ids that came before within the watermark."""
    return docs.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_])


def sync(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run what is there through `apply` in micro-batches, once each, and end. Returns the finished query."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()
    query.awaitTermination()
    return query


class Freshness(StatefulProcessor):
    """Keeps each source's latest success; emits its age against `as_of` and whether it is over the threshold. Each
    report sets a timer to the moment at which the source will be stale if it stays silent; a timer that comes due
    without a newer report tells so."""

    def __init__(self, threshold: float, timers: bool = True):
        self.threshold, self.timers = threshold, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double, as_of double, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, as_of, now = (self.last.get()[0] if self.last.exists() else float("-inf")), float("-inf"), timerValues.getCurrentProcessingTimeInMs()
        for part in rows:
            newest = max(newest, float(part["at"].max()))
            as_of = max(as_of, float(part["as_of"].max()))
        self.last.update((newest, as_of, now))
        age = as_of - newest
        if self.timers:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due[0] if isinstance(due, tuple) else due)
            # The source's own clock is `as_of`: what is left until it is stale counts from now.
            self.handle.registerTimer(now + max(1, int(1000 * (self.threshold - age)) + 1))
        yield pd.DataFrame({"source": [key[0]], "age_seconds": [age], "stale": [bool(age > self.threshold)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            # The source's clock has gone on since its last row, as ours has.
            newest, as_of, seen = self.last.get()
            age = as_of - newest + (timerValues.getCurrentProcessingTimeInMs() - seen) / 1000.0
            yield pd.DataFrame({"source": [key[0]], "age_seconds": [age], "stale": [bool(age > self.threshold)]})

    def close(self) -> None:
        pass


def freshness(runs: DataFrame, threshold: float, timers: bool = True) -> DataFrame:
    """source, age_seconds, stale after each micro-batch, and stale at the threshold when a source has been silent that
    long; `runs` has source, at (seconds), as_of (seconds). Needs the RocksDB state store; a stream that stays up
    needs a processing-time trigger, since timers come due in micro-batches. Without timers a run over what is there
    ends by itself and reports each source as of its latest row."""
    # The worker that reads the state's schema runs on the driver, where shipped packages are not on the path.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return runs.groupBy("source").transformWithStateInPandas(statefulProcessor=Freshness(threshold, timers), outputStructType="source string, age_seconds double, stale boolean", outputMode="Update", timeMode="ProcessingTime" if timers else "None")
