"""Structured Streaming forms of silences and counts. The batch operators define the results; these give the same rows
for events within the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(stream: DataFrame, ts: str, by: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts per time window and key; rows later than ``late`` are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_counts(stream: DataFrame, ts: str, by: list[str], silence: str, late: str) -> DataFrame:
    """Sessions by Spark's session windows. Events exactly ``silence`` apart share a session here; the batch operator
    splits them."""
    w = F.session_window(ts, silence)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def use_timers(spark: SparkSession) -> None:
    """Timers and typed state need the RocksDB state store; call this before a stream of ``stream_gaps`` starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Silences(StatefulProcessor):
    """Times wait in state until the watermark has passed them, so that their order no longer changes; then each is compared
    with the one before. A key without events for ``forget_s`` behind the watermark loses its state."""

    def __init__(self, at_least: float, forget_s: float):
        self.at_least, self.forget_ms = at_least, int(forget_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint")
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times = [int(t.value // 1000) for f in rows for t in f["ts"] if not pd.isna(t)]
        times = [t for t in times if t > passed]  # later ones are late
        if times:
            self.waiting.appendList([(t,) for t in times])
            # the timer of the last one finds all before it; those that the watermark passes sooner wait for it
            self.handle.registerTimer(max(times) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(t for (t,) in self.waiting.get())
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in waiting:
            if t > passed:
                break
            if last is not None and (t - last) / 1e6 >= self.at_least:
                out.append((key[0], pd.Timestamp(last, unit="us"), pd.Timestamp(t, unit="us"), (t - last) / 1e6))
            last = t
        rest = [t for t in waiting if t > passed]
        self.waiting.clear()
        if rest:
            self.waiting.put([(t,) for t in rest])
        if last is not None and not rest and last // 1000 + self.forget_ms <= passed // 1000:
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.forget_ms)
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "end", "gap_s"])

    def close(self) -> None:
        pass


def stream_gaps(stream: DataFrame, key: str, ts: str, late: str, at_least: float, forget_s: float = 30 * 86400.0) -> DataFrame:
    """(key, start, end, gap_s): silences of at least so many seconds per key, in event time: rows equal the batch form's for
    events that are at most ``late`` behind, in whatever order they come; later ones are dropped. A silence is told when the
    watermark has passed its end. Silences of more than ``forget_s`` are not seen: the state ends before."""
    kind = dict(stream.dtypes)[key]
    src = stream.select(F.col(key).alias("key"), F.col(ts).alias("ts")).withWatermark("ts", late)
    return src.groupBy("key").transformWithStateInPandas(Silences(at_least, forget_s), f"key {kind}, start timestamp, end timestamp, gap_s double", "append", "eventTime")
