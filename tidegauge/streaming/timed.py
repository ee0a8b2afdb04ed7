"""Timers on streams: what has to be said because nothing came (W10, Q5, H4), and snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..sources.export import json_lines


def silences(rows: DataFrame, keys: list[str], time: str, limit_us: int, until: Column | None = None) -> DataFrame:
    """(keys, change, at_us) of a table: silent at ``limit_us`` after a row that none follows by then, and
    resumed at the next one. The last row of a key is silent if ``until`` (none if it isn't given) is that far off."""
    after = F.lead(time).over(Window.partitionBy(*keys).orderBy(time))
    gaps = rows.select(*keys, F.col(time).alias("since"), after.alias("next")).where(F.coalesce("next", F.lit(0) if until is None else until) - F.col("since") > limit_us)
    silent = gaps.select(*keys, F.lit("silent").alias("change"), (F.col("since") + limit_us).alias("at_us"))
    return silent.unionByName(gaps.where("next IS NOT NULL").select(*keys, F.lit("resumed").alias("change"), F.col("next").alias("at_us")))


class Silence(StatefulProcessor):
    """``silences`` of a stream. A key's state is its last row and whether it is silent, with one timer for the
    limit and one that forgets the key."""

    def __init__(self, keys: list[str], time: str, limit_us: int, forget_us: int):
        self.keys, self.time, self.limit, self.forget = keys, time, limit_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last long, silent boolean")

    def _timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        last, silent = self.held.get()
        for after in [self.forget] if silent else [self.limit, self.forget]:
            self.handle.registerTimer((last + after) // 1000 + 1)

    def _told(self, key: tuple, found: list[tuple[str, int]]) -> pd.DataFrame:
        told = pd.DataFrame(found, columns=["change", "at_us"])
        return told.assign(**dict(zip(self.keys, key)))[[*self.keys, "change", "at_us"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for batch in rows for t in batch[self.time].tolist())
        last, silent = self.held.get() if self.held.exists() else (times[0], False)
        found = []
        for at in times:
            if at <= last:
                continue
            if not silent and at - last > self.limit:
                found.append(("silent", last + self.limit))
                silent = True
            if silent:
                found.append(("resumed", at))
            last, silent = at, False
        self.held.update((last, silent))
        self._timers()
        if found:
            yield self._told(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        last, silent = self.held.get()
        if now - last > self.forget:
            self.held.clear()
        elif not silent and now - last > self.limit:
            self.held.update((last, True))
            yield self._told(key, [("silent", last + self.limit)])

    def close(self) -> None:
        pass


def watch_silences(stream: DataFrame, keys: list[str], time: str, limit_us: int, late: str = "2 seconds", forget_us: int = 86_400_000_000) -> DataFrame:
    """``silences`` of a stream with the columns of packets and ``at``: silent is said once the watermark has passed
    the limit, so it needs no later row of the key. A key without rows for ``forget_us`` is forgotten, and then
    begins anew. Times are in microseconds and timers in milliseconds, so a silence is said up to one late.

    The state lives in the query's state store (the RocksDB one, spark.sql.streaming.stateStore.providerClass),
    which survives restarts and lost executors."""
    schema = ", ".join(f"{k} {dict(stream.dtypes)[k]}" for k in keys) + ", change string, at_us long"
    by_key = stream.withWatermark("at", late).select(*keys, time, "at").groupBy(*keys)
    return by_key.transformWithStateInPandas(Silence(keys, time, limit_us, forget_us), schema, "Append", "EventTime")


def write_snapshots(stats: DataFrame, path: str, every: str | None = "1 second") -> DataStreamWriter:
    """A writer that puts each micro-batch of ``stats`` as JSON lines into a folder of its own, every
    ``every`` (None: all there is, once). A batch that is done again after a failure replaces its folder, so no
    snapshot comes twice. The caller names the checkpoint and starts it."""

    def write(batch: DataFrame, number: int) -> None:
        json_lines(batch).write.mode("overwrite").text(f"{path}/batch={number}")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stats.writeStream.outputMode("append").foreachBatch(write).trigger(**trigger)
