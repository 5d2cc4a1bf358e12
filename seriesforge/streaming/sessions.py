"""Causal operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def session_islands(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """key, start, end and n of runs of events no further apart than gap; events later than `late` drop."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(
        F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Hold(StatefulProcessor):
    """Per key: the last good position and value, and the rows that wait for the watermark."""

    def __init__(self, key: str, time: str, position: str, value: str, good: str, max_age: int, idle_ms: int):
        self.names, self.max_age, self.idle_ms = (key, time, position, value, good), max_age, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "p long, v double")
        self.waiting = handle.getListState("waiting", "t long, p long, v double, g boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, time, position, value, good = self.names
        for pdf in rows:
            keep = pdf[pdf[position].notna()]
            if len(keep):
                stamps = (keep[time].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
                got = zip(stamps, keep[position], keep[value], keep[good], strict=True)
                self.waiting.appendList([(t, int(p), None if pd.isna(v) else float(v), g is True or g == 1) for t, p, v, g in got])
                self.handle.registerTimer(max(stamps) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Rows up to the timer are complete: they go out in order of position."""
        upto = expiredTimerInfo.getExpiryTimeInMs()
        held, rest = [], []
        for row in self.waiting.get():
            (held if row[0] < upto else rest).append(tuple(row))
        if not held:
            self.last.clear()  # nothing came for the idle time
            yield from ()
            return
        self.waiting.put(rest) if rest else self.waiting.clear()
        last = self.last.get() if self.last.exists() else None
        out = []
        for _, p, v, g in sorted(held, key=lambda r: r[1]):
            if g and v is not None:
                last = (p, v)
            out.append((key[0], p, last[1] if last is not None and p - last[0] <= self.max_age else None))
        if last is not None:
            self.last.update((last[0], last[1]))
            self.handle.registerTimer(upto + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", "position", "held"]).astype({"held": "float64"})

    def close(self) -> None:
        pass


def hold_last_stream(stream: DataFrame, key: str, time: str, position: str, value: str, good: str, max_age: int, late: str = "0 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """key, position and held: for every event the last good value not older than max_age positions.

    Events go out once the watermark (`late` behind the latest) has passed them, so order holds across batches; later ones drop.
    State is a pair per key and the events that wait; keys that get nothing for idle_ms of event time are forgotten.
    Rows without a position are dropped; a good row without a value holds nothing.
    """
    kinds = dict(stream.dtypes)
    got = stream.withWatermark(time, late).groupBy(key).transformWithStateInPandas(
        _Hold(key, time, position, value, good, max_age, idle_ms), f"key {kinds[key]}, position long, held double", "Append", "EventTime")
    return got.select(F.col("key").alias(key), F.col("position").alias(position), "held")
