"""Tracking and jumps on streams: rows wait for the watermark, then go in order against keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seriesforge.operators.matching import BOX, Tracker


class _InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them; then they go to turn(), in order of position.

    A timer stands at each batch's latest event time. When nothing has come for idle_ms of event time after it, forget() drops the key's state.
    """

    columns: list[str]  # numbers of a row, the position first

    def __init__(self, time: str, idle_ms: int):
        self.time, self.idle_ms = time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, " + ", ".join(f"c{i} double" for i in range(len(self.columns))))
        self.opened(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf[pdf[self.columns[0]].notna()]
            if len(pdf):
                stamps = (pdf[self.time].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
                values = pdf[self.columns].astype(float).itertuples(index=False, name=None)
                self.waiting.appendList([(t, *(None if pd.isna(x) else float(x) for x in v)) for t, v in zip(stamps, values, strict=True)])
                self.handle.registerTimer(max(stamps) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due, rest = [], []
        for row in self.waiting.get():
            (due if row[0] < upto else rest).append(tuple(row))
        if not due:
            if not rest:
                self.forget()
            yield from ()
            return
        self.waiting.put(rest) if rest else self.waiting.clear()
        values = np.array([[np.nan if x is None else x for x in r[1:]] for r in due], float)
        out = self.turn(key, values[np.lexsort(values.T[::-1])])
        self.handle.registerTimer(upto + self.idle_ms)
        yield out

    def close(self) -> None:
        pass


class _Track(_InOrder):
    """MapState holds the tracks that may go on, by number; those that are too old are removed as rows go by."""

    def __init__(self, time: str, idle_ms: int, frame: str, candidate: str, tracker: Tracker):
        super().__init__(time, idle_ms)
        self.columns, self.tracker = [frame, candidate, *BOX], tracker

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "track long", "frame long, x1 double, y1 double, x2 double, y2 double")
        self.count = handle.getValueState("count", "n long")

    def forget(self) -> None:
        self.live.clear()  # the count stays, so that no number is given twice

    def turn(self, key, rows: np.ndarray) -> pd.DataFrame:
        t = self.tracker
        before = {int(k[0]): (int(v[0]), np.array([np.nan if x is None else x for x in v[1:]], float)) for k, v in self.live.iterator()}
        now = Tracker(t.least, t.bridge, t.reach, dict(before), self.count.get()[0] if self.count.exists() else 0)
        found = np.concatenate([now.step(int(f), rows[rows[:, 0] == f, 2:]) for f in np.unique(rows[:, 0])])
        for old in before.keys() - now.live.keys():
            self.live.removeKey((old,))
        for name, (frame, box) in now.live.items():
            if name not in before or before[name][0] != frame:
                self.live.updateValue((name,), (frame, *(None if np.isnan(x) else float(x) for x in box)))
        self.count.update((now.count,))
        return pd.DataFrame({"key": key[0], "frame": rows[:, 0].astype("int64"), "candidate": rows[:, 1].astype("int64"), "track_id": found.astype("int64")})


class _Jump(_InOrder):
    def __init__(self, time: str, idle_ms: int, position: str, values: list[str]):
        super().__init__(time, idle_ms)
        self.columns = [position, *values]

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(f"c{i} double" for i in range(len(self.columns) - 1)))

    def forget(self) -> None:
        self.last.clear()

    def turn(self, key, rows: np.ndarray) -> pd.DataFrame:
        first = [np.nan if x is None else x for x in self.last.get()] if self.last.exists() else [np.nan] * (rows.shape[1] - 1)
        step = np.diff(rows[:, 1:], axis=0, prepend=np.array([first], float))
        self.last.update(tuple(None if np.isnan(x) else float(x) for x in rows[-1, 1:]))
        return pd.DataFrame({"key": key[0], "position": rows[:, 0].astype("int64"), "jump": np.sqrt((step * step).sum(1))})


def track_stream(stream: DataFrame, key: str, time: str, frame: str, candidate: str, least: float = 0.12, bridge: int = 6, reach: float = 130.0,
                 late: str = "0 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """key, frame, candidate and track_id of every box, as matching.track() gives them.

    Boxes go out once the watermark (`late` behind the latest) has passed them, so a frame is matched whole and in order; later ones
    drop. State of a key: the boxes that wait, and an entry for each track of the last `bridge` frames. Without rows for idle_ms of
    event time its tracks are forgotten. Rows without frame are dropped; frames must not fall as time grows.
    """
    kinds = dict(stream.dtypes)
    got = stream.withWatermark(time, late).groupBy(key).transformWithStateInPandas(
        _Track(time, idle_ms, frame, candidate, Tracker(least, bridge, reach)), f"key {kinds[key]}, frame long, candidate long, track_id long", "Append", "EventTime")
    return got.withColumnsRenamed({"key": key, "frame": frame, "candidate": candidate})


def jump_stream(stream: DataFrame, key: str, time: str, position: str, values: list[str], late: str = "0 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """key, position and jump: the distance of each row's values to those of the key's row before.

    NULL where either isn't known, for a key's first row and for the first one after idle_ms of event time without rows. Order as in track_stream().
    """
    kinds = dict(stream.dtypes)
    got = stream.withWatermark(time, late).groupBy(key).transformWithStateInPandas(
        _Jump(time, idle_ms, position, values), f"key {kinds[key]}, position long, jump double", "Append", "EventTime")
    return got.withColumnsRenamed({"key": key, "position": position})
