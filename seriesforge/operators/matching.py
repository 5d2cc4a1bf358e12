"""Order-dependent matching: greedy suppression and clustering of a frame's candidates, and two trackers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import box_iou, finite

BOX = ["x1", "y1", "x2", "y2"]


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a with every box of b."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inner = np.clip(high - low, 0, None).prod(2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(1)
    union = area(a)[:, None] + area(b)[None] - inner
    return np.where(union > 1e-9, inner / np.where(union > 1e-9, union, 1), 0.0)


_BOXED = "array<struct<place:double,c:bigint,conf:double,b:struct<x1:double,y1:double,x2:double,y2:double>>>"


def _listed(df: DataFrame, frame: str, candidate: str, confidence: str, place: Column) -> DataFrame:
    """frame and _all: its candidates in ascending order of place, then candidate, with confidence and box."""
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in BOX])
    one = F.struct(place.cast("double").alias("place"), F.col(candidate).cast("long").alias("c"), finite(F.col(confidence)).alias("conf"), box.alias("b"))
    return df.groupBy(frame).agg(F.array_sort(F.collect_list(one)).alias("_all"))


def greedy_dedup(df: DataFrame, frame: str, candidate: str, confidence: str, threshold: float = 0.3) -> DataFrame:
    """df's frame and candidate with `dropped`: by falling confidence, a box goes if a kept one overlaps it above threshold.

    Frames are groups of a few candidates, listed and folded in place. Of equal confidence the lesser candidate stays, without one
    comes last; boxes with NULLs overlap nothing; no rows give none.
    """
    listed = _listed(df, frame, candidate, confidence, F.coalesce(-finite(F.col(confidence)), F.lit(float("inf"))))
    hit = lambda k, x: F.coalesce(box_iou(k["b"], x["b"]) > threshold, F.lit(False))
    kept = F.aggregate("_all", F.array().cast(_BOXED), lambda kept, x: F.when(F.exists(kept, lambda k: hit(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    got = listed.withColumn("_kept", F.transform(kept, lambda k: k["c"])).select(frame, "_kept", F.explode("_all.c").alias("_c"))
    kind = dict(df.dtypes)[candidate]
    return got.select(frame, F.col("_c").cast(kind).alias(candidate), (~F.array_contains("_kept", F.col("_c"))).cast("int").alias("dropped"))


def mark_duplicates(df: DataFrame, frame: str, candidate: str, confidence: str, least: float = 0.45, reach: float = 35.0, alike: float = 0.35) -> DataFrame:
    """frame, candidate, cluster (-1: none) and dropped (all of a cluster but the surest, the first of equals).

    Boxes are alike from an overlap of `least`, or with centres within `reach` and areas of which the smaller is at
    least `alike` of the larger. Pairs are taken in order of their candidates; each joins the first cluster that holds
    either, or opens one. A frame is a group of a few candidates, folded in place. Boxes with NULLs are like none; no rows give none.
    """
    listed = _listed(df, frame, candidate, confidence, F.lit(0.0))
    area = lambda b: F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))

    def same(a: Column, b: Column) -> Column:
        far = F.sqrt(F.pow((a["x1"] + a["x2"]) / 2 - (b["x1"] + b["x2"]) / 2, 2) + F.pow((a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2, 2))
        ratio = F.least(area(a), area(b)) / F.greatest(area(a), area(b), F.lit(1.0))
        return F.coalesce((box_iou(a, b) >= least) | ((far <= reach) & (ratio >= alike)), F.lit(False))

    pairs = F.flatten(F.transform("_all", lambda x, i: F.transform(
        F.filter("_all", lambda y, j: (j > i) & same(x["b"], y["b"])), lambda y: F.array(x["c"], y["c"]))))
    holds = lambda c, pair: F.arrays_overlap(c, pair)
    # the first cluster that meets the pair takes it in; clusters are lists of candidates in the order in which they came
    own = lambda all_, pair: F.array_position(F.transform(all_, lambda c: holds(c, pair)), F.lit(True))
    clusters = F.aggregate(pairs, F.array().cast("array<array<bigint>>"), lambda all_, pair: F.when(
        own(all_, pair) == 0, F.concat(all_, F.array(pair))).otherwise(
        F.transform(all_, lambda c, n: F.when(n + 1 == own(all_, pair), F.array_union(c, pair)).otherwise(c))))
    sure = F.map_from_entries(F.transform("_all", lambda x: F.struct(x["c"], F.coalesce(x["conf"], F.lit(float("-inf"))))))
    got = listed.withColumn("_clusters", clusters).withColumn("_sure", sure)
    best = F.transform("_clusters", lambda c: F.aggregate(F.slice(c, 2, 1_000_000), F.get(c, 0), lambda a, x: F.when(
        F.try_element_at("_sure", x) > F.try_element_at("_sure", a), x).otherwise(a)))
    got = got.withColumn("_best", best).select(frame, "_clusters", "_best", F.explode("_all.c").alias("_c"))
    inside = F.transform("_clusters", lambda c: F.array_contains(c, F.col("_c")))
    last = F.size("_clusters") - F.array_position(F.reverse(inside), F.lit(True))
    gone = F.exists(F.arrays_zip(F.col("_clusters").alias("m"), F.col("_best").alias("b")), lambda z: F.array_contains(z["m"], F.col("_c")) & (z["b"] != F.col("_c")))
    kind = dict(df.dtypes)[candidate]
    return got.select(frame, F.col("_c").cast(kind).alias(candidate), F.when(F.exists(inside, lambda x: x), last).otherwise(-1).cast("int").alias("cluster"),
                      gone.cast("int").alias("dropped"))


def chained(frames: np.ndarray, boxes: np.ndarray, least: float = 0.2) -> np.ndarray:
    """Track numbers: boxes take over the tracks of the last frame that had any, by falling overlap of at least
    `least` (the later box of the earlier frame, then of this one, wins ties); others open tracks."""
    out, count = np.full(len(frames), -1), 0
    before = np.zeros(0, np.int64)
    for f in np.unique(frames):
        rows = np.flatnonzero(frames == f)
        if len(before):
            overlap = iou(boxes[before], boxes[rows])
            pairs = sorted(((overlap[i, j], i, j) for i, j in np.argwhere(overlap >= least).tolist()), reverse=True)
            used: set[int] = set()
            for _, i, j in pairs:
                if i not in used and out[rows[j]] < 0:
                    out[rows[j]] = out[before[i]]
                    used.add(i)
        for r in rows:
            if out[r] < 0:
                out[r], count = count, count + 1
        before = rows
    return out


#: Pairs of boxes that are compared at a time.
PAIRS = 1 << 19


def near_pairs(t: np.ndarray, boxes: np.ndarray, bridge: int, score: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j and scores of all pairs of a box and one that is 1 to `bridge` earlier in t, which ascends, if their score isn't NaN."""
    low, high = np.searchsorted(t, t - bridge), np.searchsorted(t, t)
    end = np.cumsum(high - low)
    found, a = [], 0
    while a < len(t):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + PAIRS, side="right")))
        n = (high - low)[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
        s = score(boxes[i], boxes[j], t[i] - t[j])
        on = ~np.isnan(s)
        found.append((i[on], j[on], s[on]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pair_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each box of a with the box of b beside it."""
    inner = np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None).prod(1)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(1)
    union = area(a) + area(b) - inner
    return np.where(union > 1e-9, inner / np.where(union > 1e-9, union, 1), 0.0)


@dataclass
class Linker:
    """Tracks of boxes that come in order of session and time, many sessions at once; the boxes of a session's last `bridge` times are
    all that it holds. A time's boxes are matched to the last boxes of tracks by falling score (NaN: no match)."""

    bridge: int
    score: Callable
    latest: bool  # among equal scores the later box wins, by the earlier time's first; else the lesser box, then track
    t: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    boxes: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    name: list[int] = field(default_factory=list)
    over: list[bool] = field(default_factory=list)  # the track has gone on since
    count: int = 0

    def step(self, t: np.ndarray, boxes: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The tracks of whole times' boxes. Times ascend over all calls, by more than `bridge` where a session opens."""
        held = len(self.t)
        all_t, all_boxes = np.concatenate([self.t, t]), np.concatenate([self.boxes, boxes])
        i, j, s = near_pairs(all_t, all_boxes, self.bridge, self.score)
        fresh = i >= held
        i, j, s = i[fresh], j[fresh], s[fresh]
        order = np.lexsort((-i, -j, -s, all_t[i]) if self.latest else (j, i, -s, all_t[i]))
        i, j, s = (x[order].tolist() for x in (i, j, s))
        name, over = self.name + [-1] * len(t), self.over + [False] * len(t)
        times = all_t[held:]
        edge = (held + np.flatnonzero(np.diff(times, prepend=times[:1] - 1))).tolist() + [len(all_t)]
        begins, k, n = set((held + np.flatnonzero(opens)).tolist()), 0, len(i)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a in begins:
                self.count = 0
            while k < n and i[k] < b:
                x, y = i[k], j[k]
                k += 1
                if name[x] >= 0 or over[y]:
                    continue
                if not self.latest:  # of equal ones, the lesser track
                    m = k
                    while m < n and i[m] == x and s[m] == s[k - 1]:
                        if not over[j[m]] and name[j[m]] < name[y]:
                            y = j[m]
                        m += 1
                name[x], over[y] = name[y], True
            for x in range(a, b):
                if name[x] < 0:
                    name[x], self.count = self.count, self.count + 1
        keep = int(np.searchsorted(all_t, all_t[-1] - self.bridge, side="right")) if len(all_t) else 0
        self.t, self.boxes, self.name, self.over = all_t[keep:], all_boxes[keep:], name[keep:], over[keep:]
        return np.array(name[held:], np.int32)


def _linked(df: DataFrame, key: str, frame: str, candidate: str, bridge: int, score: Callable, latest: bool) -> DataFrame:
    """key, frame, candidate and track_id. Sessions are dealt to tasks and stream through them in order, so no
    session is held. bridge 0: times are the frames that a session has, without those between, and tracks bridge none."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [key, frame, candidate]
    w = Window.partitionBy(key).orderBy(frame, candidate)
    gap = F.col(frame) - F.lag(frame).over(w)
    gap = F.when(gap > 0, F.least(gap, F.lit(bridge + 1)) if bridge else F.lit(1)).otherwise(0)
    opens = F.row_number().over(w) == 1
    reach = bridge or 1
    dealt = df.select(*names, *BOX, opens.alias("_opens"), F.when(opens, reach + 1).otherwise(gap).cast("long").alias("_gap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, held, at = Linker(reach, score, latest), None, 0

        def given(rows: pa.Table) -> pa.RecordBatch:
            nonlocal at
            t = at + np.cumsum(rows.column("_gap").to_numpy())
            at = int(t[-1])
            boxes = np.column_stack([rows.column(c).to_numpy().astype(float) for c in BOX])
            track = linker.step(t, boxes, rows.column("_opens").to_numpy())
            return rows.select(names).append_column("track_id", pa.array(track))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            new = np.flatnonzero(rows.column("_gap").to_numpy())  # the last time may go on in the next batch
            cut = int(new[-1]) if len(new) else 0
            held = rows.slice(cut)
            if cut:
                yield from given(rows.slice(0, cut)).to_batches()
        if held is not None and held.num_rows:
            yield from given(held).to_batches()

    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", track_id int")


def chain(df: DataFrame, key: str, frame: str, candidate: str, least: float = 0.2) -> DataFrame:
    """key, frame, candidate and track_id by overlap with the frame before that has boxes, as chained() gives them; a session (key)
    streams through one task."""

    def score(a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
        overlap = pair_iou(a, b)
        return np.where(overlap >= least, overlap, np.nan)

    return _linked(df, key, frame, candidate, 0, score, True)


@dataclass
class Tracker:
    """Tracks that may go on: at most `bridge` frames old. Each frame's boxes are matched to them by falling
    3 * IoU - distance / reach - 0.25 * (gap - 1), lesser box and track first among equals; what is unmatched opens a track."""

    least: float = 0.12
    bridge: int = 6
    reach: float = 130.0
    live: dict[int, tuple[int, np.ndarray]] = field(default_factory=dict)  # track: its last frame and box
    count: int = 0

    def step(self, frame: int, boxes: np.ndarray) -> np.ndarray:
        """The tracks of a frame's boxes. Frames come in order."""
        self.live = {t: x for t, x in self.live.items() if frame - x[0] <= self.bridge}
        out = np.full(len(boxes), -1)
        if self.live:
            names = np.array(list(self.live))
            last, old = np.array([x[0] for x in self.live.values()]), np.array([x[1] for x in self.live.values()])
            overlap, middle = iou(boxes, old), lambda x: (x[:, :2] + x[:, 2:]) / 2
            far = np.linalg.norm(middle(boxes)[:, None] - middle(old)[None], axis=2)
            i, j = np.nonzero((overlap >= self.least) | (far <= self.reach))
            score = 3 * overlap[i, j] - far[i, j] / self.reach - 0.25 * (frame - last[j] - 1)
            used: set[int] = set()
            for k in np.lexsort((names[j], i, -score)).tolist():
                if out[i[k]] < 0 and j[k] not in used:
                    out[i[k]] = names[j[k]]
                    used.add(j[k])
        new = out < 0
        out[new] = self.count + np.arange(new.sum())
        self.count += int(new.sum())
        self.live |= {int(t): (int(frame), b) for t, b in zip(out, boxes, strict=True)}
        return out


def tracks(frames: np.ndarray, boxes: np.ndarray, least: float, bridge: int, reach: float) -> np.ndarray:
    """Track numbers of boxes in order of their frames."""
    tracker = Tracker(least, bridge, reach)
    edge = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1, append=frames[-1:] + 1)) if len(frames) else []
    parts = [tracker.step(int(frames[a]), boxes[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def track(df: DataFrame, key: str, frame: str, candidate: str, least: float = 0.12, bridge: int = 6, reach: float = 130.0) -> DataFrame:
    """key, frame, candidate and track_id, counted from 0 in each session (key), as tracks() gives them. Equal scores go to the lesser
    candidate, then track; boxes with NULLs open tracks of their own; no rows give none. A session streams through one task.
    """

    def score(a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
        middle = lambda x: (x[:, :2] + x[:, 2:]) / 2
        overlap, far = pair_iou(a, b), np.linalg.norm(middle(a) - middle(b), axis=1)
        return np.where((overlap >= least) | (far <= reach), 3 * overlap - far / reach - 0.25 * (gap - 1), np.nan)

    return _linked(df, key, frame, candidate, bridge, score, False)
