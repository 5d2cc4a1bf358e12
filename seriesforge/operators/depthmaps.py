"""Depth maps as rows of tiles, and masks as rows of pixels: templates over time, background error, moving regions.

A tile is a row (key, frame, tile, values): a fixed part of a frame's pixels. What is asked of a pixel over time is
exchanged by tile and pixel, what is asked of a frame by frame, so no task holds a session's maps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite


def template(tiles: DataFrame, key: str, frame: str, tile: str, depth: str, moving: str | None = None, least_ratio: float = 0.3, least_depth: float = 0.01) -> DataFrame:
    """key, tile and template: each pixel's median depth over the frames in which it doesn't move and has depth.

    0 where fewer than a share of least_ratio of the key's frames (rounded down, one at least) count. depth and moving are arrays by
    pixel of the tile, moving of booleans; NULL entries don't move. Frames without the tile count as frames.
    """
    zipped = F.arrays_zip(F.col(depth).alias("d"), (F.transform(depth, lambda _: F.lit(False)) if moving is None else F.col(moving)).alias("m"))
    pixels = tiles.select(key, tile, F.posexplode(zipped).alias("_i", "_p"))
    good = F.when(~F.coalesce(F.col("_p.m"), F.lit(False)) & (finite(F.col("_p.d")) >= least_depth), F.col("_p.d"))
    per = pixels.groupBy(key, tile, "_i").agg(F.percentile(good, 0.5).alias("_t"), F.count(good).alias("_n"))
    frames = tiles.groupBy(key).agg(F.countDistinct(frame).alias("_frames"))
    kept = per.join(frames, key).withColumn("_t", F.when(
        F.col("_n") >= F.greatest(F.lit(1), F.floor(F.col("_frames") * least_ratio)), F.col("_t")).otherwise(0.0))
    listed = F.array_sort(F.collect_list(F.struct("_i", "_t")))  # of one tile
    return kept.groupBy(key, tile).agg(F.transform(listed, lambda x: x["_t"]).alias("template"))


def background_pixels(tiles: DataFrame, templates: DataFrame, key: str, frame: str, tile: str, depth: str, moving: str | None = None, near: float = 0.1, far: float = 10.0) -> DataFrame:
    """key, frame, depth and template of every pixel that doesn't move and whose depths both lie between near and far."""
    both = tiles.join(templates, [key, tile])
    still = F.transform(depth, lambda _: F.lit(False)) if moving is None else F.col(moving)
    pixels = both.select(key, frame, F.explode(F.arrays_zip(F.col(depth).alias("d"), still.alias("m"), F.col("template").alias("t"))).alias("_p"))
    inside = lambda c: (finite(F.col(c)) > near) & (finite(F.col(c)) < far)
    return pixels.filter(~F.coalesce(F.col("_p.m"), F.lit(False)) & inside("_p.d") & inside("_p.t")).select(
        key, frame, F.col("_p.d").cast("double").alias("depth"), F.col("_p.t").alias("template"))


def background_error(pixels: DataFrame, keys: list[str], least: int = 100) -> DataFrame:
    """keys, pixels and rmse of background_pixels(); rmse is NULL with fewer than `least` of them. Frames without any give no row."""
    gap = F.col("depth") - F.col("template")
    return pixels.groupBy(*keys).agg(F.count("*").alias("pixels"), F.when(F.count("*") >= least, F.sqrt(F.avg(gap * gap))).alias("rmse"))


def frame_depths(tiles: DataFrame, keys: list[str], depth: str, least_depth: float = 0.01) -> DataFrame:
    """keys, valid_ratio, median and p95 of the depths over least_depth of each frame; ratio 0 and NULLs without any."""
    v = F.when(finite(F.col("_d")) > least_depth, F.col("_d"))
    got = tiles.select(*keys, F.explode_outer(depth).alias("_d")).groupBy(*keys).agg(
        (F.count(v) / F.count("*")).alias("valid_ratio"), F.percentile(v, F.array(F.lit(0.5), F.lit(0.95))).alias("_p"))
    return got.withColumn("median", F.get("_p", 0)).withColumn("p95", F.get("_p", 1)).drop("_p")


def box_pixels(boxes: DataFrame, keys: list[str], box: str, width: int, height: int, margin: float = 0.3) -> DataFrame:
    """keys, px and py of the pixels inside boxes (x1, y1, x2, y2) grown by a share of their sides, each once. Ends are cut down to
    whole pixels, the far ones not included. Boxes that aren't finite have none."""
    x1, y1, x2, y2 = (finite(F.col(f"{box}.{c}")) for c in ("x1", "y1", "x2", "y2"))
    mx, my = (x2 - x1) * margin, (y2 - y1) * margin
    low = lambda c: F.greatest(F.lit(0), F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)))
    high = lambda c, most: F.least(F.lit(most), F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))) - 1
    span = lambda a, b: F.when(a.isNotNull() & b.isNotNull() & (a <= b), F.sequence(a, b))
    known = boxes.filter(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull())
    rows = known.select(*keys, F.explode(span(low(y1 - my), high(y2 + my, height))).alias("py"), F.col(box))
    return rows.select(*keys, F.explode(span(low(x1 - mx), high(x2 + mx, width))).alias("px"), "py").distinct()


def moving_pixels(flow: DataFrame, key: str, pair: str, magnitude: str, frames: Column, threshold: float = 2.0, window: int = 3) -> DataFrame:
    """key, frame, px and py where the flow of a pair of frames near the frame exceeds the threshold.

    flow: key, pair (n: between frames n and n + 1), px, py and magnitude; frames: how many the key has. A frame takes the pairs from window // 2
    before it on, window // 2 of them after, its ends and windows of less than two frames the nearest pair. As the largest of them exceeds
    the threshold if one does, only pixels that do are dealt to their frames.
    """
    half = window // 2
    last = frames - 1
    low = F.greatest(F.lit(0), F.col(pair) - half + 1) if half else F.col(pair)
    high = F.least(last, F.col(pair) + half) if half else F.when(F.col(pair) == last - 1, last).otherwise(F.col(pair))
    on = flow.filter(finite(F.col(magnitude)) > threshold).withColumn("_lo", low).withColumn("_hi", high).filter("_lo <= _hi")
    return on.select(key, F.explode(F.sequence("_lo", "_hi")).alias("frame"), "px", "py").distinct()


def ellipse(radius: int) -> list[tuple[int, int]]:
    """The offsets (x, y) of a round kernel of 2 * radius + 1 pixels a side."""
    half = [round(radius * math.sqrt((radius * radius - y * y) / (radius * radius))) if radius else 0 for y in range(-radius, radius + 1)]
    return [(x, y) for y, h in zip(range(-radius, radius + 1), half, strict=True) for x in range(-h, h + 1)]


def _shifted(mask: DataFrame, keys: list[str], offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets])
    got = mask.select(*keys, "px", "py", F.explode(steps).alias("_s")).select(*keys, (F.col("px") + F.col("_s.x")).alias("px"), (F.col("py") + F.col("_s.y")).alias("py"))
    return got.filter((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))


def dilated(mask: DataFrame, keys: list[str], offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """The pixels that the kernel, laid at a pixel of the mask, covers inside the image."""
    return _shifted(mask, keys, offsets, width, height).distinct()


def eroded(mask: DataFrame, keys: list[str], offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """The pixels around which the kernel covers pixels of the mask alone; what lies outside the image doesn't count.

    mask has each pixel once. Each of its pixels counts for those that have it under their kernel.
    """
    back = [(-x, -y) for x, y in offsets]
    xs, ys = sorted({x for x, _ in offsets}), sorted({y for _, y in offsets})
    counted = _shifted(mask, keys, back, width, height).groupBy(*keys, "px", "py").agg(F.count("*").alias("_n"))
    inner = (F.col("px") >= -xs[0]) & (F.col("px") < width - xs[-1]) & (F.col("py") >= -ys[0]) & (F.col("py") < height - ys[-1])
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets])
    inside = lambda s: (F.col("px") + s["x"] >= 0) & (F.col("px") + s["x"] < width) & (F.col("py") + s["y"] >= 0) & (F.col("py") + s["y"] < height)
    needed = F.when(inner, len(offsets)).otherwise(F.size(F.filter(steps, inside)))
    return counted.filter(F.col("_n") == needed).select(*keys, "px", "py")


def moving_mask(boxes: DataFrame, flow: DataFrame | None, keys: list[str], width: int, height: int, radius: int = 7) -> DataFrame:
    """The union of box_pixels() and of moving_pixels() whose small holes are closed and which are then grown, by a round kernel."""
    if flow is None:
        return boxes
    k = ellipse(radius)
    grown = dilated(eroded(dilated(flow, keys, k, width, height), keys, k, width, height), keys, k, width, height)
    return boxes.select(*keys, "px", "py").unionByName(grown).distinct()
