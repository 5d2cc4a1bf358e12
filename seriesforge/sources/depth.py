"""Depth files found by a manifest: a frame's points are sampled in its map, and each map is opened once."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = "count long, depth double, span double, std double, status string"


def latest(manifest: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each frame (keys) by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return manifest.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def patch(depth: np.ndarray, u: float, v: float, radius: int, least: int, most_span: float, near: float, far: float) -> tuple:
    """count, median, p90 - p10, std and status of the usable depths around a place (rounded half to even)."""
    none = (None, None, None)
    if not (np.isfinite(u) and np.isfinite(v)):
        return 0, *none, "no_point"
    x, y = int(round(u)), int(round(v))
    h, w = depth.shape
    if not (0 <= x < w and 0 <= y < h):
        return 0, *none, "out_of_image"
    part = depth[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
    values = part[np.isfinite(part) & (part > near) & (part < far)].astype(float)
    if len(values) < least:
        return len(values), *none, "too_few_pixels"
    low, middle, high = np.percentile(values, (10, 50, 90))
    wide = high - low > most_span
    return len(values), None if wide else float(middle), float(high - low), float(values.std()), "depth_span_high" if wide else "ok"


def sample_maps(spark: SparkSession, points: DataFrame, manifest: DataFrame, keys: list[str], path: str, folder: str, point: str = "point", u: str = "u", v: str = "v",
                radius: int = 3, least: int = 5, most_span: float = float("inf"), near: float = 0.01, far: float = 10.0) -> DataFrame:
    """keys, point, count, depth, span, std and status of every point of every frame (keys).

    manifest: one row a frame with the path of its map, a NumPy file of two dimensions somewhere below folder; files are told apart by their whole
    path. A frame's points (a few candidates' joints) are gathered and go to its map in one row; maps come by Spark's binary file reader, one
    task row each. Frames that the manifest lacks have status missing_depth_frame, files that aren't there missing_depth_file; such points
    stay, without a depth. Maps of another shape are an error.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    asked = points.groupBy(*keys).agg(F.collect_list(F.struct(F.col(point).alias("p"), F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"))).alias("_asks"))
    named = asked.join(manifest.select(*keys, F.col(path).alias("_path")), keys, "left")
    maps = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(folder)
    both = named.join(maps.select(plain(F.col("path")).alias("_file"), "content"), plain(F.col("_path")) == F.col("_file"), "left")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                out = []
                depth = None if row["content"] is None else np.load(io.BytesIO(row["content"]), allow_pickle=False)
                for ask in row["_asks"]:
                    if depth is None:
                        got = (0, None, None, None, "missing_depth_frame" if row["_path"] is None else "missing_depth_file")
                    else:
                        place = [np.nan if ask[c] is None else float(ask[c]) for c in "uv"]
                        got = patch(depth, *place, radius, least, most_span, near, far)
                    out.append((*[row[k] for k in keys], ask["p"], *got))
                yield pd.DataFrame(out, columns=[*keys, point, "count", "depth", "span", "std", "status"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{point} {kinds[point]}", SAMPLES])
    # Rows hold whole maps: a batch is a few of them.
    return both.select(*keys, "_asks", "_path", "content").mapInPandas(run, schema)


def missing_frames(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The frames whose map wasn't found, each once, and why."""
    return samples.filter("status IN ('missing_depth_frame', 'missing_depth_file')").select(*keys, "status").distinct()
