"""Aggregates over rows of frames, candidates and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value and n for every value of each column; NULL counts as ""."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def packed_counts(df: DataFrame, packed: str, separator: str = "|") -> DataFrame:
    """How often each item of a packed list occurs; empty items are dropped."""
    items = F.explode(F.transform(F.split(F.col(packed), f"[{separator}]"), lambda x: F.trim(x)))
    return df.select(items.alias("item")).filter("item <> ''").groupBy("item").agg(F.count("*").alias("n"))


def flag_levels(df: DataFrame, flags: str) -> DataFrame:
    """rows, ok, bad and warn (a row may be both) by the levels named in joined flags."""
    has = lambda x: F.sum(F.contains(F.col(flags), F.lit(x)).cast("long"))
    return df.agg(F.count("*").alias("rows"), F.sum((F.col(flags) == "ok").cast("long")).alias("ok"), has("bad_").alias("bad"), has("warn_").alias("warn"))


def coverage(df: DataFrame, frame: str, total: int) -> DataFrame:
    """frames (distinct), first, last and their share of `total`."""
    return df.agg(F.countDistinct(frame).alias("frames"), F.min(frame).alias("first"), F.max(frame).alias("last")).withColumn(
        "ratio", F.col("frames") / F.lit(float(max(total, 1))))


def component_medians(df: DataFrame, keys: list[str], vector: list[str]) -> DataFrame:
    """Median of each component over the rows whose vector is finite throughout."""
    good = finite(F.col(vector[0])).isNotNull()
    for c in vector[1:]:
        good &= finite(F.col(c)).isNotNull()
    return df.groupBy(*keys).agg(*[F.percentile(F.when(good, F.col(c)), 0.5).alias(c) for c in vector])


def inlier_mean(df: DataFrame, keys: list[str], value: str, factor: float = 3.0, floor: float = 1e-6) -> DataFrame:
    """median, mad, inliers and mean of the finite values no further than factor * max(mad, floor) from the median.

    Values are added in ascending order, so that the mean doesn't depend on the rows' order. Groups without finite values have NULLs.
    """
    v = finite(F.col(value))
    listed = df.groupBy(*keys).agg(F.percentile(v, 0.5).alias("median"), F.array_sort(F.collect_list(v)).alias("_v"))
    far = F.array_sort(F.transform("_v", lambda x: F.abs(x - F.col("median"))))
    got = listed.withColumn("_d", far).withColumn("mad", F.expr("(get(_d, cast((size(_d) - 1) div 2 AS int)) + get(_d, cast(size(_d) div 2 AS int))) / 2"))
    kept = F.filter("_v", lambda x: F.abs(x - F.col("median")) <= factor * F.greatest(F.col("mad"), F.lit(floor)))
    got = got.withColumn("_in", kept).withColumn("inliers", F.size("_in").cast("long"))
    return got.withColumn("mean", F.aggregate("_in", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_in"), F.lit(0))).drop("_v", "_d", "_in")


def patch(df: DataFrame, keys: list[str], depth: str, low: float, high: float, least: int, most_spread: float) -> DataFrame:
    """Depth patches: count of usable values, median, spread (p90 - p10), std and status: ok, too_few or too_wide."""
    v = F.when((finite(F.col(depth)) >= low) & (finite(F.col(depth)) <= high), F.col(depth))
    got = df.groupBy(*keys).agg(F.count(v).alias("count"), F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_p"), F.stddev_pop(v).alias("std"))
    got = got.withColumn("median", F.get("_p", 1)).withColumn("spread", F.get("_p", 2) - F.get("_p", 0)).drop("_p")
    return got.withColumn("status", F.when(F.col("count") < least, "too_few").when(F.col("spread") > most_spread, "too_wide").otherwise("ok"))


def spread_about_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, median and mad (median distance from the median) of the finite values; two grouped passes, no lists."""
    v = finite(F.col(value))
    middle = df.groupBy(*keys).agg(F.percentile(v, 0.5).alias("median"), F.count(v).alias("count"))
    return df.join(middle, keys).groupBy(*keys).agg(F.first("count").alias("count"), F.first("median").alias("median"), F.percentile(F.abs(v - F.col("median")), 0.5).alias("mad"))


def residuals(df: DataFrame, keys: list[str], estimate: str) -> DataFrame:
    """Root mean square and greatest distance of the finite estimates from their median, spread (p90 - p10) and count."""
    v = finite(F.col(estimate))
    middle = df.groupBy(*keys).agg(F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_p"))
    gap = F.abs(v - F.get("_p", 1))
    return df.join(middle, keys).groupBy(*keys).agg(
        F.count(v).alias("count"), F.sqrt(F.avg(gap * gap)).alias("rms"), F.max(gap).alias("max"), F.first(F.get("_p", 2) - F.get("_p", 0)).alias("spread"))


def bounds(df: DataFrame, value: str, many: int = 100, pad: float = 0.0) -> DataFrame:
    """low and high: the 1st and 99th percentile of at least `many` finite values, else least and greatest; padded."""
    v = finite(F.col(value))
    p = F.percentile(v, F.array(F.lit(0.01), F.lit(0.99)))
    got = df.agg(F.count(v).alias("n"), p.alias("_p"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    wide = F.col("n") >= many
    return got.select("n", (F.when(wide, F.get("_p", 0)).otherwise(F.col("_lo")) - pad).alias("low"), (F.when(wide, F.get("_p", 1)).otherwise(F.col("_hi")) + pad).alias("high"))


def before_after(df: DataFrame, keys: list[str], before: str, after: str, eps: float = 1e-9) -> DataFrame:
    """pairs (both finite), improved, worse, unchanged, improved_ratio, mean and median change."""
    a, b = finite(F.col(before)), finite(F.col(after))
    d = b - a
    total = lambda c: F.sum(F.when(c, 1).otherwise(0))
    got = df.groupBy(*keys).agg(F.count(d).alias("pairs"), total(d < -eps).alias("improved"), total(d > eps).alias("worse"), total(F.abs(d) <= eps).alias("unchanged"),
                                F.avg(d).alias("mean_change"), F.percentile(d, 0.5).alias("median_change"))
    return got.withColumn("improved_ratio", F.when(F.col("pairs") > 0, F.col("improved") / F.col("pairs")))


def both_sides(df: DataFrame, key: str, frame: str, side: str, pair: tuple[str, str], least: float = 0.15, most_missing: int = 2) -> DataFrame:
    """Frames of either and of both sides, their ratio, and the method to fill gaps: model if the ratio and the number of
    frames of both are enough, else interpolate."""
    per = df.groupBy(key, frame).agg(*[F.max((F.col(side) == s).cast("int")).alias(f"_{i}") for i, s in enumerate(pair)])
    got = per.groupBy(key).agg(F.sum(F.greatest("_0", "_1")).alias("either"), F.sum(F.col("_0") * F.col("_1")).alias("both"))
    ratio = F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(0.0)
    return got.withColumn("ratio", ratio).withColumn("method", F.when((F.col("ratio") >= least) & (F.col("both") >= most_missing), "model").otherwise("interpolate"))


def seconds_per_step(df: DataFrame, key: str, step: str, elapsed: str) -> DataFrame:
    """Median of elapsed time per step between neighbours of a series, for going on past its end."""
    from seriesforge.operators.series import over

    w = over(key, step)
    d = F.col(step) - F.lag(step).over(w)
    rate = F.when(d > 0, (F.col(elapsed) - F.lag(elapsed).over(w)) / d)
    return df.withColumn("_r", rate).groupBy(key).agg(F.percentile("_r", 0.5).alias("per_step"), F.max(F.struct(step, elapsed)).alias("_end")).select(
        key, "per_step", F.col(f"_end.{step}").alias("last_step"), F.col(f"_end.{elapsed}").alias("last_elapsed"))


def pivot_distance(df: DataFrame, keys: list[str], point: str, pair: tuple[int, int], place: list[str]) -> DataFrame:
    """Distance between two points of each group; NULL if one is missing."""
    at = lambda i, c: F.max(F.when(F.col(point) == i, F.col(c)))
    got = df.groupBy(*keys).agg(*[at(i, c).alias(f"_{c}{k}") for k, i in enumerate(pair) for c in place])
    gap = [(F.col(f"_{c}0") - F.col(f"_{c}1")) for c in place]
    return got.select(*keys, F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0])).alias("distance"))


def overridden(summary: Column, **fields: Column) -> Column:
    """A summary struct with some fields replaced or added."""
    for name, c in fields.items():
        summary = summary.withField(name, c)
    return summary
