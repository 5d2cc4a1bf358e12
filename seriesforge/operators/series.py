"""Operators over keyed, ordered series. Each takes the key and order columns; windows count rows.

All operators of one series share one window specification, so Spark sorts once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite


def over(key: str | list[str], order: str | list[str]):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([order] if isinstance(order, str) else order))


def jump(value: Column, w) -> Column:
    return F.abs(value - F.lag(value).over(w))


def vector_jump(v: list[Column], w) -> Column:
    """Distance to the previous row's point; NULL for the first row."""
    return F.sqrt(sum(((c - F.lag(c).over(w)) * (c - F.lag(c).over(w)) for c in v[1:]), (v[0] - F.lag(v[0]).over(w)) * (v[0] - F.lag(v[0]).over(w))))


def rank_in(group: str | list[str], order: str | list[str]) -> Column:
    """Place in the group, from 0."""
    return F.row_number().over(over(group, order)) - 1


def rebased(time: str, key: str) -> Column:
    """Time since the series' first sample."""
    return F.col(time) - F.min(time).over(Window.partitionBy(key))


def speed(df: DataFrame, key: str, time: str, v: list[str], measured: str, out: str = "speed") -> DataFrame:
    """The measured speed, its gaps filled with its median, if at least max(3, half) of a series is finite; else
    distance over time to the row before (0 where time doesn't advance), the first row as the second.
    A series of one row has speed 0.
    """
    w, whole = over(key, time), Window.partitionBy(key)
    got = df.withColumn("_m", finite(F.col(measured))).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_have", F.count("_m").over(whole))
    got = got.withColumn("_median", F.percentile("_m", 0.5).over(whole)).withColumn("_dt", F.col(time) - F.lag(time).over(w))
    got = got.withColumn("_step", F.when(F.col("_dt") > 1e-6, vector_jump([F.col(c) for c in v], w) / F.col("_dt")).otherwise(0.0))
    first = F.lag(F.lit(1)).over(w).isNull()
    derived = F.coalesce(F.when(first, F.lead("_step").over(w)).otherwise(F.col("_step")), F.lit(0.0))
    enough = F.col("_have") >= F.greatest(F.lit(3), F.floor(F.col("_n") * 0.5))
    return got.withColumn(out, F.when(enough, F.coalesce("_m", "_median")).otherwise(derived)).drop("_m", "_n", "_have", "_median", "_dt", "_step")


def moving_average(df: DataFrame, key: str, order: str, value: str, window: int, out: str = "average") -> DataFrame:
    """Mean over `window` rows (half before, for even ones one more before), with the first and last value repeated
    past the ends. Series shorter than the window use their length."""
    w, whole = over(key, order), Window.partitionBy(key)
    left = window // 2
    got = df.withColumn("_pos", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(whole))
    got = got.withColumn("_w", F.least(F.lit(window), F.col("_n"))).withColumn("_near", F.collect_list(value).over(w.rowsBetween(-left, window - 1 - left)))
    # Row i of the list is row max(1, pos - left) + i of the series.
    return got.withColumn(out, F.expr(
        "aggregate(sequence(_pos - _w div 2, _pos - _w div 2 + _w - 1), 0D, (a, p) -> a + element_at(_near, "
        f"cast(least(greatest(p, 1), _n) - greatest(_pos - {left}, 1) + 1 AS int))) / _w"
    )).drop("_pos", "_n", "_w", "_near")


def rolling_median(df: DataFrame, key: str, order: str, values: list[str], half: int = 2) -> DataFrame:
    """value_median for each of values, over half rows to each side; NULL and NaN are left out."""
    w = over(key, order).rowsBetween(-half, half)
    return df.withColumns({f"{v}_median": F.percentile(finite(F.col(v)), 0.5).over(w) for v in values})


def rolling_mad_outliers(df: DataFrame, key: str, order: str, value: str, half: int = 5, factor: float = 5.0, least: int = 3,
                         trust: str | None = None) -> DataFrame:
    """med, mad and outlier: values further from the rolling median than factor * (MAD + 1e-6).

    NULL, NaN and infinite values, and rows of trust 0 or less, are not looked at and not flagged; fewer than `least`
    values in a window flag nothing. Rows of equal order are in any order; no rows give none.
    """
    w = over(key, order).rowsBetween(-half, half)
    here = finite(F.col(value)) if trust is None else F.when(F.col(trust) > 0, finite(F.col(value)))
    got = df.withColumn("_v", here).withColumn("_in", F.collect_list("_v").over(w)).withColumn("med", F.percentile("_v", 0.5).over(w))
    near = F.array_sort(F.transform("_in", lambda x: F.abs(x - F.col("med"))))
    got = got.withColumn("_near", near).withColumn("_n", F.size("_near"))
    mad = F.expr("(_near[cast((_n - 1) div 2 AS int)] + _near[cast(_n div 2 AS int)]) / 2")
    got = got.withColumn("mad", F.when(F.col("_n") > 0, mad))
    out = F.coalesce((F.col("_n") >= least) & (F.abs(F.col("_v") - F.col("med")) > factor * (F.col("mad") + 1e-6)), F.lit(False))
    return got.withColumn("outlier", out.cast("int")).drop("_v", "_in", "_near", "_n")


def gaussian_smooth(df: DataFrame, key: str, order: str, value: str, trust: str, sigma: float = 5.0, out: str = "smooth") -> DataFrame:
    """Trust-weighted Gaussian mean over ceil(3 sigma) rows to each side; without weight the value stays. NULL values
    weigh nothing; rows of equal order are in any order; no rows give none."""
    half = math.ceil(3 * sigma)
    w = over(key, order)
    got = df.withColumn("_t", F.coalesce(F.when(F.col(value).isNotNull(), F.col(trust)), F.lit(0.0))).withColumn("_tv", F.col("_t") * F.coalesce(F.col(value), F.lit(0.0)))
    top = below = F.lit(0.0)
    for k in range(-half, half + 1):
        weight = math.exp(-0.5 * (k / sigma) ** 2)
        top = top + weight * F.lead("_tv", k, 0.0).over(w)
        below = below + weight * F.lead("_t", k, 0.0).over(w)
    got = got.withColumn("_a", top).withColumn("_b", below)
    return got.withColumn(out, F.when(F.col("_b") > 1e-12, F.col("_a") / F.col("_b")).otherwise(F.col(value))).drop("_t", "_tv", "_a", "_b")


# Least-squares weights of a quadratic over seven points, for each place in the window.
SAVGOL_7_2 = (
    (32, 15, 3, -4, -6, -3, 5), (5, 4, 3, 2, 1, 0, -1), (1, 3, 4, 4, 3, 1, -2), (-2, 3, 6, 7, 6, 3, -2),
    (-2, 1, 3, 4, 4, 3, 1), (-1, 0, 1, 2, 3, 4, 5), (5, -3, -6, -4, 3, 15, 32),
)
SAVGOL_SCALE = (42, 14, 14, 21, 14, 14, 42)


def savgol(df: DataFrame, key: str, order: str, value: str, out: str = "smooth") -> DataFrame:
    """Savitzky-Golay, window 7, order 2; the ends are the polynomial of the first or last seven.
    Series of fewer than seven rows stay as they are."""
    base = over(key, order)
    whole = Window.partitionBy(key)
    got = df.withColumn("_pos", F.row_number().over(base)).withColumn("_n", F.count(F.lit(1)).over(whole))
    got = got.withColumn("_near", F.collect_list(value).over(base.rowsBetween(-6, 6)))
    # where the window of seven begins in the list of up to thirteen, and this row's place in it
    lead = F.least(F.col("_pos") - 1, F.lit(6))
    place = F.when(F.col("_pos") <= 3, F.col("_pos") - 1).when(F.col("_n") - F.col("_pos") < 3, 6 - (F.col("_n") - F.col("_pos"))).otherwise(3)
    got = got.withColumn("_first", (lead - place).cast("int")).withColumn("_place", place.cast("int"))
    fits = [
        sum((F.get("_near", F.col("_first") + j) * c for j, c in enumerate(row)), F.lit(0.0)) / SAVGOL_SCALE[i] for i, row in enumerate(SAVGOL_7_2)
    ]
    chosen = F.col(value)
    for i, f in enumerate(fits):
        chosen = F.when((F.col("_n") >= 7) & (F.col("_place") == i), f).otherwise(chosen)
    return got.withColumn(out, chosen).drop("_pos", "_n", "_near", "_first", "_place")


def spike_midpoint(df: DataFrame, key: str, order: str, value: str, factor: float = 3.0) -> DataFrame:
    """repaired: the mean of both neighbours where both steps exceed factor times the median step."""
    w = over(key, order)
    got = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).withColumn("_step", F.abs(F.col(value) - F.col("_a")))
    got = got.withColumn("_typical", F.percentile("_step", 0.5).over(Window.partitionBy(key)))
    far = (F.col("_step") > factor * F.col("_typical")) & (F.abs(F.col(value) - F.col("_b")) > factor * F.col("_typical"))
    spike = F.coalesce(far, F.lit(False))
    return got.withColumn("spike", spike.cast("int")).withColumn(
        "repaired", F.when(spike, (F.col("_a") + F.col("_b")) / 2).otherwise(F.col(value))
    ).drop("_a", "_b", "_step", "_typical")


def islands(df: DataFrame, key: str, position: str, on: Column, max_gap: int = 1, least: int = 1) -> DataFrame:
    """key, first, last and n of runs of rows with `on`. Positions up to max(1, max_gap) + 1 apart join. Rows whose `on` is
    NULL are off; repeated positions count each; no rows give no runs."""
    w = over(key, position)
    got = df.filter(on).withColumn("_new", F.coalesce(
        (F.col(position) > F.lag(position).over(w) + max(1, max_gap) + 1).cast("int"), F.lit(1)))
    got = got.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return got.groupBy(key, "_run").agg(
        F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("last") - F.col("first") + 1 >= least).drop("_run")


def hold_last(df: DataFrame, key: str, order: str, position: str, value: str, good: Column, max_age: float, out: str = "held") -> DataFrame:
    """The value where good, else the last good one if it is not older than max_age; and its age."""
    w = over(key, order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(good, F.struct(F.col(position).alias("p"), F.col(value).alias("v"))), ignorenulls=True).over(w)
    got = df.withColumn("_last", last).withColumn("age", F.col(position) - F.col("_last.p"))
    return got.withColumn(out, F.when(F.col("age") <= max_age, F.col("_last.v"))).drop("_last")


def bridge_gaps(df: DataFrame, key: str, order: str, frame: str, bad: str, most: int, out: str = "bridged") -> DataFrame:
    """bad, with good rows between two bad ones turned bad if they are at most `most`, by rows and by frames."""
    w = over(key, order)
    got = df.withColumn("_row", F.row_number().over(w))
    here = F.when(F.coalesce(F.col(bad), F.lit(False)), F.struct(F.col("_row").alias("r"), F.col(frame).alias("f")))
    got = got.withColumn("_a", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_b", F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    short = (F.col("_b.f") - F.col("_a.f") - 1 <= most) & (F.col("_b.r") - F.col("_a.r") - 1 <= most)
    return got.withColumn(out, F.coalesce(F.col(bad), F.lit(False)) | F.coalesce(short, F.lit(False))).drop("_row", "_a", "_b")


def transitions(df: DataFrame, key: str, order: str, closed: Column) -> DataFrame:
    """key, close_at and release_at (places from 0): where a series first closes, and where it first opens again from
    max(close + 1, a third of its rows) on; NULL if it doesn't."""
    w, whole = over(key, order), Window.partitionBy(key)
    got = df.withColumn("_c", F.coalesce(closed, F.lit(False))).withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    got = got.withColumn("_was", F.lag("_c").over(w)).withColumn("_close", F.min(F.when(~F.col("_was") & F.col("_c"), F.col("_p"))).over(whole))
    open_ = F.col("_was") & ~F.col("_c") & (F.col("_p") >= F.greatest(F.col("_close") + 1, F.floor(F.col("_n") / 3)))
    return got.groupBy(key).agg(F.first("_close").alias("close_at"), F.min(F.when(open_, F.col("_p"))).alias("release_at"))


def anchored(df: DataFrame, key: str, order: str, value: str, filled: str, known: str, out: str = "anchored") -> DataFrame:
    """filled, plus in every gap of unknown rows a linear ramp from the offset (value - filled) of the known row before
    to that of the known row after. A gap with one end gets that end's offset; without ends it stays."""
    w = over(key, order)
    got = df.withColumn("_row", F.row_number().over(w))
    here = F.when(F.col(known), F.struct(F.col("_row").alias("r"), (F.col(value) - F.col(filled)).alias("d")))
    got = got.withColumn("_a", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_b", F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    t = (F.col("_row") - F.col("_a.r")) / F.nullif(F.col("_b.r") - F.col("_a.r"), F.lit(0))
    ramp = F.coalesce(F.col("_a.d") + t * (F.col("_b.d") - F.col("_a.d")), F.col("_a.d"), F.col("_b.d"), F.lit(0.0))
    return got.withColumn(out, F.when(F.col(known), F.col(value)).otherwise(F.col(filled) + ramp)).drop("_row", "_a", "_b")


def densified(df: DataFrame, key: str, frame: str, reason: str = "reason") -> DataFrame:
    """One row for every frame from a key's first to its last; rows that weren't there have NULLs and reason
    "missing", the others "observed"."""
    every = df.groupBy(key).agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi")).select(key, F.explode(F.sequence("_lo", "_hi")).alias(frame))
    return every.join(df.withColumn("_here", F.lit(True)), [key, frame], "left").withColumn(
        reason, F.when(F.col("_here"), "observed").otherwise("missing")).drop("_here")


def sliding_windows(df: DataFrame, key: str, order: str, size: int = 120, step: int = 100, out: str = "window") -> DataFrame:
    """A row for every window of `size` rows, `step` apart, that holds a row; `last` tells whether it is the row's last
    window, whose result counts."""
    got = df.withColumn("_p", F.row_number().over(over(key, order)) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_p") - size + 1) / step))
    held = F.sequence(first.cast("long"), F.floor(F.col("_p") / step).cast("long"))
    return got.withColumn(out, F.explode(held)).withColumn("last", F.col(out) == F.floor(F.col("_p") / step)).drop("_p")


def clipped_delta(df: DataFrame, value: str, smooth: str, most: float) -> DataFrame:
    """delta = smooth - value held within +-most, clipped (whether it was), and moved = value + delta."""
    raw = F.col(smooth) - F.col(value)
    return df.withColumn("delta", F.greatest(F.lit(-most), F.least(F.lit(most), raw))).withColumn(
        "clipped", (F.abs(raw) > most).cast("int")).withColumn("moved", F.col(value) + F.col("delta"))


def bracket_fill(df: DataFrame, key: str, order: str, position: str, value: str, out: str = "filled", reach: float | None = None) -> DataFrame:
    """Missing values by linear interpolation between the values around them; ends hold; and the
    gap's length in positions (999 without both ends). Series with a single value stay as they are.
    reach: values further away in position count for nothing (12 frames, say); None is no bound."""
    w = over(key, order)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    got = df.withColumn("_a", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_b", F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("_many", F.count(value).over(Window.partitionBy(key)) > 1)
    if reach is not None:
        got = got.withColumn("_a", F.when(F.col(position) - F.col("_a.p") <= reach, F.col("_a"))).withColumn("_b", F.when(F.col("_b.p") - F.col(position) <= reach, F.col("_b")))
    t = (F.col(position) - F.col("_a.p")) / F.nullif(F.col("_b.p") - F.col("_a.p"), F.lit(0).cast(df.schema[position].dataType))
    mixed = F.col("_a.v") + t * (F.col("_b.v") - F.col("_a.v"))
    found = F.coalesce(F.col(value), F.when(F.col("_many"), F.coalesce(mixed, F.col("_a.v"), F.col("_b.v"))))
    return got.withColumn(out, found).withColumn(
        "gap", F.when(F.col(value).isNotNull(), F.lit(0)).otherwise(F.coalesce((F.col("_b.p") - F.col("_a.p") - 1).cast("long"), F.lit(999)))
    ).drop("_a", "_b", "_many")


def nearest(df: DataFrame, key: str, position: str, value: str, is_reference: Column, out: str = "nearest") -> DataFrame:
    """The value of the reference row nearest in position; the earlier one if two are as near; NULL in a series without
    one. Of references at one position any counts."""
    w = over(key, position)
    here = F.when(is_reference, F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    got = df.withColumn("_a", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_b", F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    before = F.col("_b").isNull() | (F.col(position) - F.col("_a.p") <= F.col("_b.p") - F.col(position))
    return got.withColumn(out, F.when(F.col("_a").isNotNull() & before, F.col("_a.v")).otherwise(F.col("_b.v"))).drop("_a", "_b")


def nearest_of_label(df: DataFrame, key: str, label: str, position: str, value: str, is_reference: Column, out: str = "nearest") -> DataFrame:
    """As nearest(), among the references of the row's own label; where its series has none, among those of any label. And
    source: label, any or none. NULL labels are a label."""
    one = nearest(df.withColumn("_k", F.struct(key, label)), "_k", position, value, is_reference, "_own").withColumn(
        "_has", F.max(F.coalesce(is_reference, F.lit(False)).cast("int")).over(Window.partitionBy(key, label)) == 1)
    got = nearest(one.drop("_k"), key, position, value, is_reference, "_any")
    some = F.max(F.coalesce(is_reference, F.lit(False)).cast("int")).over(Window.partitionBy(key)) == 1
    got = got.withColumn(out, F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_any")))
    return got.withColumn("source", F.when(F.col("_has"), "label").when(some, "any").otherwise("none")).drop("_own", "_any", "_has")


def last_seen_jump(df: DataFrame, key: str, arrival: str, v: list[str], out: str = "jump") -> DataFrame:
    """Distance of each row's point to the last finite one of its track in order of arrival (a number of the input's rows), however long ago;
    NULL for the first and for rows that aren't finite."""
    good = finite(F.col(v[0])).isNotNull()
    for c in v[1:]:
        good &= finite(F.col(c)).isNotNull()
    last = F.last(F.when(good, F.struct(*v)), ignorenulls=True).over(over(key, arrival).rowsBetween(Window.unboundedPreceding, -1))
    got = df.withColumn("_last", last)
    gap = F.sqrt(sum(((F.col(c) - F.col(f"_last.{c}")) * (F.col(c) - F.col(f"_last.{c}")) for c in v[1:]), (F.col(v[0]) - F.col(f"_last.{v[0]}")) * (F.col(v[0]) - F.col(f"_last.{v[0]}"))))
    return got.withColumn(out, F.when(good, gap)).drop("_last")


def majority(df: DataFrame, key: str, label: str, weight: Column, order: str, out: str = "label") -> DataFrame:
    """key and the label of the largest summed weight; the label seen first wins ties. NULL is a label; NULL weights add
    nothing; no rows give none."""
    per = df.groupBy(key, label).agg(F.sum(weight).alias("_w"), F.min(order).alias("_first"))
    best = F.max_by(F.col(label), F.struct(F.col("_w"), -F.col("_first")))
    return per.groupBy(key).agg(best.alias(out), F.max("_w").alias("weight"), F.count(F.lit(1)).alias("labels"))


def stats(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """count, min, p10, median, mean, p90, p95, max and population std of the finite values; NULL where there are none."""
    v = finite(F.col(value))
    p = F.percentile(v, F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9, 0.95)]))
    got = df.groupBy(*key).agg(F.count(v).alias("count"), F.min(v).alias("min"), p.alias("_p"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))
    names = ("p10", "median", "p90", "p95")
    return got.select(*key, "count", "min", "max", "mean", "std", *[F.get("_p", i).alias(n) for i, n in enumerate(names)])


def steady_signs(df: DataFrame, key: str, order: str, q: list[str]) -> DataFrame:
    """Quaternions turned so that each is on the side of the one before: flipped where the number of sign changes up to
    a row is odd. A product of exactly 0 starts anew, unflipped."""
    w = over(key, order)
    product = sum((F.col(c) * F.lag(c).over(w) for c in q[1:]), F.col(q[0]) * F.lag(q[0]).over(w))
    got = df.withColumn("_dot", product).withColumn("_anew", F.sum(F.when(F.col("_dot") == 0, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(key, "_anew").orderBy(order)
    turns = F.sum(F.when(F.col("_dot") < 0, 1).otherwise(0)).over(inside)
    got = got.withColumn("_flip", F.when(turns % 2 == 1, -1.0).otherwise(1.0))
    return got.withColumns({c: F.col("_flip") * F.col(c) for c in q}).drop("_dot", "_anew", "_flip")


def smooth_quaternions(df: DataFrame, key: str, order: str, q: list[str]) -> DataFrame:
    """Savitzky-Golay (7, 2) on each part of sign-steady quaternions, then unit length."""
    got = steady_signs(df, key, order, q)
    for c in q:
        got = savgol(got, key, order, c, f"_{c}")
    length = F.greatest(F.sqrt(sum((F.col(f"_{c}") * F.col(f"_{c}") for c in q[1:]), F.col(f"_{q[0]}") * F.col(f"_{q[0]}"))), F.lit(1e-8))
    return got.withColumns({c: F.col(f"_{c}") / length for c in q}).drop(*[f"_{c}" for c in q])
