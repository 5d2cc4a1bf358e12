"""Poses: arrays of joint rotations (axis-angle structs of x, y, z), held to joint limits, interpolated and repaired.

All of a row's joints are worked on in place, step by step over arrays; only the neighbours in the series come by a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions import rotations as R
from seriesforge.functions import scalars as S
from seriesforge.functions.scalars import finite
from seriesforge.operators.series import densified, over

# Degrees of swing and of twist (to either side) that a joint has, by its place in the pose: index, middle, ring and little
# finger, each from the knuckle on, then the thumb.
KNUCKLE, HINGE = (90, 25), (110, 5)
LIMITS = (*(KNUCKLE, HINGE, HINGE) * 4, (60, 40), (80, 15), (80, 5))

XYZ = "struct<x:double,y:double,z:double>"


def vector(v) -> Column:
    return F.struct(*[x.alias(n) for x, n in zip(v, "xyz", strict=True)])


def parts(s: Column, names: str = "xyz") -> list[Column]:
    return [s[n] for n in names]


def quaternion(q) -> Column:
    return F.struct(*[x.alias(n) for x, n in zip(q, "wxyz", strict=True)])


def clamped_pose(pose: Column, limits: tuple[tuple[float, float], ...] = LIMITS) -> Column:
    """x, y, z and changed (boolean) of each joint, with swing and twist held to its limits.

    Twist is the part of the rotation vector along the joint's x axis, swing the rotation that is left when it is taken off; both
    are cut to the limits (twist to either side) and put together again. Joints within them stay as they are, as do
    those without a limit, without rotation, or with a NULL.
    """
    limit = F.array(*[F.struct(F.lit(math.radians(a)).alias("s"), F.lit(math.radians(b)).alias("t")) for a, b in limits])
    # one step after another, so that no expression is repeated in the next one's
    turned = F.transform(pose, lambda p, j: F.struct(
        p.alias("p"), quaternion(R.axis_angle_to_quaternion(parts(p))).alias("q"), quaternion([F.cos(p["x"] / 2), F.sin(p["x"] / 2), F.lit(0.0), F.lit(0.0)]).alias("t"),
        F.get(limit, j).alias("l")))
    swung = F.transform(turned, lambda s: F.struct(
        s["p"].alias("p"), s["l"].alias("l"), quaternion(R.upright(R.quaternion_product(parts(s["q"], "wxyz"), R.conjugate(parts(s["t"], "wxyz"))))).alias("q")))
    angled = F.transform(swung, lambda s: F.struct(s["p"].alias("p"), s["l"].alias("l"), s["q"].alias("q"), S.norm(parts(s["q"])).alias("n")))
    held = F.transform(angled, lambda s: F.struct(
        s["p"].alias("p"), s["q"].alias("q"), s["n"].alias("n"), s["l"].alias("l"), (2 * F.atan2(s["n"], s["q"]["w"])).alias("swing")))
    cut = F.transform(held, lambda s: F.struct(
        s["p"].alias("p"), s["q"].alias("q"), s["n"].alias("n"),
        F.coalesce((S.norm(parts(s["p"])) >= 1e-8) & ((s["swing"] > s["l"]["s"]) | (F.abs(s["p"]["x"]) > s["l"]["t"])), F.lit(False)).alias("changed"),
        F.least(s["swing"], s["l"]["s"]).alias("swing"), F.greatest(-s["l"]["t"], F.least(s["l"]["t"], s["p"]["x"])).alias("twist")))
    joined = F.transform(cut, lambda s: F.struct(s["p"].alias("p"), s["changed"].alias("changed"), quaternion(R.upright(R.quaternion_product(
        [F.cos(s["swing"] / 2), *[F.when(s["n"] > 1e-12, F.sin(s["swing"] / 2) * x / s["n"]).otherwise(0.0) for x in parts(s["q"])]],
        [F.cos(s["twist"] / 2), F.sin(s["twist"] / 2), F.lit(0.0), F.lit(0.0)]))).alias("q")))
    return F.transform(joined, lambda s: F.struct(
        *[F.when(s["changed"], v).otherwise(s["p"][n]).alias(n) for v, n in zip(R.quaternion_to_axis_angle(parts(s["q"], "wxyz")), "xyz", strict=True)], s["changed"].alias("changed")))


def between(a: Column, b: Column, t: Column) -> Column:
    """The pose a share t of the way from a to b, joint by joint, each on the shorter arc. Joints that one lacks are NULL."""
    both = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.struct(
        quaternion(R.axis_angle_to_quaternion(parts(z["a"]))).alias("a"), quaternion(R.axis_angle_to_quaternion(parts(z["b"]))).alias("b")))
    mixed = F.transform(both, lambda z: quaternion(S.slerp(parts(z["a"], "wxyz"), parts(z["b"], "wxyz"), t)))
    return F.transform(mixed, lambda q: vector(R.quaternion_to_axis_angle(parts(q, "wxyz"))))


def mixed_vector(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (1 - t) * x + t * y)


def _brackets(df: DataFrame, key: list[str], order: str, good: Column, columns: list[str]) -> DataFrame:
    """df with _a and _b: order and columns of the last good row up to each row and of the first from it on."""
    w = over(key, order)
    here = F.when(good, F.struct(F.col(order).cast("double").alias("_o"), *columns))
    return df.withColumn("_a", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_b", F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def filled(df: DataFrame, key: str | list[str], order: str, good: Column, poses: list[str], vectors: list[str] = []) -> DataFrame:  # noqa: B006
    """df with poses (axis-angle arrays) interpolated on arcs, and vectors (arrays of doubles) along lines, where a row isn't good.

    Ends hold the nearest good row. A series with one good row has its poses everywhere, while its vectors stay as they are;
    without any, nothing changes.
    """
    keys = [key] if isinstance(key, str) else key
    got = _brackets(df, keys, order, good, [*poses, *vectors]).withColumn("_good", F.coalesce(good, F.lit(False)))
    got = got.withColumn("_many", F.count(F.when(F.col("_good"), 1)).over(Window.partitionBy(*keys)))
    t = (F.col(order) - F.col("_a._o")) / F.nullif(F.col("_b._o") - F.col("_a._o"), F.lit(0.0))
    got = got.withColumn("_t", t)

    def value(c: str, mix) -> Column:
        inside = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        return F.when(inside, mix(F.col(f"_a.{c}"), F.col(f"_b.{c}"), F.col("_t"))).otherwise(F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}")))

    new = {c: F.when(~F.col("_good") & (F.col("_many") >= 1), value(c, between)).otherwise(F.col(c)) for c in poses}
    new |= {c: F.when(~F.col("_good") & (F.col("_many") >= 2), value(c, mixed_vector)).otherwise(F.col(c)) for c in vectors}
    return got.withColumns(new).drop("_a", "_b", "_good", "_many", "_t")


def repaired(df: DataFrame, key: str | list[str], frame: str, bad: Column, poses: list[str], vectors: list[str], reach: int = 0) -> DataFrame:
    """df with bad rows between two good ones made anew from them, and how: alpha (the share of the way), prev_frame, next_frame and
    method: repaired, no_good_bracket, no_near_good_bracket (further than `reach` frames, if it isn't 0) or none (a good row).

    Poses go along arcs, vectors along lines. A NULL in bad is good.
    """
    keys = [key] if isinstance(key, str) else key
    off = F.coalesce(bad, F.lit(False))
    got = _brackets(df.withColumn("_bad", off), keys, frame, ~F.col("_bad"), [*poses, *vectors])
    here, a, b = F.col(frame), F.col("_a._o"), F.col("_b._o")
    far = (F.lit(reach) > 0) & ((here - a > reach) | (b - here > reach))
    method = F.when(~F.col("_bad"), "none").when(a.isNull() | b.isNull(), "no_good_bracket").when(far, "no_near_good_bracket").otherwise("repaired")
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (here - a) / F.greatest(b - a, F.lit(1.0))))
    got = got.withColumn("method", method).withColumn("alpha", F.when(F.col("method") == "repaired", alpha))
    known = F.col("_bad") & a.isNotNull() & b.isNotNull()
    got = got.withColumn("prev_frame", F.when(known, a).cast("long")).withColumn("next_frame", F.when(known, b).cast("long"))
    fresh = F.col("method") == "repaired"
    new = {c: F.when(fresh, between(F.col(f"_a.{c}"), F.col(f"_b.{c}"), F.col("alpha"))).otherwise(F.col(c)) for c in poses}
    new |= {c: F.when(fresh, mixed_vector(F.col(f"_a.{c}"), F.col(f"_b.{c}"), F.col("alpha"))).otherwise(F.col(c)) for c in vectors}
    return got.withColumns(new).drop("_a", "_b", "_bad")


def infilled(df: DataFrame, key: str, frame: str, poses: list[str], vectors: list[str], short: int = 2, edge: int = 999) -> DataFrame:
    """A row for every frame between a key's first and last; those that were missing are filled() and tell how: gap_len (`edge`
    without rows on both sides), nearest_frame, method (neighbour up to `short` frames, else interpolation; observed for the others)."""
    dense = densified(df.select(key, frame, *poses, *vectors), key, frame)
    seen = F.col("reason") == "observed"
    w = over(key, frame)
    before = F.last(F.when(seen, F.col(frame)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(seen, F.col(frame)), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = filled(dense, key, frame, seen, poses, vectors).withColumn("_p", before).withColumn("_n", after)
    gap = F.when(seen, 0).when(F.col("_p").isNull() | F.col("_n").isNull(), edge).otherwise(F.col("_n") - F.col("_p") - 1).cast("long")
    near = F.when(F.col("_n").isNull() | (F.col(frame) - F.col("_p") <= F.col("_n") - F.col(frame)), F.col("_p")).otherwise(F.col("_n"))
    got = got.withColumn("gap_len", gap).withColumn("nearest_frame", near.cast("long"))
    return got.withColumn("method", F.when(seen, "observed").when(F.col("gap_len") <= short, "neighbour").otherwise("interpolation")).drop("_p", "_n", "reason")


def rotation_jump(q: list[Column], w) -> Column:
    """Degrees between a row's unit quaternion and that of the row before; NULL for the first row and where one isn't finite."""
    product = sum((finite(c) * finite(F.lag(c).over(w)) for c in q[1:]), finite(q[0]) * finite(F.lag(q[0]).over(w)))
    return F.when(product.isNotNull(), F.degrees(2 * F.acos(F.least(F.abs(product), F.lit(1.0)))))


def shifted_mean(df: DataFrame, key: str, frame: str, depth: str, place: str, half: int = 2) -> DataFrame:
    """df with each frame's `place` (depths of its points) shifted so that their mean follows the rolling median of the frames' means, and the shift.

    Rows are points of frames; depth is the column that is moved to `place`.
    """
    means = df.groupBy(key, frame).agg(F.avg(finite(F.col(depth))).alias("_m"))
    smooth = F.percentile("_m", 0.5).over(over(key, frame).rowsBetween(-half, half))
    by = means.select(key, frame, (smooth - F.col("_m")).alias("shift"))
    return df.join(by, [key, frame], "left").withColumn(place, F.col(depth) + F.col("shift"))
