"""Ladders and robust estimators: visible joints, anchors, depth corrections, depth from 2D, phases of a motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite
from seriesforge.operators import series

# Joints that are reliable, and those that are stable when seen, by number.
RELIABLE = (0, 5, 9, 13, 17)
STABLE = (0, 1, 2, 5, 6, 9, 10, 13, 14, 17, 18)


def visible_choice(visible: Column, sampled: Column, reliable: int = 2, stable: int = 3, every: int | None = None) -> Column:
    """joints and source: the reliable ones that are seen and sampled if there are enough, else the stable ones, else (if
    `every` is given) all, else none. visible (numbers) and sampled (booleans) are arrays by joint."""
    seen = F.filter(F.sequence(F.lit(0), F.size(visible) - 1), lambda j: (F.get(visible, j) > 0) & F.coalesce(F.get(sampled, j), F.lit(False)))
    a, b = F.filter(seen, lambda j: j.isin(*RELIABLE)), F.filter(seen, lambda j: j.isin(*STABLE))
    option = lambda joints, name: F.struct(joints.alias("joints"), F.lit(name).alias("source"))
    out = F.when(F.size(a) >= reliable, option(a, "visible_reliable_joints")).when(F.size(b) >= stable, option(b, "visible_stable_joints"))
    if every is not None:
        out = out.when(F.size(seen) >= every, option(seen, "visible_all_joints_fallback"))
    return out.otherwise(option(F.array().cast("array<int>"), "keep_previous_low_visible_depth"))


def first_ok(options: list[tuple[str, Column, Column]]) -> Column:
    """name and value of the first option (name, ok, value) that is ok; NULL if none is."""
    out = F.lit(None)
    for name, ok, value in reversed(options):
        out = F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("name"), value.alias("value"))).otherwise(out)
    return out


def robust_translation(df: DataFrame, keys: list[str], joint: str, shift: list[str], least: int = 2) -> DataFrame:
    """Component medians of the shifts (depth point - relative point) of the reliable joints, if `least` of them are
    finite throughout, else of all; source, count, rms and the largest residual."""
    good = finite(F.col(shift[0])).isNotNull()
    for c in shift[1:]:
        good &= finite(F.col(c)).isNotNull()
    whole = Window.partitionBy(*keys)
    got = df.withColumn("_rel", good & F.col(joint).isin(*RELIABLE)).withColumn("_enough", F.sum(F.col("_rel").cast("int")).over(whole) >= least)
    got = got.withColumn("_use", F.when(F.col("_enough"), F.col("_rel")).otherwise(good)).filter("_use")
    got = got.withColumns({f"_{c}": F.percentile(c, 0.5).over(whole) for c in shift})
    gap = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in shift[1:]), (F.col(shift[0]) - F.col(f"_{shift[0]}")) * (F.col(shift[0]) - F.col(f"_{shift[0]}"))))
    return got.withColumn("_gap", gap).groupBy(*keys).agg(
        *[F.first(f"_{c}").alias(c) for c in shift], F.count("*").alias("count"), F.sqrt(F.avg(F.col("_gap") * F.col("_gap"))).alias("rms"),
        F.max("_gap").alias("max"), F.when(F.first("_enough"), "depth_reliable_joints").otherwise("depth_all_joints").alias("source"))


def depth_corrections(df: DataFrame, frame: str, depth: str, template: str, near: float = 0.1, far: float = 10.0, least: int = 100,
                      rounds: int = 5, least_inliers: int = 50) -> DataFrame:
    """frame, scale and offset, so that scale * depth + offset is near the template; 1 and 0 with fewer than `least` pixels in range.

    df holds a row for each static pixel of a frame. Scale begins as the median ratio of the pixels that lie between near and far in both; each
    round takes it over the residuals within twice their median (0.01 at least), unless fewer than least_inliers are left. Offset is the
    median residual of all. Every round is two grouped medians joined back to the pixels, on one exchange by frame.
    Frames with no pixel in range have scale 1, too; NULLs and what isn't finite are out of range.
    """
    d, t = finite(F.col(depth)), finite(F.col(template))
    inside = (d > near) & (d < far) & (t > near) & (t < far)
    frames = df.select(frame).distinct()
    px = df.filter(inside).select(frame, d.alias("_d"), t.alias("_t")).repartition(frame)
    now = px.groupBy(frame).agg(F.percentile(F.col("_t") / F.col("_d"), 0.5).alias("_scale"), F.count("*").alias("_n"))
    gap = F.abs(F.col("_d") * F.col("_scale") - F.col("_t"))
    for _ in range(rounds):
        middle = px.join(now, frame).groupBy(frame).agg(F.first("_scale").alias("_scale"), F.first("_n").alias("_n"), F.percentile(gap, 0.5).alias("_gap"))
        near_by = gap < F.greatest(2 * F.col("_gap"), F.lit(0.01))
        again = px.join(middle, frame).groupBy(frame).agg(
            F.first("_scale").alias("_was"), F.first("_n").alias("_n"), F.count(F.when(near_by, 1)).alias("_in"), F.percentile(F.when(near_by, F.col("_t") / F.col("_d")), 0.5).alias("_new"))
        now = again.select(frame, "_n", F.when(F.col("_in") < least_inliers, F.col("_was")).otherwise(F.col("_new")).alias("_scale"))
    shift = px.join(now, frame).groupBy(frame).agg(
        F.first("_scale").alias("_scale"), F.first("_n").alias("_n"), F.percentile(F.col("_t") - F.col("_d") * F.col("_scale"), 0.5).alias("_offset"))
    enough = F.coalesce(F.col("_n") >= least, F.lit(False))
    return frames.join(shift, frame, "left").select(frame, F.when(enough, F.col("_scale")).otherwise(1.0).alias("scale"), F.when(enough, F.col("_offset")).otherwise(0.0).alias("offset"))


def corrected(depth: Column, scale: Column, offset: Column) -> Column:
    """Never below 0; pixels without depth stay so."""
    return F.when(depth > 0, F.greatest(F.lit(0.0), scale * depth + offset)).otherwise(depth)


def median_of(values: Column) -> Column:
    """Of an array; NULL if it is empty."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def solve_xy(points: Column, tz: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """tx and ty at depth tz, medians over points (x, y, z relative; u, v seen), and how many points count."""
    seen = F.filter(points, lambda p: (p["z"] + tz > 1e-8) & finite(p["u"]).isNotNull() & finite(p["v"]).isNotNull())
    return F.struct(
        median_of(F.transform(seen, lambda p: (p["u"] - cx) * (p["z"] + tz) / fx - p["x"])).alias("tx"),
        median_of(F.transform(seen, lambda p: (p["v"] - cy) * (p["z"] + tz) / fy - p["y"])).alias("ty"), F.size(seen).alias("count"))


def fit_depth(df: DataFrame, key: str, points: str, seed: Column, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """key, tx, ty, tz and rms: the depth of the least reprojection error, on a grid of 90 depths around the seed and then
    one of 80 around the best of them; the lesser depth wins ties. Depths are rows, so a grid is many tasks' work."""
    s = F.when(finite(seed) > 0, seed).otherwise(0.4)

    def best(grid: DataFrame) -> DataFrame:
        solved = grid.withColumn("_t", solve_xy(F.col(points), F.col("_z"), fx, fy, cx, cy))
        error = F.transform(F.filter(points, lambda p: finite(p["u"]).isNotNull() & finite(p["v"]).isNotNull() & (p["z"] + F.col("_z") > 1e-8)), lambda p: (
            F.pow(fx * (p["x"] + F.col("_t.tx")) / (p["z"] + F.col("_z")) + cx - p["u"], 2) + F.pow(fy * (p["y"] + F.col("_t.ty")) / (p["z"] + F.col("_z")) + cy - p["v"], 2)))
        scored = solved.withColumn("rms", F.sqrt(F.aggregate(error, F.lit(0.0), lambda a, e: a + e) / F.nullif(F.size(error), F.lit(0)))).filter(finite(F.col("rms")).isNotNull())
        return scored.groupBy(key).agg(F.min(F.struct("rms", F.col("_z").alias("tz"), F.col("_t.tx").alias("tx"), F.col("_t.ty").alias("ty"))).alias("_b"))

    def spread(low: Column, high: Column, n: int) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / (n - 1)))

    base = df.select(key, points, s.alias("_s"))
    coarse = best(base.withColumn("_z", spread(F.greatest(F.lit(0.06), F.col("_s") * 0.45), F.least(F.lit(1.5), F.col("_s") * 1.8 + 0.05), 90)))
    near = base.join(coarse, key).withColumn("_z", spread(F.greatest(F.lit(0.05), F.col("_b.tz") - 0.04), F.col("_b.tz") + 0.04, 80)).drop("_b")
    both = coarse.unionByName(best(near)).groupBy(key).agg(F.min("_b").alias("_b"))
    return both.select(key, "_b.tx", "_b.ty", "_b.tz", "_b.rms")


def contact_windows(df: DataFrame, key: str, order: str, z: str, speed: str, closed: Column, fps: float) -> DataFrame:
    """key, n, pick_from, pick_to, release_from, release_to (places from 0; release NULL without one), source and confidence.

    Pick: around the first closing; else the first run of low and slow rows in the first 45 % (or at all); else around the lowest
    row of the first half. Release: around the next opening; else the last low and slow run from 45 % on. Low and slow are the
    30th and 38th percentile of the smoothed height and speed. A release within the pick is none.
    """
    half, least = max(2, round(0.20 * fps)), max(2, round(0.12 * fps))
    window, gap = max(3, round(0.35 * fps)), max(1, round(0.08 * fps))
    whole, w = Window.partitionBy(key), series.over(key, order)
    got = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_rows", F.count(F.lit(1)).over(whole)).withColumn("_closed", F.coalesce(closed, F.lit(False)))
    got = series.moving_average(series.moving_average(got, key, order, z, window, "_z"), key, order, speed, window, "_s")
    low = (F.col("_z") <= F.percentile("_z", 0.30).over(whole)) & (F.col("_s") <= F.percentile("_s", 0.38).over(whole))
    got = got.withColumn("_low", low)
    runs = series.islands(got.filter("_low").select(key, "_at"), key, "_at", F.lit(True), gap, least).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))).alias("_runs"))
    first_half = F.greatest(F.lit(2), F.floor(F.col("_rows") / 2))
    per = got.groupBy(key).agg(F.first("_rows").alias("n"), F.min(F.when(F.col("_at") < first_half, F.struct("_z", "_at"))).alias("_lowest"))
    edges = series.transitions(got, key, order, F.col("_closed"))
    all_ = per.join(edges, key).join(runs, key, "left").withColumn("_runs", F.coalesce("_runs", F.array().cast("array<struct<a:int,b:int>>")))
    last = F.col("n") - 1
    late = F.bround(0.45 * last, 0)
    around = lambda c: F.struct(F.greatest(F.lit(0), c - half).cast("int").alias("a"), F.least(last, c + half).cast("int").alias("b"))
    early_runs, late_runs = F.filter("_runs", lambda r: r["a"] <= late), F.filter("_runs", lambda r: r["a"] >= late)
    one = F.when(F.col("close_at").isNotNull(), around(F.col("close_at"))).when(F.size("_runs") > 0, F.coalesce(F.get(early_runs, 0), F.get("_runs", 0))).otherwise(
        around(F.col("_lowest._at")))
    two = F.when(F.col("release_at").isNotNull(), around(F.col("release_at"))).when(F.size(late_runs) > 0, F.element_at(late_runs, -1)).when(
        F.size("_runs") >= 2, F.element_at("_runs", -1))
    source = F.when(F.col("close_at").isNotNull(), "gripper_close_transition").when(F.size("_runs") > 0, "low_z_slow").otherwise("fallback_first_low_height")
    sure = F.when(F.col("close_at").isNotNull(), 0.86).when(F.size("_runs") > 0, 0.62).otherwise(0.38)
    found = all_.withColumn("_one", one).withColumn("_two", two).withColumn("source", source).withColumn("confidence", sure)
    apart = F.col("_two.a") > F.col("_one.b") + least
    return found.select(key, "n", F.col("_one.a").alias("pick_from"), F.col("_one.b").alias("pick_to"), F.when(apart, F.col("_two.a")).alias("release_from"),
                        F.when(apart, F.col("_two.b")).alias("release_to"), "source", "confidence")


def phases(windows: DataFrame, key: str) -> DataFrame:
    """key, phase, first and last from contact_windows(): approach, contact, motion, release and retreat, and "unknown" for places
    between them; confidence falls with the distance from what was seen."""
    c, last = F.col("confidence"), F.col("n") - 1
    p0, p1, r0, r1 = (F.col(x) for x in ("pick_from", "pick_to", "release_from", "release_to"))
    some = r0.isNotNull()
    part = lambda on, name, a, b, sure: F.when(F.coalesce(on, F.lit(False)), F.struct(
        F.lit(name).alias("phase"), a.cast("int").alias("first"), b.cast("int").alias("last"), sure.alias("confidence")))
    at_least = lambda x, y: F.greatest(F.lit(x), y)
    listed = F.array_compact(F.array(
        part(p0 > 0, "pre_contact_approach", F.lit(0), p0 - 1, at_least(0.25, c - 0.08)), part(F.lit(True), "touch_contact", p0, p1, c),
        part(some & (r0 > p1 + 1), "grasp_object_motion", p1 + 1, r0 - 1, at_least(0.30, c - 0.05)), part(some, "place_release_contact", r0, r1, at_least(0.25, c - 0.08)),
        part(some & (r1 < last), "post_release_retreat", r1 + 1, last, at_least(0.20, c - 0.15)), part(~some & (p1 < last), "grasp_object_motion", p1 + 1, last, at_least(0.25, c - 0.12))))
    got = windows.select(key, "n", F.explode(listed).alias("_x")).select(key, "n", "_x.*")
    w = Window.partitionBy(key).orderBy("first")
    ends = got.withColumn("_next", F.coalesce(F.lead("first").over(w), F.col("n")))
    gaps = ends.filter(F.col("_next") > F.col("last") + 1).select(
        key, F.lit("unknown").alias("phase"), (F.col("last") + 1).alias("first"), (F.col("_next") - 1).cast("int").alias("last"), F.lit(0.10).alias("confidence"))
    return got.drop("n").unionByName(gaps)
