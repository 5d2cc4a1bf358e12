"""Silhouettes laid over masks: which shift covers a mask best, from coarse to fine.

A silhouette is kept as runs of pixels, a mask's row as running sums of its weights, so that a run at a shift costs two look-ups, however
many pixels it has. Runs meet the mask's rows by an equi join for each vertical shift; horizontal shifts are looked up in the same row.
All pixels of a silhouette are shifted alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite


def pixel_runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, py, x0 and x1: the runs of neighbouring pixels in each row of a silhouette. Repeated pixels count once."""
    w = Window.partitionBy(*keys, "py").orderBy("px")
    start = pixels.select(*keys, "px", "py").distinct().withColumn("_run", F.col("px") - F.row_number().over(w))
    return start.groupBy(*keys, "py", "_run").agg(F.min("px").alias("x0"), F.max("px").alias("x1")).drop("_run")


def row_sums(mask: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, py and sums: for each x from 0 to width the weight of the row's pixels before x. Pixels outside and NULL weights weigh nothing."""
    rows = mask.select(*keys, "py").distinct().withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    cells = rows.join(mask.groupBy(*keys, "py", "px").agg(F.max(finite(F.col("weight"))).alias("_w")), [*keys, "py", "px"], "left")
    upto = F.sum(F.coalesce("_w", F.lit(0.0))).over(Window.partitionBy(*keys, "py").orderBy("px").rowsBetween(Window.unboundedPreceding, 0))
    listed = cells.withColumn("_s", upto).groupBy(*keys, "py").agg(F.array_sort(F.collect_list(F.struct("px", "_s"))).alias("_all"))  # of one row
    return listed.select(*keys, "py", F.concat(F.array(F.lit(0.0)), F.transform("_all", lambda x: x["_s"])).alias("sums"))


def forearm_weight(px: Column, py: Column, wrist: tuple[Column, Column], knuckles: tuple[Column, Column], weight: float = 0.20) -> Column:
    """1 for pixels of the hand, `weight` for those beyond the wrist, seen from the middle of the knuckles; 1 where the two are in one place or unknown."""
    dx, dy = wrist[0] - knuckles[0], wrist[1] - knuckles[1]
    beyond = (F.sqrt(dx * dx + dy * dy) >= 1e-6) & ((px - wrist[0]) * dx + (py - wrist[1]) * dy > 0)
    return F.when(F.coalesce(beyond, F.lit(False)), float(weight)).otherwise(1.0)


def best_shift(runs: DataFrame, sums: DataFrame, keys: list[str], width: int, height: int, reach: int, step: int = 1, centre: DataFrame | None = None,
               precision_weight: float = 0.35, shift_penalty: float = 0.0015, least_area: int = 80) -> DataFrame:
    """keys, du, dv, score, coverage, precision and area of the best shift of each silhouette (pixel_runs) over its mask (row_sums).

    Shifts go from -reach to reach by step around a centre (keys, du, dv; 0 without one). score = (1 - p) * coverage + p * precision - penalty
    * length of the shift, where coverage is the covered share of the mask's weight and precision the covered weight by the silhouette's
    pixels inside the image. Shifts with fewer than least_area of these, and masks without weight, score -1e9. Among equal scores the
    least du, then dv. Silhouettes without a mask score so, too.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach), F.lit(step))
    placed = runs if centre is None else runs.join(centre.select(*keys, F.col("du").alias("_cu"), F.col("dv").alias("_cv")), keys)
    cu, cv = (F.lit(0), F.lit(0)) if centre is None else (F.col("_cu"), F.col("_cv"))
    moved = placed.select(*keys, "x0", "x1", F.col("py").alias("_y"), cu.alias("_u"), F.explode(F.transform(steps, lambda d: d + cv)).alias("dv")).withColumn(
        "py", F.col("_y") + F.col("dv"))
    inside = F.when((F.col("py") >= 0) & (F.col("py") < height), True)
    met = moved.withColumn("_in", inside).join(sums, [*keys, "py"], "left")
    each = met.select(*keys, "dv", "_in", "sums", "x0", "x1", F.explode(F.transform(steps, lambda d: d + F.col("_u"))).alias("du"))
    edge = lambda x: F.greatest(F.lit(0), F.least(F.lit(width), x)).cast("int")
    a, b = edge(F.col("x0") + F.col("du")), edge(F.col("x1") + F.col("du") + 1)
    part = F.when(F.col("_in"), F.coalesce(F.get("sums", b) - F.get("sums", a), F.lit(0.0))).otherwise(0.0)
    got = each.groupBy(*keys, "du", "dv").agg(F.sum(part).alias("_w"), F.sum(F.when(F.col("_in"), b - a).otherwise(0)).alias("area"))
    total = sums.groupBy(*keys).agg(F.sum(F.get("sums", width)).alias("_total"))
    scored = got.join(total, keys, "left").withColumn("coverage", F.when(F.col("_total") > 1e-6, F.col("_w") / F.col("_total")))
    scored = scored.withColumn("precision", F.col("_w") / F.greatest(F.col("area"), F.lit(1)))
    length = F.sqrt((F.col("du") * F.col("du") + F.col("dv") * F.col("dv")).cast("double"))
    score = (1 - precision_weight) * F.col("coverage") + precision_weight * F.col("precision") - shift_penalty * length
    bad = (F.col("area") < least_area) | F.col("coverage").isNull()
    scored = scored.withColumn("score", F.when(bad, -1e9).otherwise(score)).withColumns({c: F.when(bad, 0.0).otherwise(F.col(c)) for c in ("coverage", "precision")})
    return scored.groupBy(*keys).agg(F.max_by(F.struct("du", "dv", "score", "coverage", "precision", "area"), F.struct("score", -F.col("du"), -F.col("dv"))).alias("_b")).select(*keys, "_b.*")


def refined_shift(runs: DataFrame, sums: DataFrame, keys: list[str], width: int, height: int, coarse: tuple[int, int] = (34, 6), fine: tuple[int, int] = (10, 2), **score) -> DataFrame:
    """best_shift() on a coarse grid (reach, step), then on a fine one around what was best there."""
    first = best_shift(runs, sums, keys, width, height, *coarse, **score)
    return best_shift(runs, sums, keys, width, height, *fine, centre=first, **score)


def sampled_depth(points: DataFrame, depths: DataFrame, keys: list[str], point: str, u: str, v: str, radius: int, least: int, most_span: float, mask: DataFrame | None = None,
                  least_depth: float = 0.01) -> DataFrame:
    """points with depth (median), count, span (p90 - p10), std and status of the depths at most `radius` pixels around each, in either direction.

    depths: keys, px, py and z; mask: keys, px and py of the pixels that count, all without one. status: ok, depth_span_high (no depth
    then), no_masked_depth with fewer than `least` usable pixels, and no_point without a place. Points ask for their pixels by key.
    """
    at = lambda c: F.bround(finite(F.col(c)), 0).cast("long")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    asked = points.select(*keys, point, at(u).alias("_x"), at(v).alias("_y"), F.explode(steps).alias("_s")).select(
        *keys, point, (F.col("_x") + F.col("_s.i")).alias("px"), (F.col("_y") + F.col("_s.j")).alias("py"))
    usable = depths.filter(finite(F.col("z")) > least_depth).select(*keys, "px", "py", "z")
    if mask is not None:
        usable = usable.join(mask.select(*keys, "px", "py").distinct(), [*keys, "px", "py"], "left_semi")
    got = asked.join(usable, [*keys, "px", "py"]).groupBy(*keys, point).agg(
        F.count("*").alias("count"), F.percentile("z", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_p"), F.stddev_pop("z").alias("std"))
    got = got.withColumn("span", F.get("_p", 2) - F.get("_p", 0)).withColumn("_median", F.get("_p", 1)).drop("_p")
    both = points.join(got, [*keys, point], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    status = F.when(at(u).isNull() | at(v).isNull(), "no_point").when(F.col("count") < least, "no_masked_depth").when(F.col("span") > most_span, "depth_span_high").otherwise("ok")
    return both.withColumn("status", status).withColumn("depth", F.when(F.col("status") == "ok", F.col("_median"))).drop("_median")
