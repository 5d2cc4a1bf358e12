"""Meshes seen by a camera: the nearest depth at each pixel, which vertices and joints are visible, and nearest points.

Everything is rows: triangles become the pixels that they cover; pixels, and cells of space, are join keys. So neither a
frame nor a mesh has to be one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite

#: A pixel counts as inside a triangle down to this weight of a corner (fixed value).
INSIDE = -1e-4


def triangles(vertices: Column, faces: Column) -> Column:
    """For each face (places a, b, c in vertices) its corners, structs of u, v and z; NULL where there is no such place."""
    return F.transform(faces, lambda f: F.struct(*[F.get(vertices, f[n]).alias(n) for n in "abc"]))


def covered_pixels(df: DataFrame, keys: list[str], vertices: str, faces: Column, clip: str, least_z: float = 1e-8) -> DataFrame:
    """keys, px, py and z for every pixel of every triangle, z interpolated between the corners.

    vertices: array of u, v, z; clip: struct of x1, y1, x2, y2, whole pixels that count, both ends included. Triangles with a
    corner that isn't finite or not in front, and those without area, cover nothing; so do rows with a NULL.
    """
    t = df.filter(F.col(clip).isNotNull()).select(*keys, F.col(clip).alias("_clip"), F.explode(triangles(F.col(vertices), faces)).alias("_t"))
    good = F.lit(True)
    for n in "abc":
        good &= finite(F.col(f"_t.{n}.u")).isNotNull() & finite(F.col(f"_t.{n}.v")).isNotNull() & (finite(F.col(f"_t.{n}.z")) > least_z)
    flat = t.filter(good).select(*keys, "_clip", *[F.col(f"_t.{n}.{c}").alias(f"_{c}{i}") for i, n in enumerate("abc") for c in "uvz"])
    span = lambda c, lo, hi: F.when(
        F.least(F.col(hi), F.ceil(F.greatest(*[f"_{c}{i}" for i in range(3)]))) >= F.greatest(F.col(lo), F.floor(F.least(*[f"_{c}{i}" for i in range(3)]))),
        F.sequence(F.greatest(F.col(lo), F.floor(F.least(*[f"_{c}{i}" for i in range(3)]))), F.least(F.col(hi), F.ceil(F.greatest(*[f"_{c}{i}" for i in range(3)])))))
    den = (F.col("_v1") - F.col("_v2")) * (F.col("_u0") - F.col("_u2")) + (F.col("_u2") - F.col("_u1")) * (F.col("_v0") - F.col("_v2"))
    rows = flat.withColumn("_den", den).filter(F.abs("_den") >= 1e-8).withColumn("py", F.explode(span("v", "_clip.y1", "_clip.y2"))).withColumn(
        "px", F.explode(span("u", "_clip.x1", "_clip.x2")))
    dx, dy = F.col("px") - F.col("_u2"), F.col("py") - F.col("_v2")
    w0 = ((F.col("_v1") - F.col("_v2")) * dx + (F.col("_u2") - F.col("_u1")) * dy) / F.col("_den")
    w1 = ((F.col("_v2") - F.col("_v0")) * dx + (F.col("_u0") - F.col("_u2")) * dy) / F.col("_den")
    rows = rows.withColumn("_w0", w0).withColumn("_w1", w1).withColumn("_w2", 1.0 - F.col("_w0") - F.col("_w1"))
    inside = (F.col("_w0") >= INSIDE) & (F.col("_w1") >= INSIDE) & (F.col("_w2") >= INSIDE)
    z = F.col("_w0") * F.col("_z0") + F.col("_w1") * F.col("_z1") + F.col("_w2") * F.col("_z2")
    return rows.filter(inside).select(*keys, "px", "py", z.alias("z"))


def surface(df: DataFrame, keys: list[str], vertices: str, faces: Column, clip: str) -> DataFrame:
    """keys, px, py and z: the nearest depth at each pixel that a triangle covers (see covered_pixels)."""
    return covered_pixels(df, keys, vertices, faces, clip).groupBy(*keys, "px", "py").agg(F.min("z").alias("z"))


def nearest_surface(points: DataFrame, surface: DataFrame, keys: list[str], point: str, u: str, v: str, radius: int) -> DataFrame:
    """points with surface_z: the least depth of the pixels at most `radius` away, in either direction, from the point's own (its
    place, rounded half to even); NULL where no pixel is covered and for points without a place.

    Each point asks for its (2 * radius + 1) ** 2 pixels by key; keys and point name a row of points.
    """
    at = lambda c: F.bround(finite(F.col(c)), 0).cast("long")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    asked = points.select(*keys, point, at(u).alias("_x"), at(v).alias("_y"), F.explode(steps).alias("_s")).select(
        *keys, point, (F.col("_x") + F.col("_s.i")).alias("px"), (F.col("_y") + F.col("_s.j")).alias("py"))
    found = asked.join(surface, [*keys, "px", "py"]).groupBy(*keys, point).agg(F.min("z").alias("surface_z"))
    return points.join(found, [*keys, point], "left")


def visible_points(points: DataFrame, surface: DataFrame, keys: list[str], point: str, u: str, v: str, z: str, radius: int = 2, epsilon: float = 0.010) -> DataFrame:
    """points with surface_z, margin (depth behind the surface) and visible: 1 if the margin is at most epsilon.

    Points with no surface near, or without depth, have no margin and aren't visible.
    """
    got = nearest_surface(points, surface, keys, point, u, v, radius).withColumn("margin", finite(F.col(z)) - F.col("surface_z"))
    return got.withColumn("visible", F.coalesce((F.col("margin") <= epsilon).cast("int"), F.lit(0)))


def nearest_points(queries: DataFrame, points: DataFrame, key: str, query: str, point: str, place: list[str], k: int = 18) -> DataFrame:
    """key, query, point, distance and rank (from 1) of the k points of a query's key that are nearest to it, exactly.

    Of equal distances the lesser point comes first; keys with fewer points give fewer rows. Rows whose place isn't finite take no part.

    A key's box is cut into halves, quarters ... of each side, down to cells of about k points. A query takes the finest
    cell around it (or around the box's nearest place) that holds k points; all nearest ones are within the distance of the
    k-th best of that cell, in the few cells of that size which the distance reaches. Cells are join keys, so a key
    with many points is many tasks' work. Points beyond that distance go in the join, and are neither sorted nor exchanged.
    """
    good = lambda df: df.filter(sum((finite(F.col(c)).isNotNull().cast("int") for c in place[1:]), finite(F.col(place[0])).isNotNull().cast("int")) == len(place))
    d = range(len(place))
    queries = good(queries).select(key, query, *[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(place)])
    points = good(points).select(key, point, *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(place)])
    side = F.greatest(*[F.max(f"_p{i}") - F.min(f"_p{i}") for i in d], F.lit(1e-9)) * (1 + 1e-9)
    deepest = F.greatest(F.lit(0), F.least(F.lit(20), F.ceil(F.log2(F.count("*") / k) / len(place)))).cast("int")
    box = points.groupBy(key).agg(*[F.min(f"_p{i}").alias(f"_m{i}") for i in d], side.alias("_side"), deepest.alias("_deep"))
    level = F.explode(F.sequence(F.lit(0), F.col("_deep"))).alias("_level")

    def cells(df: DataFrame, of: str) -> DataFrame:
        """The cell at every level, of the place clipped to the box."""
        for i in d:
            cell = F.floor((F.col(f"_{of}{i}") - F.col(f"_m{i}")) / F.col("_side") * F.pow(F.lit(2.0), "_level"))
            df = df.withColumn(f"_c{i}", F.greatest(F.lit(0), F.least(F.pow(F.lit(2.0), "_level") - 1, cell)).cast("long"))
        return df

    cell = [key, "_level", *[f"_c{i}" for i in d]]
    laid = cells(points.join(box, key).select("*", level), "p").select(*cell, point, *[f"_p{i}" for i in d])
    held = laid.groupBy(*cell).agg(F.count("*").alias("_n"))
    asked = cells(queries.join(box, key).select("*", level), "q").join(held, cell, "left")
    enough = (F.col("_n") >= k) | (F.col("_level") == 0)
    chosen = asked.filter(enough).groupBy(key, query).agg(F.max_by(F.struct(
        "_level", "_n", "_side", *[f"_{x}{i}" for x in "cqm" for i in d]), "_level").alias("_b")).select(key, query, "_b.*")
    square = sum(((F.col(f"_q{i}") - F.col(f"_p{i}")) * (F.col(f"_q{i}") - F.col(f"_p{i}")) for i in d[1:]), (F.col("_q0") - F.col("_p0")) * (F.col("_q0") - F.col("_p0")))
    place_in_cell = F.row_number().over(Window.partitionBy(key, query).orderBy("_far"))
    reach = chosen.join(laid.drop(point), cell).withColumn("_far", F.sqrt(square)).drop(*[f"_p{i}" for i in d]).withColumn("_r", place_in_cell).filter(
        (F.col("_r") <= k) & (F.col("_r") == F.least(F.lit(k), "_n"))).drop("_r", "_n", *[f"_c{i}" for i in d])
    for i in d:
        step = F.col("_side") / F.pow(F.lit(2.0), "_level")
        edge = F.pow(F.lit(2.0), "_level") - 1
        far = F.col("_far") * (1 + 1e-9) + step * 1e-9 + (F.abs(f"_q{i}") + F.abs(f"_m{i}")) * 1e-14  # above what rounding takes
        bound = lambda s: F.greatest(F.lit(0.0), F.least(edge, F.floor((F.col(f"_q{i}") + s * far - F.col(f"_m{i}")) / step))).cast("long")  # noqa: E731, B023
        reach = reach.withColumn(f"_c{i}", F.explode(F.sequence(bound(-1), bound(1))))
    got = reach.join(laid, cell).filter(F.sqrt(square) <= F.col("_far")).select(key, query, point, F.sqrt(square).alias("distance"))
    rank = F.row_number().over(Window.partitionBy(key, query).orderBy("distance", point))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k)


def visible_joints(near: DataFrame, vertices: DataFrame, keys: list[str], joint: str, vertex: str, least_ratio: float = 0.25) -> DataFrame:
    """keys, joint, tested, ratio, margin (median) and visible of each joint, from its nearest vertices (keys, joint, vertex) and
    visible_points() of them. Only vertices with a margin are tested; without any, ratio and margin are NULL."""
    both = near.select(*keys, joint, vertex).join(vertices.select(*keys, vertex, "margin", "visible"), [*keys, vertex], "left")
    got = both.groupBy(*keys, joint).agg(F.count("margin").alias("tested"), F.avg(F.when(F.col("margin").isNotNull(), F.col("visible"))).alias("ratio"),
                                         F.percentile("margin", 0.5).alias("margin"))
    return got.withColumn("visible", F.coalesce((F.col("ratio") >= least_ratio).cast("int"), F.lit(0)))
