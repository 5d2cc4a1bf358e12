"""Column functions: parsing, flags, boxes, and small-vector and rotation geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities as NULL, so that aggregates leave them out and comparisons are false."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def parse_float(c: Column, default: float | None = None) -> Column:
    return F.coalesce(finite(c.try_cast("double")), F.lit(default).cast("double"))


def parse_int(c: Column, default: int | None = None) -> Column:
    """Rounded half to even."""
    return F.coalesce(F.rint(finite(c.try_cast("double"))).cast("int"), F.lit(default).cast("int"))


def truthy(c: Column, words: tuple[str, ...] = ("1", "true", "yes", "y", "valid", "ok")) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*words), F.lit(False))


def csv_float(c: Column) -> Column:
    return F.when(finite(c).isNotNull(), F.format_string("%.9f", finite(c))).otherwise("")


def int_list(c: Column) -> Column:
    """The integers of "3,x,5"; items that aren't integers are dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def float_list(c: Column) -> Column:
    """The finite numbers of "1.5,x,2"; other items are dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: finite(F.trim(x).try_cast("double"))), lambda x: x.isNotNull())


def frame_list(c: Column) -> Column:
    """"3,7-9;12" as sorted distinct integers. Empty and bad items and spans that run backwards give
    nothing; NULL gives an empty list."""
    def span(x: Column) -> Column:
        lo, hi = F.get(F.split(x, "-"), 0).try_cast("int"), F.get(F.split(x, "-"), 1).try_cast("int")
        whole = F.when(F.size(F.split(x, "-")) == 1, lo).otherwise(hi)
        return F.when(lo <= whole, F.sequence(lo, whole)).otherwise(F.array().cast("array<int>"))
    items = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: span(F.trim(x)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(x, F.array().cast("array<int>"))))))


def clean_label(c: Column) -> Column:
    return F.lower(F.trim(c))


def token_list(c: Column, both: tuple[str, ...] = ("right", "left")) -> Column:
    """Distinct tokens of "left,both" in order, where "both" stands for all of both; empties are dropped."""
    tokens = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,\\s]+"), clean_label), lambda x: x != "")
    widened = F.transform(tokens, lambda x: F.when(x == "both", F.array(*map(F.lit, both))).otherwise(F.array(x)))
    return F.array_distinct(F.flatten(widened))


def lane_map(c: Column, lanes: tuple[str, ...] = ("right", "left")) -> Column:
    """"right:left,left:right" as a map; NULL if an item isn't lane:lane or a lane is named twice."""
    items = F.transform(F.split(c, ","), lambda x: F.split(F.trim(x), ":"))
    good = F.forall(items, lambda x: (F.size(x) == 2) & F.get(x, 0).isin(*lanes) & F.get(x, 1).isin(*lanes))
    keys = F.transform(items, lambda x: F.get(x, 0))
    once = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(good & once, F.map_from_arrays(keys, F.transform(items, lambda x: F.get(x, 1))))


def append_flag(flags: Column, flag: Column) -> Column:
    """flags without "ok", and flag at the end unless it is there or NULL."""
    return F.array_compact(F.array_union(F.array_remove(flags, "ok"), F.array(flag)))


def join_flags(*flags: Column) -> Column:
    """Flags that aren't NULL joined by "|"; none: "ok"."""
    return F.coalesce(F.nullif(F.concat_ws("|", *flags), F.lit("")), F.lit("ok"))


def level_flag(value: Column, warn: float, bad: float, name: str) -> Column:
    """bad_name above bad, else warn_name above warn, else NULL; NULL and NaN fire neither."""
    v = finite(value)
    return F.when(v > bad, f"bad_{name}").when(v > warn, f"warn_{name}")


def has_flag(flags: Column, level: str) -> Column:
    """Whether a joined flag text has a flag of this level ("bad" or "warn")."""
    return F.coalesce(F.contains(flags, F.lit(f"{level}_")), F.lit(False))


def first_of(tags: Column, order: tuple[str, ...], default: str) -> Column:
    """The first of order that is among the tags."""
    out = F.lit(default)
    for t in reversed(order):
        out = F.when(F.array_contains(tags, t), F.lit(t)).otherwise(out)
    return out


def solve_kind(success: Column, fallback: Column, mode: Column) -> Column:
    """failed, fallback, normal or, where a success has no mode, success_unknown."""
    named = F.coalesce(clean_label(mode), F.lit("")) != ""
    return F.when(~F.coalesce(success, F.lit(False)), "failed").when(F.coalesce(fallback, F.lit(False)), "fallback").when(named, "normal").otherwise("success_unknown")


def by_mode(mode: Column, choices: dict[str, Column], default: Column) -> Column:
    """The column that the row's mode names."""
    out = default
    for name, c in choices.items():
        out = F.when(mode == name, c).otherwise(out)
    return out


def replaced(value: Column, bad: Column, by: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), by).otherwise(value)


def safe_ratio(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return F.when(F.abs(finite(b)) > eps, finite(a) / finite(b))


def clip(x: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is 1e-9 or less."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = box_area(a) + box_area(b) - w * h
    return F.when(union > 1e-9, w * h / union).otherwise(0.0)


def box_center(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def touches_edge(b: Column, width: float, height: float, margin: float = 0.0) -> Column:
    return (b["x1"] <= margin) | (b["y1"] <= margin) | (b["x2"] >= width - 1 - margin) | (b["y2"] >= height - 1 - margin)


def padded_box(b: Column, pad: float, width: int, height: int) -> Column:
    """x, y, w, h in whole pixels, padded, rounded outwards and cut to the image."""
    x1, y1 = F.greatest(F.lit(0), F.floor(b["x1"] - pad)), F.greatest(F.lit(0), F.floor(b["y1"] - pad))
    x2, y2 = F.least(F.lit(width), F.ceil(b["x2"] + pad)), F.least(F.lit(height), F.ceil(b["y2"] + pad))
    return F.struct(x1.alias("x"), y1.alias("y"), F.greatest(F.lit(0), x2 - x1).alias("w"), F.greatest(F.lit(0), y2 - y1).alias("h"))


def inside_ratio(points: Column, width: float, height: float, margin: float = 0.0) -> Column:
    """Share of points (u, v) in the image with a margin around; points that aren't finite count as outside;
    none: 0."""
    inside = F.filter(points, lambda p: F.coalesce(
        (finite(p["u"]) >= -margin) & (finite(p["u"]) < width + margin) & (finite(p["v"]) >= -margin) & (finite(p["v"]) < height + margin), F.lit(False)))
    return F.when(F.size(points) > 0, F.size(inside) / F.size(points)).otherwise(0.0)


def extent(points: Column) -> Column:
    """The larger side of the box around the finite points; NULL without any."""
    good = F.filter(points, lambda p: finite(p["u"]).isNotNull() & finite(p["v"]).isNotNull())
    side = lambda f: F.array_max(F.transform(good, lambda p: p[f])) - F.array_min(F.transform(good, lambda p: p[f]))
    return F.greatest(side("u"), side("v"))


def finite_ratio(values: Column) -> Column:
    """Share of finite values of an array; an empty one has 0."""
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda x: finite(x).isNotNull())) / F.size(values)).otherwise(0.0)


def visible_ratio(b: Column, width: float, height: float) -> Column:
    """Share of a box that lies in the image."""
    w = F.greatest(F.lit(0.0), F.least(b["x2"], F.lit(width)) - F.greatest(b["x1"], F.lit(0.0)))
    h = F.greatest(F.lit(0.0), F.least(b["y2"], F.lit(height)) - F.greatest(b["y1"], F.lit(0.0)))
    return F.when(box_area(b) > 1e-9, w * h / box_area(b)).otherwise(0.0)


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def angle_deg(a: list[Column], b: list[Column]) -> Column:
    """Angle between vectors; the cosine is clipped to [-1, 1]. NULL for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-12, F.degrees(F.acos(clip(dot(a, b) / n, 1.0))))


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, eps: float = 1e-8) -> tuple[Column, Column]:
    """Pinhole projection; NULL where z is eps or less."""
    return F.when(z > eps, fx * x / z + cx), F.when(z > eps, fy * y / z + cy)


def backproject(u: Column, v: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    return (u - cx) * z / fx, (v - cy) * z / fy


def rigid(m: list[list[float]], p: list[Column]) -> list[Column]:
    """The first three rows of a 4 x 4 transform applied to a point."""
    return [r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + r[3] for r in m[:3]]


def rotation_delta_deg(a: list[Column], b: list[Column]) -> Column:
    """Geodesic angle between two rotations given by nine entries each, by the trace."""
    return F.degrees(F.acos(clip((dot(a, b) - 1) / 2, 1.0)))


def slerp(q0: list[Column], q1: list[Column], t: Column) -> list[Column]:
    """Spherical interpolation of unit quaternions on the shorter arc; linear when they nearly agree."""
    d0 = dot(q0, q1)
    sign = F.when(d0 < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(d0), F.lit(1.0))
    theta = F.acos(d)
    near = d > 0.9995
    a = F.when(near, 1 - t).otherwise(F.sin((1 - t) * theta) / F.sin(theta))
    b = F.when(near, t).otherwise(F.sin(t * theta) / F.sin(theta)) * sign
    mixed = [a * x + b * y for x, y in zip(q0, q1, strict=True)]
    n = norm(mixed)
    return [x / n for x in mixed]


def rpy_to_rotation(r: Column, p: Column, y: Column) -> list[Column]:
    """Nine entries, row by row, of Rz(y) Ry(p) Rx(r)."""
    cr, sr, cp, sp, cy, sy = F.cos(r), F.sin(r), F.cos(p), F.sin(p), F.cos(y), F.sin(y)
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
            sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr]
