"""Rotations and small-vector geometry as column expressions. Matrices are nine columns, row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.functions.scalars import clip, cross, dot, norm

Matrix = list[Column]
Vector = list[Column]


def entries(matrix: Column) -> Matrix:
    """Nine columns of an array column."""
    return [F.get(matrix, i) for i in range(9)]


def apply(m: Matrix, v: Vector) -> Vector:
    return [dot(m[3 * i : 3 * i + 3], v) for i in range(3)]


def transposed(m: Matrix) -> Matrix:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def unit(v: Vector, eps: float = 1e-9) -> Vector:
    """v over its length; NULL where that is eps or less."""
    n = norm(v)
    return [F.when(n > eps, x / n) for x in v]


def palm_normal(wrist: Vector, index: Vector, little: Vector) -> Vector:
    """Unit normal of the plane through wrist, index and little knuckle; NULL where they are in line."""
    return unit(cross([a - b for a, b in zip(index, wrist, strict=True)], [a - b for a, b in zip(little, wrist, strict=True)]))


def mirrored(v: Vector) -> Vector:
    """x turned round, for the other hand."""
    return [-v[0], *v[1:]]


def shifted(v: Vector, by: Vector) -> Vector:
    return [a + b for a, b in zip(v, by, strict=True)]


def refocused(z: Column, old: Column, new: Column) -> Column:
    """Depth after a change of focal length; x and y stay."""
    return z * new / old


def project_full(v: Vector, by: Vector, focal: float, width: float, height: float) -> tuple[Column, Column]:
    """Weak-perspective projection into the whole image, after a translation; NULL at depth 0."""
    x, y, z = shifted(v, by)
    return F.when(z != 0, focal * x / z + width / 2), F.when(z != 0, focal * y / z + height / 2)


def end_effector(tcp: Vector, m: Matrix, offset: Vector) -> Vector:
    """Where the flange must be for the tool to be at tcp: tcp - R offset."""
    return [a - b for a, b in zip(tcp, apply(m, offset), strict=True)]


def into_frame(p: Vector, m: Matrix, origin: Vector) -> Vector:
    """A point in the frame of (m, origin): Rt (p - origin)."""
    return apply(transposed(m), [a - b for a, b in zip(p, origin, strict=True)])


def out_of_frame(p: Vector, m: Matrix, origin: Vector) -> Vector:
    return shifted(apply(m, p), origin)


def axis_angle_to_matrix(v: Vector) -> Matrix:
    """Rodrigues. Angles under 1e-8 give the identity."""
    angle = norm(v)
    small = angle < 1e-8
    x, y, z = [F.when(small, 0.0).otherwise(c / angle) for c in v]
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    m = [t * x * x + c, t * x * y - s * z, t * x * z + s * y, t * x * y + s * z, t * y * y + c, t * y * z - s * x,
         t * x * z - s * y, t * y * z + s * x, t * z * z + c]
    return [F.when(small, 1.0 if i % 4 == 0 else 0.0).otherwise(e) for i, e in enumerate(m)]


def matrix_to_quaternion(m: Matrix) -> list[Column]:
    """w, x, y, z with w >= 0, from the largest of the four squares."""
    r00, r01, r02, r10, r11, r12, r20, r21, r22 = m
    squares = [1 + r00 + r11 + r22, 1 + r00 - r11 - r22, 1 - r00 + r11 - r22, 1 - r00 - r11 + r22]
    most = F.greatest(*squares)
    r = F.sqrt(most) * 2
    cases = [
        [r / 4, (r21 - r12) / r, (r02 - r20) / r, (r10 - r01) / r],
        [(r21 - r12) / r, r / 4, (r01 + r10) / r, (r02 + r20) / r],
        [(r02 - r20) / r, (r01 + r10) / r, r / 4, (r12 + r21) / r],
        [(r10 - r01) / r, (r02 + r20) / r, (r12 + r21) / r, r / 4],
    ]
    q = []
    for i in range(4):
        out = cases[3][i]
        for k in (2, 1, 0):
            out = F.when(squares[k] == most, cases[k][i]).otherwise(out)
        q.append(out)
    return upright(q)


def upright(q: list[Column]) -> list[Column]:
    """The one of q and -q with w >= 0."""
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return [sign * x for x in q]


def quaternion_to_matrix(q: list[Column]) -> Matrix:
    w, x, y, z = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def quaternion_to_axis_angle(q: list[Column]) -> Vector:
    """By the arc tangent, which is exact for small angles; no rotation gives zeros."""
    w, *v = upright(q)
    n = norm(v)
    scale = F.when(n > 1e-12, 2 * F.atan2(n, w) / n).otherwise(2.0)
    return [scale * x for x in v]


def axis_angle_to_quaternion(v: Vector) -> list[Column]:
    angle = norm(v)
    scale = F.when(angle > 1e-12, F.sin(angle / 2) / angle).otherwise(0.5)
    return upright([F.cos(angle / 2), *[scale * x for x in v]])


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by,
            aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]


def conjugate(q: list[Column]) -> list[Column]:
    return [q[0], *[-x for x in q[1:]]]


def swing_twist(q: list[Column], axis: Vector) -> tuple[list[Column], list[Column]]:
    """swing and twist about a unit axis, q = swing * twist. No twist where q turns by 180 degrees across it."""
    along = dot(q[1:], axis)
    n = F.sqrt(q[0] * q[0] + along * along)
    still = n < 1e-9
    twist = [F.when(still, 1.0).otherwise(q[0] / n), *[F.when(still, 0.0).otherwise(along * a / n) for a in axis]]
    return quaternion_product(q, conjugate(twist)), twist


def clamped_twist(q: list[Column], axis: Vector, low: float, high: float) -> list[Column]:
    """q with its twist about axis held within [low, high] radians. Write swings and twists to columns before
    they go into further products: expressions are copied into each use."""
    swing, twist = swing_twist(q, axis)
    angle = 2 * F.atan2(dot(twist[1:], axis), twist[0])
    turned = F.when(angle > np.pi, angle - 2 * np.pi).when(angle < -np.pi, angle + 2 * np.pi).otherwise(angle)
    held = F.greatest(F.lit(low), F.least(F.lit(high), turned))
    return quaternion_product(swing, [F.cos(held / 2), *[F.sin(held / 2) * a for a in axis]])


def matrix_to_rot6d(m: Matrix, by_columns: bool = True) -> list[Column]:
    """The first two columns, one after another; or row by row, as a 3 x 2 matrix."""
    a, b = [m[0], m[3], m[6]], [m[1], m[4], m[7]]
    return [*a, *b] if by_columns else [x for pair in zip(a, b, strict=True) for x in pair]


def rot6d_to_matrix(v: list[Column], by_columns: bool = True) -> Matrix:
    """Gram-Schmidt: the first axis, the second without its part along the first, and their product."""
    a, b = (v[:3], v[3:]) if by_columns else (v[::2], v[1::2])
    x = unit(a)
    along = dot(x, b)
    y = unit([p - along * q for p, q in zip(b, x, strict=True)])
    z = cross(x, y)
    return [e for row in zip(x, y, z, strict=True) for e in row]


def rotation_to_rpy(m: Matrix) -> Vector:
    """Roll, pitch and yaw of Rz(y) Ry(p) Rx(r)."""
    return [F.atan2(m[7], m[8]), F.asin(clip(-m[6], 1.0)), F.atan2(m[3], m[0])]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def nearest_rotation(m: pd.Series) -> pd.Series:
    """The rotation nearest to a 3 x 3 matrix (nine numbers), by the singular value decomposition of a whole batch."""
    good = m.notna()
    a = np.stack([np.asarray(x, float).reshape(3, 3) for x in m[good]]) if good.any() else np.zeros((0, 3, 3))
    u, _, vt = np.linalg.svd(a)
    u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
    found = iter((u @ vt).reshape(-1, 9))
    return pd.Series([next(found) if g else None for g in good], index=m.index, dtype=object)


def uv_errors(points: Column, reference: Column, subset: tuple[int, ...] = ()) -> Column:
    """count, rms, mean, max of the distances between points (u, v) in the same place of two arrays, and rms_subset
    over some places. Pairs that aren't finite are left out."""
    def distances(pairs: Column) -> Column:
        gap = F.transform(pairs, lambda p: F.sqrt(F.pow(p["a"]["u"] - p["b"]["u"], 2) + F.pow(p["a"]["v"] - p["b"]["v"], 2)))
        return F.filter(gap, lambda d: d.isNotNull() & ~F.isnan(d))

    def total(d: Column, f) -> Column:
        return F.aggregate(d, F.lit(0.0), lambda x, y: x + f(y))

    pairs = F.arrays_zip(points.alias("a"), reference.alias("b"))
    pairs = F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    d = distances(pairs)
    part = distances(F.filter(pairs, lambda p, i: i.isin(*subset))) if subset else d
    rms = lambda x: F.when(F.size(x) > 0, F.sqrt(total(x, lambda y: y * y) / F.size(x)))
    return F.struct(F.size(d).alias("count"), rms(d).alias("rms"), F.when(F.size(d) > 0, total(d, lambda y: y) / F.size(d)).alias("mean"),
                    F.array_max(d).alias("max"), rms(part).alias("rms_subset"))
