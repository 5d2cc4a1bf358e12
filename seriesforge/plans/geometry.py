"""Queries of the rotation and projection functions, over the first numbers of the embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions import rotations as R
from seriesforge.functions import scalars as S
from seriesforge.plans.registry import query
from seriesforge.session import load


def vectors(spark: SparkSession, sf_dir: str, n: int = 9) -> DataFrame:
    """vec_id and v0 .. v(n-1), embedding entries as doubles."""
    return load(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", i).cast("double").alias(f"v{i}") for i in range(n)])


V = "v AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS v{i}" for i in range(9)) + " FROM embeddings)"


def _axis() -> list[Column]:
    return [F.col(f"v{i}") * 3 for i in range(3)]


def _rounded(**columns) -> list:
    # + 0.0 makes a rounded -0.0 plain
    return [(F.round(c, 4) + 0.0).alias(n) for n, c in columns.items()]


@query(f"""WITH {V} SELECT vec_id, round(3 * v0, 4) AS x, round(3 * v1, 4) AS y, round(3 * v2, 4) AS z, round(3 * v0, 4) AS qx, round(3 * v1, 4) AS qy, round(3 * v2, 4) AS qz,
  round(degrees(3 * sqrt(v0 * v0 + v1 * v1 + v2 * v2)), 2) AS angle FROM v WHERE 3 * sqrt(v0 * v0 + v1 * v1 + v2 * v2) < 3""")
def rotation_round_trips(spark, sf_dir):
    """Axis-angle to matrix to quaternion and back is what it was; so is the way by the quaternion alone."""
    m = R.axis_angle_to_matrix(_axis())
    v = vectors(spark, sf_dir, 3).filter(S.norm(_axis()) < 3).select("vec_id", "v0", "v1", "v2", *[e.alias(f"m{i}") for i, e in enumerate(m)])
    got = v.select("vec_id", "v0", "v1", "v2", *[F.col(f"m{i}") for i in range(9)], *[q.alias(f"q{i}") for i, q in enumerate(R.matrix_to_quaternion([F.col(f"m{i}") for i in range(9)]))])
    a = R.quaternion_to_axis_angle([F.col(f"q{i}") for i in range(4)])
    b = R.quaternion_to_axis_angle(R.axis_angle_to_quaternion(_axis()))
    same = [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]
    angle = S.rotation_delta_deg([F.col(f"m{i}") for i in range(9)], same)
    return got.select("vec_id", *_rounded(x=a[0], y=a[1], z=a[2], qx=b[0], qy=b[1], qz=b[2]), (F.round(angle, 2) + 0.0).alias("angle"))


@query(f"""WITH {V}, n AS (SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS a, v0 * v3 + v1 * v4 + v2 * v5 AS d FROM v),
u AS (SELECT vec_id, v0 / a AS x0, v1 / a AS x1, v2 / a AS x2, v3 - d / (a * a) * v0 AS w0, v4 - d / (a * a) * v1 AS w1, v5 - d / (a * a) * v2 AS w2 FROM n),
y AS (SELECT *, w0 / sqrt(w0 * w0 + w1 * w1 + w2 * w2) AS y0, w1 / sqrt(w0 * w0 + w1 * w1 + w2 * w2) AS y1, w2 / sqrt(w0 * w0 + w1 * w1 + w2 * w2) AS y2 FROM u)
SELECT vec_id, round(x0, 4) AS m00, round(y0, 4) AS m01, round(x1 * y2 - x2 * y1, 4) AS m02, round(x2, 4) AS back2, round(y2, 4) AS back5, round(y1, 4) AS rows3 FROM y""")
def rot6d_decode(spark, sf_dir):
    m = R.rot6d_to_matrix([F.col(f"v{i}") for i in range(6)])
    got = vectors(spark, sf_dir, 6).select("vec_id", *[e.alias(f"m{i}") for i, e in enumerate(m)])
    m = [F.col(f"m{i}") for i in range(9)]
    back, rows = R.matrix_to_rot6d(m), R.matrix_to_rot6d(m, by_columns=False)
    return got.select("vec_id", *_rounded(m00=m[0], m01=m[1], m02=m[2], back2=back[2], back5=back[5], rows3=rows[3]))


@query(f"""WITH {V}, q AS (SELECT *, sqrt(1 + v0 * v0 + v1 * v1 + v2 * v2) AS n FROM v), t AS (SELECT *, 2 * atan2(v2, 1) AS turn FROM q)
SELECT vec_id, round(1 / n, 4) AS w, round(v0 / n, 4) AS x, round(v1 / n, 4) AS y, round(v2 / n, 4) AS z, round(turn, 4) AS twist, 0.0 AS swing_z,
  round(greatest(-0.1, least(0.1, turn)), 4) AS held FROM t""")
def swing_twist_parts(spark, sf_dir):
    """A quaternion is its swing times its twist; the twist about z; and the twist once it is held within 0.1."""
    n = F.sqrt(1 + F.col("v0") * F.col("v0") + F.col("v1") * F.col("v1") + F.col("v2") * F.col("v2"))
    got = vectors(spark, sf_dir, 3).select("vec_id", (1 / n).alias("w"), *[(F.col(f"v{i}") / n).alias(c) for i, c in enumerate("xyz")])
    q, axis = [F.col(c) for c in "wxyz"], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    swing, twist = R.swing_twist(q, axis)
    whole = R.quaternion_product(swing, twist)
    _, held = R.swing_twist(R.clamped_twist(q, axis, -0.1, 0.1), axis)
    return got.select("vec_id", *_rounded(w=whole[0], x=whole[1], y=whole[2], z=whole[3], twist=2 * F.atan2(twist[3], twist[0]), swing_z=swing[3], held=2 * F.atan2(held[3], held[0])))


@query(f"""WITH {V}, c AS (SELECT *, (v4 - v1) * (v8 - v2) - (v5 - v2) * (v7 - v1) AS a, (v5 - v2) * (v6 - v0) - (v3 - v0) * (v8 - v2) AS b, (v3 - v0) * (v7 - v1) - (v4 - v1) * (v6 - v0) AS c FROM v)
SELECT vec_id, round(a / sqrt(a * a + b * b + c * c), 4) AS nx, round(b / sqrt(a * a + b * b + c * c), 4) AS ny, round(c / sqrt(a * a + b * b + c * c), 4) AS nz,
  round(-v0, 4) AS mirrored, round(v0 + v3, 4) AS shifted, round((abs(v2) + 1) * 600 / 500, 4) AS refocused, round(800 * (v0 + v3) / (v2 + v5 + 5) + 320, 4) AS u, round(800 * (v1 + v4) / (v2 + v5 + 5) + 240, 4) AS v FROM c""")
def palm_and_projection(spark, sf_dir):
    a, b, c = ([F.col(f"v{i}") for i in range(3 * k, 3 * k + 3)] for k in range(3))
    n = R.palm_normal(a, b, c)
    u, v = R.project_full(a, [b[0], b[1], b[2] + 5], 800.0, 640.0, 480.0)
    return vectors(spark, sf_dir).select("vec_id", *_rounded(nx=n[0], ny=n[1], nz=n[2], mirrored=R.mirrored(a)[0], shifted=R.shifted(a, b)[0],
                                                             refocused=R.refocused(F.abs(a[2]) + 1, F.lit(500.0), F.lit(600.0)), u=u, v=v))


@query(f"""WITH {V} SELECT vec_id, round(v0, 4) AS roll, round(v1, 4) AS pitch, round(v2, 4) AS yaw, round(v3, 4) AS x, round(v4, 4) AS y, round(v5, 4) AS z, round(v3, 4) AS ex FROM v WHERE abs(v1) < 1.5""")
def frames_round_trip(spark, sf_dir):
    """Roll, pitch and yaw come back from their matrix; a point comes back from a frame; so does a tool point from its flange."""
    m = S.rpy_to_rotation(F.col("v0"), F.col("v1"), F.col("v2"))
    got = vectors(spark, sf_dir).filter(F.abs("v1") < 1.5).select("vec_id", *[f"v{i}" for i in range(3, 9)], *[e.alias(f"m{i}") for i, e in enumerate(m)])
    m = [F.col(f"m{i}") for i in range(9)]
    r, p, y = R.rotation_to_rpy(m)
    point, origin = [F.col(f"v{i}") for i in (3, 4, 5)], [F.col(f"v{i}") for i in (6, 7, 8)]
    back = R.out_of_frame(R.into_frame(point, m, origin), m, origin)
    flange = R.shifted(R.end_effector(point, m, origin), R.apply(m, origin))
    return got.select("vec_id", *_rounded(roll=r, pitch=p, yaw=y, x=back[0], y=back[1], z=back[2], ex=flange[0]))


@query(f"""WITH {V}, a AS (SELECT vec_id, 3 * v0 AS x, 3 * v1 AS y, 3 * v2 AS z, 3 * sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS t FROM v)
SELECT vec_id, round(cos(t) + (1 - cos(t)) * x * x / (t * t), 4) AS m0, round((1 - cos(t)) * x * y / (t * t) - sin(t) * z / t, 4) AS m1, 1.0 AS det FROM a WHERE t > 0.01""")
def nearest_rotation(spark, sf_dir):
    """A rotation scaled by a positive factor is nearest to itself unscaled."""
    m = [e * 1.7 for e in R.axis_angle_to_matrix(_axis())]
    got = vectors(spark, sf_dir, 3).filter(S.norm(_axis()) > 0.01).select("vec_id", R.nearest_rotation(F.array(*m)).alias("r"))
    e = R.entries(F.col("r"))
    det = S.dot(e[:3], S.cross(e[3:6], e[6:9]))
    return got.select("vec_id", *_rounded(m0=e[0], m1=e[1], det=det))


@query("""
WITH d AS (SELECT vec_id, list_transform(range(1, 9), lambda i: sqrt(pow(embedding[i]::DOUBLE - embedding[i + 8]::DOUBLE, 2) * 5)) AS d FROM embeddings)
SELECT vec_id, 8 AS n, round(sqrt(list_sum(list_transform(d, lambda x: x * x)) / 8), 4) AS rms, round(list_sum(d) / 8, 4) AS mean, round(list_max(d), 4) AS most, round(sqrt((d[1] * d[1] + d[3] * d[3]) / 2), 4) AS part FROM d""")
def uv_error_metrics(spark, sf_dir):
    points = lambda lo: F.transform(F.slice("embedding", lo, 8), lambda x: F.struct(x.cast("double").alias("u"), (2 * x.cast("double")).alias("v")))
    got = load(spark, sf_dir, "embeddings").select("vec_id", R.uv_errors(points(1), points(9), (0, 2)).alias("e"))
    return got.select("vec_id", F.col("e.count").alias("n"), *_rounded(rms=F.col("e.rms"), mean=F.col("e.mean"), most=F.col("e.max"), part=F.col("e.rms_subset")))
