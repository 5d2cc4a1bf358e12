"""Queries of poses: an embedding's first numbers as joint rotations, a label's vectors, by vec_id, as a series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesforge.operators import poses, series
from seriesforge.plans.registry import query
from seriesforge.session import load


def posed(spark, sf_dir, joints: int, scale: float):
    """label, frame (from 0), vec_id, pose (axis-angle of each joint) and place (three numbers)."""
    at = lambda i, k: scale * F.get("embedding", (3 * i + k).cast("int")).cast("double")
    pose = F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("z")))
    w = Window.partitionBy("label").orderBy("vec_id")
    return load(spark, sf_dir, "embeddings").select("label", (F.row_number().over(w) - 1).alias("frame"), "vec_id", pose.alias("pose"),
                                                    F.transform(F.slice("embedding", 60, 3), lambda x: x.cast("double")).alias("place"))


LIMITS = ", ".join(f"({j}, radians({s}), radians({t}))" for j, (s, t) in enumerate(poses.LIMITS))


@query(f"""
WITH l(j, ms, mt) AS (VALUES {LIMITS}),
p AS (SELECT vec_id, j, ms, mt, 8 * embedding[3 * j + 1]::DOUBLE AS x, 8 * embedding[3 * j + 2]::DOUBLE AS y, 8 * embedding[3 * j + 3]::DOUBLE AS z FROM embeddings, l),
a AS (SELECT *, sqrt(x * x + y * y + z * z) AS a FROM p),
f AS (SELECT *, cos(a / 2) AS fw, sin(a / 2) / a * x AS fx, sin(a / 2) / a * y AS fy, sin(a / 2) / a * z AS fz, cos(x / 2) AS tw, sin(x / 2) AS tx FROM a),
s AS (SELECT *, fw * tw + fx * tx AS sw, fx * tw - fw * tx AS sx, fy * tw - fz * tx AS sy, fy * tx + fz * tw AS sz FROM f),
n AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS n, CASE WHEN sw < 0 THEN -1 ELSE 1 END AS up FROM s),
g AS (SELECT *, 2 * atan2(n, up * sw) AS swing FROM n),
c AS (SELECT *, swing > ms OR abs(x) > mt AS changed, least(swing, ms) AS s2, greatest(-mt, least(mt, x)) AS t2 FROM g),
q AS (SELECT *, cos(s2 / 2) AS w1, up * sx / n * sin(s2 / 2) AS x1, up * sy / n * sin(s2 / 2) AS y1, up * sz / n * sin(s2 / 2) AS z1, cos(t2 / 2) AS w2, sin(t2 / 2) AS x2 FROM c),
r AS (SELECT *, w1 * w2 - x1 * x2 AS rw, w1 * x2 + x1 * w2 AS rx, y1 * w2 + z1 * x2 AS ry, z1 * w2 - y1 * x2 AS rz FROM q),
u AS (SELECT *, CASE WHEN rw < 0 THEN -1 ELSE 1 END * 2 * atan2(sqrt(rx * rx + ry * ry + rz * rz), abs(rw)) / sqrt(rx * rx + ry * ry + rz * rz) AS k FROM r)
SELECT vec_id, j::INTEGER AS joint, changed, round(CASE WHEN changed THEN k * rx ELSE x END, 5) + 0.0 AS x, round(CASE WHEN changed THEN k * ry ELSE y END, 5) + 0.0 AS y,
  round(CASE WHEN changed THEN k * rz ELSE z END, 5) + 0.0 AS z FROM u""")
def clamped_poses(spark, sf_dir):
    got = posed(spark, sf_dir, 15, 8.0).select("vec_id", poses.clamped_pose(F.col("pose")).alias("pose"))
    flat = got.select("vec_id", F.posexplode("pose").alias("joint", "p"))
    return flat.select("vec_id", "joint", "p.changed", *[(F.round(f"p.{c}", 5) + 0.0).alias(c) for c in "xyz"])


def _slerp_sql(bad: str) -> str:
    """Poses and places of the rows that aren't bad, interpolated over the others: t, and per joint the spherical mean."""
    return f"""
WITH s AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS frame, embedding FROM embeddings),
g AS (SELECT *, NOT ({bad}) AS good FROM s),
b AS (SELECT *, max(CASE WHEN good THEN frame END) OVER (PARTITION BY label ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fa,
  min(CASE WHEN good THEN frame END) OVER (PARTITION BY label ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fb FROM g),
e AS (SELECT b.*, coalesce(x.embedding, y.embedding) AS ea, coalesce(y.embedding, x.embedding) AS eb, CASE WHEN fa < fb THEN (b.frame - fa) * 1.0 / (fb - fa) ELSE 0 END::DOUBLE AS t
  FROM b LEFT JOIN s x ON x.label = b.label AND x.frame = fa LEFT JOIN s y ON y.label = b.label AND y.frame = fb),
j AS (SELECT *, 6 * ea[3 * j + 1]::DOUBLE AS ax, 6 * ea[3 * j + 2]::DOUBLE AS ay, 6 * ea[3 * j + 3]::DOUBLE AS az,
  6 * eb[3 * j + 1]::DOUBLE AS bx, 6 * eb[3 * j + 2]::DOUBLE AS by_, 6 * eb[3 * j + 3]::DOUBLE AS bz FROM e, range(3) r(j)),
n AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS na, sqrt(bx * bx + by_ * by_ + bz * bz) AS nb FROM j),
q AS (SELECT *, cos(na / 2) AS aw, sin(na / 2) / na AS ka, cos(nb / 2) AS bw, sin(nb / 2) / nb AS kb FROM n),
d AS (SELECT *, aw * bw + ka * kb * (ax * bx + ay * by_ + az * bz) AS d0 FROM q),
h AS (SELECT *, least(abs(d0), 1) AS d, acos(least(abs(d0), 1)) AS th, CASE WHEN d0 < 0 THEN -1 ELSE 1 END AS sg FROM d),
w AS (SELECT *, CASE WHEN d > 0.9995 THEN 1 - t ELSE sin((1 - t) * th) / sin(th) END AS wa, sg * CASE WHEN d > 0.9995 THEN t ELSE sin(t * th) / sin(th) END AS wb FROM h),
m AS (SELECT *, wa * aw + wb * bw AS mw, wa * ka * ax + wb * kb * bx AS mx, wa * ka * ay + wb * kb * by_ AS my, wa * ka * az + wb * kb * bz AS mz FROM w),
v AS (SELECT *, CASE WHEN mw < 0 THEN -2 ELSE 2 END * atan2(sqrt(mx * mx + my * my + mz * mz), abs(mw)) / sqrt(mx * mx + my * my + mz * mz) AS k FROM m)"""


@query(_slerp_sql("vec_id % 7 IN (1, 2, 5) OR frame < 3") + """
SELECT vec_id, j::INTEGER AS joint, round(CASE WHEN good THEN 6 * embedding[3 * j + 1]::DOUBLE ELSE k * mx END, 5) + 0.0 AS x,
  round(CASE WHEN good THEN 6 * embedding[3 * j + 2]::DOUBLE ELSE k * my END, 5) + 0.0 AS y,
  round(CASE WHEN good THEN embedding[60]::DOUBLE ELSE (1 - t) * ea[60]::DOUBLE + t * eb[60]::DOUBLE END, 5) + 0.0 AS place FROM v""")
def interpolated_poses(spark, sf_dir):
    got = poses.filled(posed(spark, sf_dir, 3, 6.0), "label", "frame", ~(F.expr("vec_id % 7 IN (1, 2, 5) OR frame < 3")), ["pose"], ["place"])
    # Good rows keep their vectors as they are, over half a turn too.
    flat = got.select("vec_id", "place", F.posexplode("pose").alias("joint", "p"))
    return flat.select("vec_id", "joint", *[(F.round(c, 5) + 0.0).alias(n) for n, c in (("x", F.col("p.x")), ("y", F.col("p.y")), ("place", F.get("place", 0)))])


@query(_slerp_sql("vec_id % 9 IN (1, 2, 3, 6)") + """
SELECT vec_id, CASE WHEN good THEN 'none' WHEN fa IS NULL OR fb IS NULL THEN 'no_good_bracket' WHEN frame - fa > 2 OR fb - frame > 2 THEN 'no_near_good_bracket' ELSE 'repaired' END AS method,
  round(CASE WHEN NOT good AND fa IS NOT NULL AND fb IS NOT NULL AND frame - fa <= 2 AND fb - frame <= 2 THEN k * mx ELSE 6 * embedding[1]::DOUBLE END, 5) + 0.0 AS x,
  CASE WHEN NOT good AND fa IS NOT NULL AND fb IS NOT NULL THEN fa END::DOUBLE AS prev_frame, round(CASE WHEN NOT good AND frame - fa <= 2 AND fb - frame <= 2 THEN t END, 6) AS alpha FROM v WHERE j = 0""")
def repaired_poses(spark, sf_dir):
    got = poses.repaired(posed(spark, sf_dir, 3, 6.0), "label", "frame", F.expr("vec_id % 9 IN (1, 2, 3, 6)"), ["pose"], ["place"], reach=2)
    return got.select("vec_id", "method", (F.round(F.get("pose", 0)["x"], 5) + 0.0).alias("x"), F.col("prev_frame").cast("double").alias("prev_frame"), F.round("alpha", 6).alias("alpha"))


@query("""
WITH s AS (SELECT label, vec_id, embedding[1:4] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings),
q AS (SELECT label, vec_id, pos, list_transform(e, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(e, lambda y: y::DOUBLE * y::DOUBLE)))) AS q FROM s),
d AS (SELECT vec_id, abs(list_sum(list_transform(list_zip(q, lag(q) OVER (PARTITION BY label ORDER BY pos)), lambda z: z[1] * z[2]))) AS d, lag(pos) OVER (PARTITION BY label ORDER BY pos) AS before FROM q)
SELECT vec_id, CASE WHEN before IS NOT NULL THEN round(degrees(2 * acos(least(d, 1))), 4) END AS jump FROM d""")
def rotation_jumps(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(4)])
    n = F.sqrt(sum((F.col(f"e{i}") * F.col(f"e{i}") for i in range(1, 4)), F.col("e0") * F.col("e0")))
    e = e.withColumns({f"q{i}": F.col(f"e{i}") / n for i in range(4)})
    return e.select("vec_id", F.round(poses.rotation_jump([F.col(f"q{i}") for i in range(4)], series.over("label", "vec_id")), 4).alias("jump"))
