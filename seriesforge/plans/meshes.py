"""Queries of meshes, masks and depth maps, derived from the embeddings: a vector is a small mesh, or a frame of a depth map."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import meshes, silhouettes
from seriesforge.plans.registry import query
from seriesforge.session import load

#: Places (a, b, c) of the corners of each face of the meshes: a strip.
FACES = [(i, i + 1, i + 2) for i in range(19)]


def faces():
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("abc", f, strict=True)]) for f in FACES])


def hands(spark, sf_dir):
    """vec_id, label, vertices (21 of u, v, z) and the pixels that count, of every embedding."""
    at = lambda i, k: F.get("embedding", (3 * i + k).cast("int")).cast("double")
    vertices = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(
        (12 + 24 * at(i, 0)).alias("u"), (12 + 24 * at(i, 1)).alias("v"), (1 + at(i, 2)).alias("z")))
    clip = F.struct(*[F.lit(x).alias(n) for n, x in (("x1", 0), ("y1", 0), ("x2", 23), ("y2", 23))])
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", vertices.alias("vertices"), clip.alias("clip"))


M = """m AS (SELECT vec_id, label, i, 12 + 24 * embedding[3 * i + 1]::DOUBLE AS u, 12 + 24 * embedding[3 * i + 2]::DOUBLE AS v, 1 + embedding[3 * i + 3]::DOUBLE AS z
  FROM embeddings, range(21) r(i))"""
S = f"""{M},
t AS (SELECT a.vec_id, a.i, a.u AS u0, a.v AS v0, a.z AS z0, b.u AS u1, b.v AS v1, b.z AS z1, c.u AS u2, c.v AS v2, c.z AS z2
  FROM m a JOIN m b ON b.vec_id = a.vec_id AND b.i = a.i + 1 JOIN m c ON c.vec_id = a.vec_id AND c.i = a.i + 2),
y AS (SELECT *, unnest(generate_series(greatest(0, floor(least(v0, v1, v2)))::BIGINT, least(23, ceil(greatest(v0, v1, v2)))::BIGINT)) AS py FROM t WHERE least(z0, z1, z2) > 1e-8),
x AS (SELECT *, unnest(generate_series(greatest(0, floor(least(u0, u1, u2)))::BIGINT, least(23, ceil(greatest(u0, u1, u2)))::BIGINT)) AS px,
  (v1 - v2) * (u0 - u2) + (u2 - u1) * (v0 - v2) AS den FROM y),
w AS (SELECT *, ((v1 - v2) * (px - u2) + (u2 - u1) * (py - v2)) / den AS w0, ((v2 - v0) * (px - u2) + (u0 - u2) * (py - v2)) / den AS w1 FROM x WHERE abs(den) >= 1e-8),
s AS (SELECT vec_id, px, py, min(w0 * z0 + w1 * z1 + (1 - w0 - w1) * z2) AS z FROM w WHERE w0 >= -1e-4 AND w1 >= -1e-4 AND 1 - w0 - w1 >= -1e-4 GROUP BY ALL)"""
V = f"""{S},
n AS (SELECT m.vec_id, m.i, min(s.z) AS surface FROM m JOIN s ON s.vec_id = m.vec_id
  AND s.px BETWEEN round_even(m.u, 0) - 1 AND round_even(m.u, 0) + 1 AND s.py BETWEEN round_even(m.v, 0) - 1 AND round_even(m.v, 0) + 1 GROUP BY ALL),
seen AS (SELECT m.*, surface, m.z - surface AS margin, coalesce(m.z - surface <= 0.02, false)::INTEGER AS visible FROM m LEFT JOIN n USING (vec_id, i))"""


def seen_vertices(spark, sf_dir):
    hand = hands(spark, sf_dir)
    front = meshes.surface(hand, ["vec_id"], "vertices", faces(), "clip")
    points = hand.select("vec_id", F.posexplode("vertices").alias("i", "p")).select("vec_id", "i", "p.*")
    return meshes.visible_points(points, front, ["vec_id"], "i", "u", "v", "z", radius=1, epsilon=0.02)


@query(f"WITH {S} SELECT vec_id, count(*)::BIGINT AS pixels, round(sum(z), 4) AS depth, round(min(z), 6) AS nearest FROM s GROUP BY vec_id")
def mesh_surface(spark, sf_dir):
    got = meshes.surface(hands(spark, sf_dir), ["vec_id"], "vertices", faces(), "clip")
    return got.groupBy("vec_id").agg(F.count("*").alias("pixels"), F.round(F.sum("z"), 4).alias("depth"), F.round(F.min("z"), 6).alias("nearest"))


@query(f"WITH {V} SELECT vec_id, i::INTEGER AS i, round(surface, 6) AS surface_z, round(margin, 6) AS margin, visible FROM seen")
def vertex_visibility(spark, sf_dir):
    return seen_vertices(spark, sf_dir).select("vec_id", "i", F.round("surface_z", 6).alias("surface_z"), F.round("margin", 6).alias("margin"), "visible")


N = """p AS (SELECT label, vec_id AS p, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
q AS (SELECT label, vec_id AS q, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, 2 * embedding[6]::DOUBLE AS z FROM embeddings),
r AS (SELECT label, q, p, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) AS d FROM q JOIN p USING (label))"""


@query(f"WITH {N}, k AS (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY d, p) AS rank FROM r) SELECT label, q, p, round(d, 9) AS distance, rank::INTEGER AS rank FROM k WHERE rank <= 18")
def nearest_vertices(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double")
    points = e.select("label", F.col("vec_id").alias("p"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    joints = e.select("label", F.col("vec_id").alias("q"), at(3).alias("x"), at(4).alias("y"), (2 * at(5)).alias("z"))
    return meshes.nearest_points(joints, points, "label", "q", "p", ["x", "y", "z"], 18).withColumn("distance", F.round("distance", 9))


@query(f"""
WITH {V}, k AS (SELECT j.vec_id, j.i AS joint, v.i, v.margin, v.visible, row_number() OVER (PARTITION BY j.vec_id, j.i ORDER BY
    sqrt((j.u + 1 - v.u) * (j.u + 1 - v.u) + (j.v - v.v) * (j.v - v.v) + (j.z - v.z) * (j.z - v.z)), v.i) AS rank
  FROM m j JOIN seen v USING (vec_id) WHERE j.i < 6)
SELECT vec_id, joint::INTEGER AS joint, count(margin)::BIGINT AS tested, round(avg(CASE WHEN margin IS NOT NULL THEN visible END), 6) AS ratio, round(median(margin), 6) AS margin,
  coalesce(avg(CASE WHEN margin IS NOT NULL THEN visible END) >= 0.5, false)::INTEGER AS visible FROM k WHERE rank <= 5 GROUP BY ALL""")
def joint_visibility(spark, sf_dir):
    seen = seen_vertices(spark, sf_dir)
    joints = seen.filter("i < 6").select("vec_id", F.col("i").alias("joint"), (F.col("u") + 1).alias("u"), "v", "z")
    near = meshes.nearest_points(joints, seen, "vec_id", "joint", "i", ["u", "v", "z"], 5)
    got = meshes.visible_joints(near, seen, ["vec_id"], "joint", "i", 0.5)
    return got.select("vec_id", "joint", "tested", F.round("ratio", 6).alias("ratio"), F.round("margin", 6).alias("margin"), "visible")


def outlined(spark, sf_dir):
    """Silhouettes (of the meshes' surfaces), and masks: the same shifted by what depends on the vector, half of the weight on the right."""
    front = meshes.surface(hands(spark, sf_dir), ["vec_id"], "vertices", faces(), "clip").select("vec_id", "px", "py")
    mask = front.select("vec_id", (F.col("px") + F.col("vec_id") % 4).cast("int").alias("px"), (F.col("py") - F.col("vec_id") % 3).cast("int").alias("py"))
    mask = mask.filter("px BETWEEN 0 AND 23 AND py BETWEEN 0 AND 23").withColumn("weight", F.expr("CASE WHEN px > 12 THEN 0.5D ELSE 1.0D END"))
    return front, mask


def _shift_sql() -> str:
    grid = lambda n: f"""
{n}w AS (SELECT g.vec_id, du, dv, sum(coalesce(k.weight, 0)) AS w, count(*) AS area FROM {n}g g JOIN f ON f.vec_id = g.vec_id LEFT JOIN k ON k.vec_id = g.vec_id AND k.px = f.px + du AND k.py = f.py + dv
  WHERE f.px + du BETWEEN 0 AND 23 AND f.py + dv BETWEEN 0 AND 23 GROUP BY ALL),
{n}s AS (SELECT {n}g.vec_id, {n}g.du, {n}g.dv, coalesce(area, 0) AS area, w / total AS coverage, w / greatest(area, 1) AS precision,
  CASE WHEN coalesce(area, 0) < 3 OR total IS NULL THEN -1e9 ELSE 0.65 * (w / total) + 0.35 * (w / greatest(area, 1)) - 0.002 * sqrt(({n}g.du * {n}g.du + {n}g.dv * {n}g.dv)::DOUBLE) END AS score
  FROM {n}g LEFT JOIN {n}w USING (vec_id, du, dv) LEFT JOIN heavy ON heavy.vec_id = {n}g.vec_id),
{n}b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, du, dv) AS place FROM {n}s) WHERE place = 1)"""  # noqa: E731
    return f"""WITH {S}, f AS (SELECT vec_id, px, py FROM s),
k AS (SELECT vec_id, px + vec_id % 4 AS px, py - vec_id % 3 AS py, CASE WHEN px + vec_id % 4 > 12 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM f WHERE px + vec_id % 4 BETWEEN 0 AND 23 AND py - vec_id % 3 BETWEEN 0 AND 23),
heavy AS (SELECT vec_id, sum(weight) AS total FROM k GROUP BY vec_id), i AS (SELECT DISTINCT vec_id FROM f),
cg AS (SELECT vec_id, du, dv FROM i, generate_series(-6, 6, 3) u(du), generate_series(-6, 6, 3) v(dv)), {grid('c')},
rg AS (SELECT vec_id, cb.du + u.d AS du, cb.dv + v.d AS dv FROM cb, generate_series(-2, 2) u(d), generate_series(-2, 2) v(d)), {grid('r')}
SELECT vec_id, du::BIGINT AS du, dv::BIGINT AS dv, round(score, 6) AS score, area::BIGINT AS area FROM rb"""


@query(_shift_sql())
def silhouette_shifts(spark, sf_dir):
    front, mask = outlined(spark, sf_dir)
    got = silhouettes.refined_shift(silhouettes.pixel_runs(front, ["vec_id"]), silhouettes.row_sums(mask, ["vec_id"], 24), ["vec_id"], 24, 24, (6, 3), (2, 1), least_area=3, precision_weight=0.35, shift_penalty=0.002)
    return got.select("vec_id", F.col("du").cast("long").alias("du"), F.col("dv").cast("long").alias("dv"), F.round("score", 6).alias("score"), F.col("area").cast("long").alias("area"))


@query(f"""
WITH {S}, p AS (SELECT vec_id, i, u, v FROM m WHERE i < 5), d AS (SELECT p.vec_id, p.i, s.z FROM p JOIN s ON s.vec_id = p.vec_id AND s.px BETWEEN round_even(p.u, 0) - 1 AND round_even(p.u, 0) + 1
  AND s.py BETWEEN round_even(p.v, 0) - 1 AND round_even(p.v, 0) + 1 AND (s.px + s.py) % 4 > 0 AND s.z > 0.01),
g AS (SELECT p.vec_id, p.i, count(z) AS n, median(z) AS z, quantile_cont(z, 0.9) - quantile_cont(z, 0.1) AS span FROM p LEFT JOIN d USING (vec_id, i) GROUP BY ALL)
SELECT vec_id, i::INTEGER AS i, n::BIGINT AS count, CASE WHEN n < 3 THEN 'no_masked_depth' WHEN span > 0.1 THEN 'depth_span_high' ELSE 'ok' END AS status,
  round(CASE WHEN n >= 3 AND span <= 0.1 THEN z END, 6) AS depth, round(span, 6) AS span FROM g""")
def masked_depths(spark, sf_dir):
    hand = hands(spark, sf_dir)
    front = meshes.surface(hand, ["vec_id"], "vertices", faces(), "clip")
    points = hand.select("vec_id", F.posexplode("vertices").alias("i", "p")).filter("i < 5").select("vec_id", "i", "p.u", "p.v")
    got = silhouettes.sampled_depth(points, front, ["vec_id"], "i", "u", "v", 1, 3, 0.1, mask=front.filter("(px + py) % 4 > 0"))
    return got.select("vec_id", "i", "count", "status", F.round("depth", 6).alias("depth"), F.round("span", 6).alias("span"))
