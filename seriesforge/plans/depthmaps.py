"""Queries of depth maps: an embedding is a frame of 8 x 8 pixels in four tiles, a label a camera."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesforge.operators import depthmaps
from seriesforge.plans.registry import query
from seriesforge.session import load

SIDE, TILE = 8, 16


def frames(spark, sf_dir):
    """cam, frame (from 0), vec_id, and depth, with holes, by pixel."""
    w = Window.partitionBy("label").orderBy("vec_id")
    depth = F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 11 == 0, 0.0).otherwise(1 + x.cast("double")))
    return load(spark, sf_dir, "embeddings").select(F.col("label").alias("cam"), (F.row_number().over(w) - 1).alias("frame"), "vec_id", "embedding", depth.alias("all"))


def tiles(spark, sf_dir):
    """A row for each tile, moving where the frame's box is (see MASK)."""
    box = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.expr("true") & (i % SIDE >= F.col("frame") % 5) & (i % SIDE < F.col("frame") % 5 + 2) & (
        F.floor(i / SIDE) >= F.col("frame") % 3) & (F.floor(i / SIDE) < F.col("frame") % 3 + 2))
    f = frames(spark, sf_dir).withColumn("box", box).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE // TILE - 1))))
    cut = lambda c: F.slice(c, F.col("tile") * TILE + 1, F.lit(TILE))
    return f.select("cam", "frame", "tile", cut("all").alias("depth"), cut("box").alias("moving"))


P = """f AS (SELECT label AS cam, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS frame, embedding FROM embeddings),
p AS (SELECT cam, frame, i, i % 8 AS px, i // 8 AS py, CASE WHEN (i + vec_id) % 11 = 0 THEN 0 ELSE 1 + embedding[i + 1]::DOUBLE END AS depth,
  i % 8 >= frame % 5 AND i % 8 < frame % 5 + 2 AND i // 8 >= frame % 3 AND i // 8 < frame % 3 + 2 AS moving FROM f, range(64) r(i)),
n AS (SELECT cam, count(*) AS frames FROM f GROUP BY cam),
t AS (SELECT cam, i, CASE WHEN count(CASE WHEN NOT moving AND depth >= 0.01 THEN depth END) >= greatest(1, floor(any_value(frames) * 0.9))
  THEN median(CASE WHEN NOT moving AND depth >= 0.01 THEN depth END) ELSE 0 END AS template FROM p JOIN n USING (cam) GROUP BY cam, i)"""


@query(f"WITH {P} SELECT cam, i::INTEGER AS pixel, round(template, 6) AS template FROM t")
def depth_template(spark, sf_dir):
    got = depthmaps.template(tiles(spark, sf_dir), "cam", "frame", "tile", "depth", "moving", least_ratio=0.9)
    flat = got.select("cam", "tile", F.posexplode("template").alias("i", "template"))
    return flat.select("cam", (F.col("tile") * TILE + F.col("i")).alias("pixel"), F.round("template", 6).alias("template"))


@query(f"""
WITH {P}, b AS (SELECT cam, frame, depth, template FROM p JOIN t USING (cam, i) WHERE NOT moving AND depth > 0.9 AND depth < 1.3 AND template > 0.9 AND template < 1.3)
SELECT cam, frame, count(*)::BIGINT AS pixels, round(CASE WHEN count(*) >= 40 THEN sqrt(avg((depth - template) * (depth - template))) END, 6) AS rmse FROM b GROUP BY cam, frame""")
def background_error(spark, sf_dir):
    t = tiles(spark, sf_dir)
    templates = depthmaps.template(t, "cam", "frame", "tile", "depth", "moving", least_ratio=0.9)
    pixels = depthmaps.background_pixels(t, templates, "cam", "frame", "tile", "depth", "moving", near=0.9, far=1.3)
    return depthmaps.background_error(pixels, ["cam", "frame"], 40).withColumn("rmse", F.round("rmse", 6))


@query(f"""
WITH {P}, v AS (SELECT cam, frame, CASE WHEN depth > 0.01 THEN depth END AS d FROM p)
SELECT cam, frame, round(count(d) / count(*), 6) AS valid_ratio, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95 FROM v GROUP BY cam, frame""")
def frame_depths(spark, sf_dir):
    got = depthmaps.frame_depths(tiles(spark, sf_dir), ["cam", "frame"], "depth")
    return got.select("cam", "frame", *[F.round(c, 6).alias(c) for c in ("valid_ratio", "median", "p95")])


MASK = """f AS (SELECT label AS cam, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS frame, embedding FROM embeddings),
n AS (SELECT cam, count(*) AS frames FROM f GROUP BY cam),
b AS (SELECT cam, frame, px, py FROM f, range(8) x(px), range(8) y(py)
  WHERE px >= greatest(0, trunc(frame % 5 - 0.75)) AND px < least(8, trunc(frame % 5 + 3.25)) AND py >= greatest(0, trunc(frame % 3 - 0.75)) AND py < least(8, trunc(frame % 3 + 3.25))),
w AS (SELECT f.cam, f.frame AS pair, i % 8 AS px, i // 8 AS py FROM f, range(64) r(i), n WHERE f.cam = n.cam AND f.frame < n.frames - 1 AND 10 * abs(embedding[i + 1]::DOUBLE) > 2.9),
m0 AS (SELECT DISTINCT f.cam, f.frame, w.px, w.py FROM f JOIN w ON w.cam = f.cam AND w.pair BETWEEN f.frame - 1 AND f.frame),
k(x, y) AS (VALUES (0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)), g AS (SELECT px, py FROM range(8) x(px), range(8) y(py)),
m1 AS (SELECT DISTINCT cam, frame, px + x AS px, py + y AS py FROM m0, k WHERE px + x BETWEEN 0 AND 7 AND py + y BETWEEN 0 AND 7),
need AS (SELECT px, py, count(*) AS n FROM g, k WHERE px + x BETWEEN 0 AND 7 AND py + y BETWEEN 0 AND 7 GROUP BY px, py),
m2 AS (SELECT cam, frame, g.px, g.py FROM m1, k, g WHERE m1.px = g.px + x AND m1.py = g.py + y GROUP BY cam, frame, g.px, g.py
  HAVING count(*) = (SELECT n FROM need WHERE need.px = g.px AND need.py = g.py)),
m3 AS (SELECT DISTINCT cam, frame, px + x AS px, py + y AS py FROM m2, k WHERE px + x BETWEEN 0 AND 7 AND py + y BETWEEN 0 AND 7),
u AS (SELECT cam, frame, px, py FROM b UNION SELECT cam, frame, px, py FROM m3)"""


@query(f"WITH {MASK} SELECT cam, frame, count(*)::BIGINT AS pixels, sum(px * 8 + py)::BIGINT AS places FROM u GROUP BY cam, frame")
def moving_masks(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("cam")))
    corner = lambda c, m, plus: (F.col("frame") % m + plus).cast("double").alias(c)
    boxes = f.withColumn("box", F.struct(corner("x1", 5, 0), corner("y1", 3, 0), corner("x2", 5, 2.5), corner("y2", 3, 2.5)))
    flow = f.filter("frame < n - 1").select("cam", "n", F.col("frame").alias("pair"), F.posexplode("embedding").alias("i", "x")).select(
        "cam", "n", "pair", (F.col("i") % SIDE).alias("px"), F.floor(F.col("i") / SIDE).alias("py"), (10 * F.abs(F.col("x").cast("double"))).alias("magnitude"))
    on = depthmaps.moving_pixels(flow, "cam", "pair", "magnitude", F.col("n"), 2.9)
    mask = depthmaps.moving_mask(depthmaps.box_pixels(boxes, ["cam", "frame"], "box", SIDE, SIDE), on, ["cam", "frame"], SIDE, SIDE, radius=1)
    return mask.groupBy("cam", "frame").agg(F.count("*").alias("pixels"), F.sum(F.col("px") * 8 + F.col("py")).alias("places"))
