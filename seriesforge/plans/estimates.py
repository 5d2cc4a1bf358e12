"""Queries of the ladders and estimators. Iterative ones have no SQL and are tested against plain models."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import estimators
from seriesforge.plans.registry import E, events, query
from seriesforge.session import load


@query(f"""
WITH {E}, j AS (SELECT user_id, pos // 21 AS hand, (pos - 1) % 21 AS j, value > 60 AND event_type <> 'error' AS seen FROM e),
h AS (SELECT user_id, hand, sum((seen AND j IN (0, 5, 9, 13, 17))::INT) AS a, sum((seen AND j IN (0, 1, 2, 5, 6, 9, 10, 13, 14, 17, 18))::INT) AS b, sum(seen::INT) AS n FROM j GROUP BY ALL)
SELECT user_id, hand::BIGINT AS hand, CASE WHEN a >= 2 THEN 'visible_reliable_joints' WHEN b >= 3 THEN 'visible_stable_joints' WHEN n >= 4 THEN 'visible_all_joints_fallback' ELSE 'keep_previous_low_visible_depth' END AS source,
  (CASE WHEN a >= 2 THEN a WHEN b >= 3 THEN b WHEN n >= 4 THEN n ELSE 0 END)::INTEGER AS joints FROM h""")
def visible_joint_choice(spark, sf_dir):
    e = events(spark, sf_dir).selectExpr("user_id", "pos div 21 AS hand", "cast((pos - 1) % 21 AS int) AS j", "value > 60 AS seen", "event_type <> 'error' AS ok")
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.element_at(F.map_from_entries(F.collect_list(F.struct("j", c))), j))
    hands = e.groupBy("user_id", "hand").agg(at("seen").alias("_seen"), at("ok").alias("_ok"))
    choice = estimators.visible_choice(F.transform("_seen", lambda x: F.coalesce(x.cast("int"), F.lit(0))), F.col("_ok"), every=4)
    return hands.select("user_id", "hand", choice.alias("c")).select("user_id", "hand", "c.source", F.size("c.joints").alias("joints"))


@query(f"""
WITH {E}, j AS (SELECT user_id, (pos - 1) % 21 AS j, value AS x, (event_id % 10) / 10.0 AS y FROM e WHERE event_type <> 'view'),
n AS (SELECT *, sum((j IN (0, 5, 9, 13, 17))::INT) OVER (PARTITION BY user_id) >= 2 AS enough FROM j), u AS (SELECT * FROM n WHERE NOT enough OR j IN (0, 5, 9, 13, 17)),
m AS (SELECT *, median(x) OVER (PARTITION BY user_id) AS mx, median(y) OVER (PARTITION BY user_id) AS my FROM u)
SELECT user_id, round(any_value(mx), 4) AS x, round(any_value(my), 4) AS y, count(*)::BIGINT AS count, round(sqrt(avg(pow(x - mx, 2) + pow(y - my, 2))), 4) AS rms,
  round(max(sqrt(pow(x - mx, 2) + pow(y - my, 2))), 4) AS max, CASE WHEN any_value(enough) THEN 'depth_reliable_joints' ELSE 'depth_all_joints' END AS source FROM m GROUP BY user_id""")
def robust_translation(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("j", F.expr("(pos - 1) % 21")).withColumn("x", F.when(F.col("event_type") != "view", F.col("value")).otherwise(float("nan"))).withColumn(
        "y", F.expr("event_id % 10 / 10.0D"))
    got = estimators.robust_translation(e, ["user_id"], "j", ["x", "y"])
    return got.select("user_id", *[F.round(c, 4).alias(c) for c in ("x", "y")], "count", F.round("rms", 4).alias("rms"), F.round("max", 4).alias("max"), "source")


@query()
def motion_phases(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("speed", F.expr("event_id % 17 / 10.0D"))
    found = estimators.contact_windows(e, "user_id", "pos", "value", "speed", F.col("event_type") == "purchase", 10.0)
    return estimators.phases(found, "user_id")


def _rounds() -> str:
    text = """
WITH px AS (SELECT l_suppkey AS frame, 0.5 + l_quantity / 20 AS d, 0.52 + l_quantity / 19.5 + CASE WHEN l_linenumber = 3 THEN 2 ELSE 0 END AS t FROM lineitem),
v AS (SELECT * FROM px WHERE d > 0.1 AND d < 10 AND t > 0.1 AND t < 10), s0 AS (SELECT frame, median(t / d) AS s, count(*) AS n FROM v GROUP BY frame)"""
    for i in range(5):
        text += f""",
g{i} AS (SELECT frame, any_value(s) AS s, any_value(n) AS n, median(abs(d * s - t)) AS g FROM v JOIN s{i} USING (frame) GROUP BY frame),
s{i + 1} AS (SELECT frame, CASE WHEN count(CASE WHEN abs(d * s - t) < greatest(2 * g, 0.01) THEN 1 END) < 50 THEN any_value(s)
  ELSE median(CASE WHEN abs(d * s - t) < greatest(2 * g, 0.01) THEN t / d END) END AS s, any_value(n) AS n FROM v JOIN g{i} USING (frame) GROUP BY frame)"""
    return text + """,
o AS (SELECT frame, any_value(s) AS s, any_value(n) AS n, median(t - d * s) AS o FROM v JOIN s5 USING (frame) GROUP BY frame)
SELECT f.frame, CASE WHEN n >= 100 THEN round(s, 6) ELSE 1 END AS scale, CASE WHEN n >= 100 THEN round(o, 6) ELSE 0 END AS shift
FROM (SELECT DISTINCT frame FROM px) f LEFT JOIN o ON o.frame = f.frame"""


@query(_rounds())
def depth_scale_offset(spark, sf_dir):
    px = load(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS frame", "0.5D + l_quantity / 20 AS depth", "0.52D + l_quantity / 19.5D + IF(l_linenumber = 3, 2, 0) AS template")
    got = estimators.depth_corrections(px, "frame", "depth", "template")
    return got.select("frame", F.round("scale", 6).alias("scale"), F.round("offset", 6).alias("shift"))
