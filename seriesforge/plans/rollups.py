"""Queries of the roll-ups, over events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import rollups
from seriesforge.plans.registry import E, events, query
from seriesforge.session import load


def _rounded(df, keys, *columns):
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in columns])


@query(f"""
WITH {E}, d AS (SELECT user_id, pos, value - lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS jump, CASE WHEN event_type <> 'error' THEN value - 50 END AS delta FROM e)
SELECT user_id, count(*)::BIGINT AS rows, min(pos)::INTEGER AS first, max(pos)::INTEGER AS last, round(median(abs(jump)), 4) AS jump_median, round(quantile_cont(abs(jump), 0.95), 4) AS jump_p95, round(max(abs(jump)), 4) AS jump_max,
  round(median(abs(delta)), 4) AS delta_median, round(quantile_cont(abs(delta), 0.95), 4) AS delta_p95, round(max(abs(delta)), 4) AS delta_max FROM d GROUP BY user_id""")
def track_quality(spark, sf_dir):
    from seriesforge.operators.series import over

    e = events(spark, sf_dir).withColumn("jump", F.col("value") - F.lag("value").over(over("user_id", "pos")))
    e = e.withColumn("delta", F.when(F.col("event_type") != "error", F.col("value") - 50).otherwise(float("nan")))
    got = rollups.track_quality(e, ["user_id"], "pos", ["jump", "delta"])
    return _rounded(got, ["user_id", "rows", "first", "last"], *[f"{m}_{s}" for m in ("jump", "delta") for s in ("median", "p95", "max")])


@query("""
WITH d AS (SELECT event_type, value AS v FROM events WHERE event_id % 4 > 0 AND NOT (event_id % 5 > 0 AND value * 10 > 900))
SELECT event_type, count(*)::BIGINT AS count, round(median(v), 4) AS median, round(quantile_cont(v, 0.9), 4) AS p90, round(max(v), 4) AS max, round(stddev_pop(v), 4) AS std FROM d GROUP BY event_type""")
def detected_stats(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("infilled", F.expr("event_id % 4 = 0")).withColumn("size", F.expr("CASE WHEN event_id % 5 > 0 THEN value * 10 END"))
    return _rounded(rollups.detected_stats(e, ["event_type"], "value", "infilled", "size"), ["event_type", "count"], "median", "p90", "max", "std")


@query("""
WITH r AS (SELECT user_id, event_type <> 'error' AS ok, event_id % 3 > 0 AS normal, event_id % 2 = 0 AS relaxed, value / 100 AS pos FROM events)
SELECT user_id, count(*)::BIGINT AS rows, sum(ok::INT)::BIGINT AS solved, sum((ok AND normal)::INT)::BIGINT AS normal, sum((ok AND NOT normal AND relaxed)::INT)::BIGINT AS relaxed, sum((NOT ok)::INT)::BIGINT AS failed,
  round(median(CASE WHEN ok THEN pos END), 6) AS pos_median, round(max(CASE WHEN ok THEN pos END), 4) AS pos_max FROM r GROUP BY user_id""")
def solver_rollup(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("user_id", "event_type <> 'error' AS ok", "event_id % 3 > 0 AS normal", "event_id % 2 = 0 AS relaxed", "value / 100 AS pos")
    got = rollups.solver_rollup(e, ["user_id"], "ok", "normal", "relaxed", ["pos"])
    return got.select("user_id", "rows", "solved", "normal", "relaxed", "failed", F.round("pos_median", 6).alias("pos_median"), F.round("pos_max", 4).alias("pos_max"))


@query(f"""
WITH {E}, o AS (SELECT user_id, pos AS frame, event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 END AS k, value FROM e WHERE event_type IN ('signup', 'purchase', 'error'))
SELECT user_id, frame::INTEGER AS frame, event_type, k::INTEGER AS type_order, CASE WHEN k = 1 THEN value END AS amount, (row_number() OVER (PARTITION BY user_id ORDER BY k, frame))::INTEGER AS place FROM o""")
def ordered_events(spark, sf_dir):
    from pyspark.sql import Window

    e = events(spark, sf_dir).withColumnRenamed("pos", "frame")
    kind = lambda k: e.filter(F.col("event_type") == k).select("user_id", "frame")
    bought = e.filter("event_type = 'purchase'").select("user_id", "frame", F.col("value").alias("amount"))
    got = rollups.ordered_events({"signup": kind("signup"), "purchase": bought, "error": kind("error")}, ["user_id", "frame"])
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("type_order", "frame"))
    return got.select("user_id", "frame", "event_type", "type_order", "amount", place.alias("place"))


@query("""
WITH b AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings WHERE vec_id % 6 > 0)
SELECT label, round(median(a), 6) AS a, round(median(b), 6) AS b, round(median(c), 6) AS c, round((stddev_pop(a) + stddev_pop(b) + stddev_pop(c)) / 3, 6) AS std_mean, round(greatest(stddev_pop(a), stddev_pop(b), stddev_pop(c)), 6) AS std_max FROM b GROUP BY label""")
def shape_summary(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("abc")])
    got = rollups.shape_summary(e.withColumn("c", F.when(F.col("vec_id") % 6 > 0, F.col("c")).otherwise(float("nan"))), ["label"], ["a", "b", "c"])
    return got.select("label", *[F.round(x, 6).alias(x) for x in ("a", "b", "c", "std_mean", "std_max")])


@query(f"""
WITH {E}, j AS (SELECT user_id, pos // 21 AS hand, (pos - 1) % 21 AS j, value / 10 AS x, (event_id % 10) / 10.0 AS y,
  CASE event_type WHEN 'error' THEN 'no_masked_depth' WHEN 'view' THEN 'depth_span_high' ELSE 'ok' END AS status FROM e),
g AS (SELECT *, status = 'ok' AS good, status = 'ok' AND j IN (0, 5, 9, 13, 17) AS rel FROM j),
n AS (SELECT user_id, hand, sum(rel::INT) AS nr, sum(good::INT) AS ng FROM g GROUP BY ALL)
SELECT g.user_id, g.hand::BIGINT AS hand, (CASE WHEN any_value(nr) >= 2 THEN any_value(nr) ELSE any_value(ng) END)::BIGINT AS count,
  CASE WHEN any_value(nr) >= 2 THEN 'depth_reliable_joints' WHEN any_value(ng) > 0 THEN 'depth_all_joints' ELSE 'no_joint' END AS source,
  round(median(CASE WHEN CASE WHEN nr >= 2 THEN rel ELSE good END THEN x END), 4) AS x, round(median(CASE WHEN CASE WHEN nr >= 2 THEN rel ELSE good END THEN y END), 4) AS y,
  coalesce(string_agg(CASE WHEN NOT good THEN j || ':' || status END, ';' ORDER BY j, status), '') AS rejected
FROM g JOIN n ON n.user_id = g.user_id AND n.hand = g.hand GROUP BY g.user_id, g.hand""")
def gated_translation(spark, sf_dir):
    e = events(spark, sf_dir).selectExpr("user_id", "pos div 21 AS hand", "cast((pos - 1) % 21 AS int) AS j", "value / 10 AS x", "event_id % 10 / 10.0D AS y",
                                         "CASE event_type WHEN 'error' THEN 'no_masked_depth' WHEN 'view' THEN 'depth_span_high' ELSE 'ok' END AS status")
    got = rollups.gated_translation(e, ["user_id", "hand"], "j", ["x", "y"], "status")
    return got.select("user_id", "hand", "count", "source", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "rejected")


@query("""
WITH r AS (SELECT user_id, event_id, value / 100 AS t, value / 100 + (event_id % 7) / 1000.0 AS s, event_type <> 'error' AS ok FROM events)
SELECT user_id, count(*)::BIGINT AS frames, sum(ok::INT)::BIGINT AS reached, round(max(CASE WHEN ok THEN abs(t - s) END), 6) AS most, arg_min(event_id, event_id)::BIGINT AS first FROM r GROUP BY user_id""")
def solver_payload(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("user_id", "event_id", "value / 100 AS t", "value / 100 + event_id % 7 / 1000.0D AS s", "event_type <> 'error' AS ok")
    got = rollups.solver_payload(e, "user_id", "event_id", ["t"], ["s"], "ok")
    return got.select("user_id", F.size("frames").cast("long").alias("frames"), F.size(F.filter("frames", lambda x: x["reached"].isNotNull())).cast("long").alias("reached"),
                      F.round(F.array_max(F.transform("frames", lambda x: x["error"])), 6).alias("most"), F.get("frames", 0)["frame"].alias("first"))
