"""The registered queries of the operators over keyed series, each with its SQL.

Users are series, events their frames; lineitem rows of an order are candidates with boxes.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesforge.functions import scalars as S
from seriesforge.operators import matching, relations, series
from seriesforge.plans.registry import ORACLES, QUERIES, B, E, boxes, events, query
from seriesforge.session import load

__all__ = ["ORACLES", "QUERIES"]

@query(f"""
WITH {E}, j AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS step FROM e)
SELECT user_id, count(step)::BIGINT AS n, round(quantile_cont(step, 0.5), 4) AS p50, round(quantile_cont(step, 0.95), 4) AS p95,
       round(max(step), 4) AS most FROM j GROUP BY user_id""")
def series_jump_stats(spark, sf_dir):
    e = events(spark, sf_dir)
    e = e.withColumn("step", series.jump(F.col("value"), series.over("user_id", "pos")))
    got = series.stats(e, ["user_id"], "step")
    return got.select("user_id", F.col("count").alias("n"), F.round("median", 4).alias("p50"), F.round("p95", 4).alias("p95"), F.round("max", 4).alias("most"))


@query(f"""
WITH {E}, w AS (SELECT event_id, value, median(value) OVER x AS med, list(value) OVER x AS near FROM e
  WINDOW x AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
m AS (SELECT *, list_median(list_transform(near, lambda x: abs(x - med))) AS mad FROM w)
SELECT event_id, round(med, 4) AS med, round(mad, 4) AS mad,
       (len(near) >= 3 AND abs(value - med) > 5 * (mad + 1e-6))::INTEGER AS outlier FROM m""".replace("list_median(", "list_aggregate(").replace("abs(x - med))) AS mad", "abs(x - med)), 'median') AS mad"))
def rolling_mad_outliers(spark, sf_dir):
    got = series.rolling_mad_outliers(events(spark, sf_dir), "user_id", "pos", "value")
    return got.select("event_id", F.round("med", 4).alias("med"), F.round("mad", 4).alias("mad"), "outlier")


@query(f"""
WITH {E}, t AS (SELECT *, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS trust FROM e)
SELECT a.event_id, round(sum(b.trust * exp(-0.5 * pow((b.pos - a.pos) / 5.0, 2)) * b.value) / sum(b.trust * exp(-0.5 * pow((b.pos - a.pos) / 5.0, 2))), 4) AS smooth
FROM t a JOIN t b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 15 AND a.pos + 15 GROUP BY a.event_id""")
def gaussian_trust_smooth(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("trust", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0))
    return series.gaussian_smooth(e, "user_id", "pos", "value", "trust").select("event_id", F.round("smooth", 4).alias("smooth"))


_FIT = " ".join(
    f"WHEN n >= 7 AND place = {i} THEN (" + " + ".join(f"({c}) * v[f + {j}]" for j, c in enumerate(row, 1)) + f") / {series.SAVGOL_SCALE[i]}.0"
    for i, row in enumerate(series.SAVGOL_7_2)
)


@query(f"""
WITH {E}, w AS (SELECT event_id, value, pos, count(*) OVER (PARTITION BY user_id) AS n, list(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM e),
p AS (SELECT *, greatest(0, least(pos - 4, n - 7)) AS f FROM w), q AS (SELECT *, pos - 1 - f AS place FROM p)
SELECT event_id, round(CASE {_FIT} ELSE value END, 4) AS smooth FROM q""")
def savgol_smooth(spark, sf_dir):
    return series.savgol(events(spark, sf_dir), "user_id", "pos", "value").select("event_id", F.round("smooth", 4).alias("smooth"))


@query(f"""
WITH {E}, a AS (SELECT *, lag(value) OVER x AS a, lead(value) OVER x AS b FROM e WINDOW x AS (PARTITION BY user_id ORDER BY pos)),
m AS (SELECT *, median(abs(value - a)) OVER (PARTITION BY user_id) AS med FROM a),
s AS (SELECT *, coalesce(abs(value - a) > 3 * med AND abs(value - b) > 3 * med, false) AS spike FROM m)
SELECT event_id, spike::INTEGER AS spike, round(CASE WHEN spike THEN (a + b) / 2 ELSE value END, 4) AS repaired FROM s""")
def spike_reject_midpoint(spark, sf_dir):
    got = series.spike_midpoint(events(spark, sf_dir), "user_id", "pos", "value")
    return got.select("event_id", "spike", F.round("repaired", 4).alias("repaired"))


@query(f"""
WITH {E}, q AS (SELECT user_id, quantile_cont(value, 0.3) AS p30 FROM e GROUP BY user_id),
l AS (SELECT e.user_id, pos FROM e JOIN q USING (user_id) WHERE value <= p30),
n AS (SELECT *, coalesce((pos > lag(pos) OVER (PARTITION BY user_id ORDER BY pos) + 2)::INT, 1) AS new FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM n)
SELECT user_id, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last, count(*)::BIGINT AS n FROM r GROUP BY user_id, run HAVING max(pos) - min(pos) + 1 >= 3""")
def low_value_islands(spark, sf_dir):
    e = events(spark, sf_dir)
    e = e.withColumn("p30", F.percentile("value", 0.3).over(Window.partitionBy("user_id")))
    got = series.islands(e, "user_id", "pos", F.col("value") <= F.col("p30"), least=3)
    return got.select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


@query(f"""
WITH {E}, h AS (SELECT event_id, pos, max(CASE WHEN event_type <> 'error' THEN pos END) OVER x AS p,
  arg_max(value, CASE WHEN event_type <> 'error' THEN pos END) OVER x AS v FROM e
  WINDOW x AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, coalesce(pos - p, -1)::BIGINT AS age, CASE WHEN pos - p <= 2 THEN v END AS held FROM h""")
def hold_last_good(spark, sf_dir):
    got = series.hold_last(events(spark, sf_dir), "user_id", "pos", "pos", "value", F.col("event_type") != "error", 2)
    return got.select("event_id", F.coalesce(F.col("age").cast("long"), F.lit(-1)).cast("long").alias("age"), "held")


@query(f"""
WITH {E}, g AS (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v FROM e),
b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
  min(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM g)
SELECT b.event_id, round(coalesce(b.v, x.v + (b.pos - pa) * 1.0 / (pb - pa) * (y.v - x.v), x.v, y.v), 4) AS filled,
       (CASE WHEN b.v IS NOT NULL THEN 0 ELSE coalesce(pb - pa - 1, 999) END)::BIGINT AS gap
FROM b LEFT JOIN g x ON x.user_id = b.user_id AND x.pos = pa LEFT JOIN g y ON y.user_id = b.user_id AND y.pos = pb""")
def bracket_interpolate(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    got = series.bracket_fill(e, "user_id", "pos", "pos", "v")
    return got.select("event_id", F.round("filled", 4).alias("filled"), F.col("gap").cast("long").alias("gap"))


@query(f"""
WITH {E}, b AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
  min(CASE WHEN event_type = 'purchase' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM e)
SELECT b.event_id, r.event_id AS nearest_event FROM b LEFT JOIN e r ON r.user_id = b.user_id
  AND r.pos = CASE WHEN pa IS NOT NULL AND (pb IS NULL OR b.pos - pa <= pb - b.pos) THEN pa ELSE pb END""")
def nearest_reference(spark, sf_dir):
    got = series.nearest(events(spark, sf_dir), "user_id", "pos", "event_id", F.col("event_type") == "purchase", "nearest_event")
    return got.select("event_id", "nearest_event")


@query(f"""
WITH {E}, c AS (SELECT *, (event_type = 'error')::INT AS core FROM e)
SELECT event_id, core, coalesce(max(core) OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AND core = 0, false)::INTEGER AS neighbour FROM c""")
def neighbor_band_flags(spark, sf_dir):
    core = F.col("event_type") == "error"
    return relations.near_rows(events(spark, sf_dir), "user_id", "pos", core, 1).select("event_id", core.cast("int").alias("core"), "neighbour")


@query(f"""
WITH {E} SELECT DISTINCT user_id, unnest(generate_series(greatest(pos - 2, 0), pos + 2))::BIGINT AS pos FROM e WHERE event_type = 'error'""")
def context_expand(spark, sf_dir):
    return relations.with_context(events(spark, sf_dir).filter("event_type = 'error'"), "user_id", "pos", 2)


@query(f"""
WITH {E}, v AS (SELECT user_id, event_type, round(sum(greatest(0.01, value)), 6) AS w, min(pos) AS f FROM e GROUP BY ALL)
SELECT user_id, first(event_type ORDER BY w DESC, f) AS label, round(max(w), 3) AS weight, count(*)::BIGINT AS labels FROM v GROUP BY user_id""")
def weighted_majority_label(spark, sf_dir):
    got = series.majority(events(spark, sf_dir), "user_id", "event_type", F.greatest(F.lit(0.01), F.col("value")), "pos")
    return got.select("user_id", "label", F.round("weight", 3).alias("weight"), "labels")


@query(f"""
WITH {B}, p AS (SELECT a.l_orderkey, a.candidate AS a, b.candidate AS b,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
  FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.candidate < b.candidate)
SELECT l_orderkey, a::INTEGER AS a, b::INTEGER AS b, round(i / (s - i), 4) AS iou FROM p WHERE i / (s - i) > 0.3""")
def same_group_overlap_pairs(spark, sf_dir):
    got = relations.group_pairs(boxes(spark, sf_dir), ["l_orderkey", "l_returnflag"], "candidate", ["x1", "y1", "x2", "y2"], S.box_iou, "iou")
    return got.filter("iou > 0.3").select("l_orderkey", "a", "b", F.round("iou", 4).alias("iou"))


@query("""
WITH a AS (SELECT o_custkey AS k, max(o_orderdate) AS latest FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_acctbal > 0),
c AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1)
SELECT k, latest, c_acctbal, n::BIGINT AS n, (row_number() OVER (ORDER BY k) - 1)::INTEGER AS place FROM a JOIN b USING (k) JOIN c USING (k)""")
def three_way_common_keys(spark, sf_dir):
    a = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("latest"))
    b = load(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_acctbal")
    c = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n"))
    return relations.common_keys([a, b, c], "k")


@query(f"""
WITH {E}, j AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS step FROM e)
SELECT event_id, coalesce(nullif(concat_ws('|', CASE WHEN value > 400 THEN 'bad_value' WHEN value > 200 THEN 'warn_value' END,
  CASE WHEN step > 300 THEN 'bad_jump' WHEN step > 150 THEN 'warn_jump' END), ''), 'ok') AS flag FROM j""")
def quality_flags(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("step", series.jump(F.col("value"), series.over("user_id", "pos")))
    flag = S.join_flags(S.level_flag(F.col("value"), 200, 400, "value"), S.level_flag(F.col("step"), 150, 300, "jump"))
    return e.select("event_id", flag.alias("flag"))


@query("""
WITH m AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS docs, avg(quality) AS good, sum(toxic) AS toxic FROM labels)
SELECT 'labels' AS node, n::BIGINT AS n, round(good, 4) AS good, CASE WHEN n <> docs THEN 1 ELSE 0 END AS hard_errors,
  (CASE WHEN good < 0.9 THEN 1 ELSE 0 END + CASE WHEN toxic > 0 THEN 1 ELSE 0 END)::INTEGER AS warnings, n = docs AS ok FROM m""")
def gate_report(spark, sf_dir):
    m = load(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.avg("quality").alias("good"), F.sum("toxic").alias("toxic"))
    return m.select(F.lit("labels").alias("node"), "n", F.round("good", 4).alias("good"), (F.col("n") != F.col("docs")).cast("int").alias("hard_errors"),
                    ((F.col("good") < 0.9).cast("int") + (F.col("toxic") > 0).cast("int")).alias("warnings"), (F.col("n") == F.col("docs")).alias("ok"))


@query("""
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3]::DOUBLE) + 1 AS z FROM embeddings)
SELECT vec_id, round(500 * x / z + 320, 4) AS u, round(510 * y / z + 240, 4) AS v, round((500 * x / z) * z / 500, 4) AS back_x, round(y, 4) AS back_y FROM v""")
def pinhole_project_roundtrip(spark, sf_dir):
    c = [F.get("embedding", i).cast("double") for i in range(3)]
    e = load(spark, sf_dir, "embeddings").select("vec_id", c[0].alias("x"), c[1].alias("y"), (F.abs(c[2]) + 1).alias("z"))
    u, v = S.project(F.col("x"), F.col("y"), F.col("z"), 500, 510, 320, 240)
    bx, by = S.backproject(u, v, F.col("z"), 500, 510, 320, 240)
    return e.select("vec_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), F.round(bx, 4).alias("back_x"), F.round(by, 4).alias("back_y"))


@query("""
WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
p AS (SELECT *, lag(x) OVER w AS a, lag(y) OVER w AS b, lag(z) OVER w AS c FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, CASE WHEN a IS NOT NULL THEN round(degrees(acos(greatest(-1, least(1, (x * a + y * b + z * c) / (sqrt(x * x + y * y + z * z) * sqrt(a * a + b * b + c * c)))))), 3) END AS angle FROM p""")
def vector_angle_jump(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(n) for i, n in enumerate("xyz")])
    w = series.over("label", "vec_id")
    now, before = [F.col(n) for n in "xyz"], [F.lag(n).over(w) for n in "xyz"]
    return e.select("vec_id", F.round(S.angle_deg(now, before), 3).alias("angle"))


@query(f"""
WITH {E}, m AS (SELECT user_id, max(value) AS worst FROM e GROUP BY 1) SELECT user_id, worst FROM m ORDER BY worst DESC, user_id LIMIT 12""")
def worst_n_groups(spark, sf_dir):
    return relations.worst_groups(events(spark, sf_dir), "user_id", "value", 12)


@query(f"""
WITH {E}, p AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), k AS (SELECT DISTINCT user_id, round_even(i * (n - 1) / 4.0, 0)::BIGINT + 1 AS pos FROM p, range(5) AS r(i))
SELECT e.user_id, e.pos::INTEGER AS pos, e.event_id FROM e JOIN k ON e.user_id = k.user_id AND e.pos = k.pos""")
def even_sample(spark, sf_dir):
    return relations.even_sample(events(spark, sf_dir), "user_id", "pos", 5).select("user_id", "pos", "event_id")


@query()
def greedy_tracker(spark, sf_dir):
    one = boxes(spark, sf_dir).withColumn("session", F.expr("l_orderkey div 64")).withColumnRenamed("l_orderkey", "frame")
    return matching.track(one, "session", "frame", "candidate", reach=8.0)


from seriesforge.plans import blocks, depthmaps, estimates, gates, geometry, meshes, poses, rollups, rows, stages, tracks  # noqa: E402, F401  (their queries register themselves)
