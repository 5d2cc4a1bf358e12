"""Queries of the row operators: joins, filters, samples, set operations, summaries and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.functions import scalars as S
from seriesforge.operators import relations, summaries
from seriesforge.plans.registry import B, E, boxes, events, query
from seriesforge.session import load


@query(f"""
WITH {E}, r AS (SELECT event_id, user_id % 9 AS a, pos % 5 AS lo, pos % 4 AS hi FROM e)
SELECT event_id, array_to_string(list_sort(list_distinct(list_append(CASE WHEN lo <= hi THEN range(lo, hi + 1) ELSE [] END, a))), ' ') AS frames,
  CASE WHEN a = 8 THEN 'left right' ELSE 'right left' END AS tokens, CASE WHEN lo = 0 THEN NULL WHEN a = 8 THEN 'left' ELSE 'right' END AS lane,
  round(a / 4.0 + lo, 4) AS numbers FROM r""")
def scalar_parsing(spark, sf_dir):
    e = events(spark, sf_dir).selectExpr("event_id", "user_id % 9 AS a", "pos % 5 AS lo", "pos % 4 AS hi")
    frames = S.frame_list(F.concat_ws("", "a", F.lit(",,"), "lo", F.lit("-"), "hi", F.lit("; x")))
    tokens = S.token_list(F.when(F.col("a") == 8, " Left, both").otherwise("both,left,"))
    lanes = S.lane_map(F.when(F.col("lo") == 0, "right:left,up:right").when(F.col("a") == 8, "right:left, left:right").otherwise("right:right"))
    numbers = S.float_list(F.concat_ws(",", (F.col("a") / 4).cast("string"), F.lit("nan"), F.lit("?"), "lo"))
    return e.select("event_id", F.array_join(frames, " ").alias("frames"), F.array_join(tokens, " ").alias("tokens"), F.element_at(lanes, "right").alias("lane"),
                    F.round(F.aggregate(numbers, F.lit(0.0), lambda x, y: x + y), 4).alias("numbers"))


@query(f"""
WITH {E} SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN user_id % 5 = 0 THEN 'fallback' WHEN pos % 2 = 0 THEN 'normal' ELSE 'success_unknown' END AS kind,
  CASE WHEN pos % 3 = 0 THEN 'jump' WHEN user_id % 2 = 0 THEN 'size' ELSE 'none' END AS category, round(CASE WHEN user_id % 2 = 0 THEN value WHEN user_id % 3 = 0 THEN -value ELSE 0 END, 4) AS uv,
  round(CASE WHEN value > 90 THEN 0 ELSE value END, 4) AS replaced, (value > 90)::INTEGER AS bad FROM e""")
def row_classification(spark, sf_dir):
    e = events(spark, sf_dir)
    tags = F.array_compact(F.array(F.when(F.expr("user_id % 2 = 0"), "size"), F.when(F.expr("pos % 3 = 0"), "jump")))
    mode = F.when(F.expr("user_id % 2 = 0"), "uv").when(F.expr("user_id % 3 = 0"), "project").otherwise("locked")
    flag = S.join_flags(S.level_flag(F.col("value"), 50, 90, "size"))
    return e.select(
        "event_id", S.solve_kind(F.col("event_type") != "error", F.expr("user_id % 5 = 0"), F.when(F.expr("pos % 2 = 0"), " IK ").otherwise(" ")).alias("kind"),
        S.first_of(tags, ("jump", "size"), "none").alias("category"), F.round(S.by_mode(mode, {"uv": F.col("value"), "project": -F.col("value")}, F.lit(0.0)), 4).alias("uv"),
        F.round(S.replaced(F.col("value"), F.col("value") > 90, F.lit(0.0)), 4).alias("replaced"), S.has_flag(flag, "bad").cast("int").alias("bad"))


@query(f"""
WITH {B} SELECT l_orderkey, candidate::INTEGER AS candidate, round((x1 + x2) / 2, 4) AS cx, round((y1 + y2) / 2, 4) AS cy,
  round(greatest(0, least(x2, 40) - greatest(x1, 0)) * greatest(0, least(y2, 15) - greatest(y1, 0)) / 200, 4) AS visible, (x1 <= 0 OR y1 <= 0 OR x2 >= 39 OR y2 >= 14)::INTEGER AS edge,
  greatest(0, floor(x1 - 2.5))::BIGINT AS x, greatest(0, least(40, ceil(x2 + 2.5)) - greatest(0, floor(x1 - 2.5)))::BIGINT AS w, greatest(0, least(15, ceil(y2 + 2.5)) - greatest(0, floor(y1 - 2.5)))::BIGINT AS h FROM b""")
def box_measures(spark, sf_dir):
    box = F.struct("x1", "y1", "x2", "y2")
    cx, cy = S.box_center(box)
    padded = S.padded_box(box, 2.5, 40, 15)
    return boxes(spark, sf_dir).select("l_orderkey", "candidate", F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"), F.round(S.visible_ratio(box, 40.0, 15.0), 4).alias("visible"),
                                       S.touches_edge(box, 40.0, 15.0).cast("int").alias("edge"), padded["x"].cast("long").alias("x"), padded["w"].cast("long").alias("w"), padded["h"].cast("long").alias("h"))


@query("""
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)
SELECT vec_id, round(len(list_filter(embedding, lambda x: x > 0)) / len(embedding), 4) AS finite,
  round(greatest(list_max(list_filter(embedding[1:8], lambda x: x > 0)) - list_min(list_filter(embedding[1:8], lambda x: x > 0)),
                 2 * (list_max(list_filter(embedding[1:8], lambda x: x > 0)) - list_min(list_filter(embedding[1:8], lambda x: x > 0)))), 4) AS extent,
  round(len(list_filter(embedding[1:8], lambda x: x > 0 AND x < 0.1)) / 8, 4) AS inside FROM d""")
def point_measures(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")).otherwise(float("nan")))
    points = F.transform(F.slice(values, 1, 8), lambda x: F.struct(x.alias("u"), (2 * x).alias("v")))
    return e.select("vec_id", F.round(S.finite_ratio(values), 4).alias("finite"), F.round(S.extent(points), 4).alias("extent"),
                    F.round(S.inside_ratio(points, 0.1, 0.2), 4).alias("inside"))


@query(f"""
WITH {E}, a AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN pos END) OVER (PARTITION BY user_id) + 2 AS lo, max(CASE WHEN event_type = 'purchase' THEN pos END) OVER (PARTITION BY user_id) - 2 AS hi FROM e)
SELECT event_id FROM a WHERE pos BETWEEN lo AND hi AND pos BETWEEN 5 AND 60""")
def active_segments(spark, sf_dir):
    got = relations.active_segment(events(spark, sf_dir), "user_id", "pos", F.col("event_type") == "purchase", 2)
    return relations.frame_range(got, "pos", 5, 60).select("event_id")


@query(f"""
WITH {B}, m AS (SELECT *, (candidate * 3) % 25 AS landmark, CASE WHEN candidate % 4 = 0 THEN ' False' WHEN candidate % 5 = 0 THEN '0' WHEN candidate % 2 = 0 THEN 'yes' END AS valid FROM b),
v AS (SELECT * FROM m WHERE NOT coalesce(lower(trim(valid)), '') IN ('0', 'false') AND landmark BETWEEN 0 AND 20), g AS (SELECT l_orderkey FROM v GROUP BY 1 HAVING count(DISTINCT landmark) >= 3 AND min(x1) >= 3)
SELECT l_orderkey, candidate::INTEGER AS candidate FROM v WHERE l_orderkey IN (SELECT l_orderkey FROM g)""")
def complete_groups(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("landmark", F.expr("candidate * 3 % 25")).withColumn("valid", F.expr("CASE WHEN candidate % 4 = 0 THEN ' False' WHEN candidate % 5 = 0 THEN '0' WHEN candidate % 2 = 0 THEN 'yes' END"))
    b = b.withColumn("x1", F.when(F.col("x1") >= 3, F.col("x1")).otherwise(float("nan")))
    return relations.complete_groups(relations.valid_landmarks(b, "valid", "landmark"), ["l_orderkey"], ["x1", "y1"], "landmark", 3).select("l_orderkey", "candidate")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), c AS (SELECT c_custkey, c_acctbal, c_custkey - 1 AS place FROM customer WHERE c_custkey % 3 > 0)
SELECT o_orderkey, coalesce(k.c_acctbal, p.c_acctbal) AS balance, CASE WHEN k.c_custkey IS NOT NULL THEN 'key' WHEN p.c_custkey IS NOT NULL THEN 'position' ELSE 'none' END AS matched
FROM o LEFT JOIN c k ON k.c_custkey = o.o_custkey LEFT JOIN c p ON p.place = o.place""")
def key_or_position_join(spark, sf_dir):
    o = relations.common_keys([load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")], "o_orderkey")
    c = load(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").selectExpr("c_custkey AS o_custkey", "c_acctbal AS balance", "c_custkey - 1 AS place")
    return relations.join_or_position(o, c, ["o_custkey"], "place", ["balance"]).select("o_orderkey", "balance", "matched")


@query("""
SELECT o_orderkey, coalesce(c_mktsegment, '') AS segment, coalesce(c_acctbal, 0) AS balance, CASE WHEN c_custkey IS NULL THEN 'missing_depth_frame' ELSE 'ok' END AS status
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 > 0) c ON o_custkey = c_custkey""")
def lookup_with_status(spark, sf_dir):
    c = load(spark, sf_dir, "customer").filter("c_custkey % 4 > 0").selectExpr("c_custkey AS o_custkey", "c_mktsegment AS segment", "c_acctbal AS balance")
    got = relations.lookup(load(spark, sf_dir, "orders"), c, ["o_custkey"], {"segment": "", "balance": 0.0}, "status", "missing_depth_frame")
    return got.select("o_orderkey", "segment", "balance", "status")


@query(f"""
WITH {E}, c AS (SELECT user_id, pos AS first, pos + event_id % 3 AS last, event_type AS phase, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS nxt FROM e WHERE event_type IN ('purchase', 'error')),
p AS (SELECT user_id, first, least(last, coalesce(nxt - 1, last)) AS last, phase FROM c)
SELECT e.event_id, coalesce(p.phase, 'unknown') AS phase FROM e LEFT JOIN p ON p.user_id = e.user_id AND e.pos BETWEEN p.first AND p.last""")
def phase_of_samples(spark, sf_dir):
    from seriesforge.operators.series import over

    e = events(spark, sf_dir)
    own = e.filter("event_type IN ('purchase', 'error')").withColumn("next", F.lead("pos").over(over("user_id", "pos")))
    last = F.expr("pos + event_id % 3")
    phases = own.select("user_id", F.col("pos").alias("first"), F.least(last, F.coalesce(F.col("next") - 1, last)).alias("last"), F.col("event_type").alias("phase"))
    return relations.in_phases(e.select("event_id", "user_id", "pos"), phases, "user_id", "pos", "phase").select("event_id", "phase")


@query("""
SELECT a.c_custkey, round(a.c_acctbal, 4) AS before, round(o.total, 4) AS after, round(o.total - a.c_acctbal, 4) AS change FROM customer a
JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY 1) o ON o.o_custkey = a.c_custkey""")
def stage_comparison(spark, sf_dir):
    one = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("m"))
    two = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return relations.stage_change(one, two, ["c_custkey"], "m").select("c_custkey", *[F.round(c, 4).alias(c) for c in ("before", "after", "change")])


@query(f"""
WITH {E}, bad AS (SELECT user_id, pos FROM e WHERE event_type = 'error'), ctx AS (SELECT DISTINCT user_id, unnest(generate_series(greatest(pos - 1, 0), pos + 1)) AS pos FROM bad)
SELECT event_id, 'filled' AS source FROM e WHERE NOT EXISTS (SELECT 1 FROM ctx WHERE ctx.user_id = e.user_id AND ctx.pos = e.pos)
UNION ALL SELECT event_id, 'observed' FROM e JOIN bad USING (user_id, pos)""")
def complement_and_union(spark, sf_dir):
    e = events(spark, sf_dir)
    bad = e.filter("event_type = 'error'").select("user_id", "pos", "event_id")
    rest = relations.complement(e, relations.with_context(bad, "user_id", "pos", 1), ["user_id", "pos"]).select("event_id")
    return relations.joined_rows(bad.select("event_id"), rest).select("event_id", "source")


@query(f"""
WITH {E}, f AS (SELECT DISTINCT user_id FROM e ORDER BY user_id LIMIT 20), r AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM e JOIN f USING (user_id) WHERE pos % 3 = 0)
SELECT event_id, user_id, k::INTEGER AS k FROM r WHERE k <= 4""")
def requested_frames_top_k(spark, sf_dir):
    from pyspark.sql import Window

    got = relations.stride_sample(relations.first_groups(events(spark, sf_dir), "user_id", 20), "pos", 3)
    top = relations.top_per_group(got, "user_id", [F.desc("value"), "event_id"], 4)
    return top.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("k"))


@query(f"""
WITH {E}, s AS (SELECT user_id, first(pos ORDER BY value DESC, pos) AS best, max(value) AS score FROM e GROUP BY 1) SELECT user_id, best::INTEGER AS best, score FROM s""")
def best_start_frame(spark, sf_dir):
    return relations.best_start(events(spark, sf_dir), "user_id", "pos", F.col("value")).select("user_id", "best", "score")


@query("SELECT l_orderkey, l_linenumber::INTEGER AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def worst_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_extendedprice")
    return relations.worst_rows(rows.withColumn("tie", F.struct("l_orderkey", "l_linenumber")), "l_extendedprice", "tie", 25).drop("tie")


@query("""
SELECT 'l_returnflag' AS field, l_returnflag AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2""")
def value_counts(spark, sf_dir):
    return summaries.counts(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


FLAGS = "concat_ws('|', CASE WHEN value > 90 THEN 'bad_value' WHEN value > 50 THEN 'warn_value' END, CASE WHEN event_id % 7 = 0 THEN 'warn_seven' END)"


@query(f"""
WITH f AS (SELECT unnest(string_split({FLAGS}, '|')) AS item FROM events) SELECT item, count(*)::BIGINT AS n FROM f WHERE item <> '' GROUP BY item""")
def packed_flag_counts(spark, sf_dir):
    return summaries.packed_counts(load(spark, sf_dir, "events").withColumn("flags", F.expr(FLAGS)), "flags")


@query(f"""
WITH f AS (SELECT coalesce(nullif({FLAGS}, ''), 'ok') AS f FROM events)
SELECT count(*)::BIGINT AS rows, sum((f = 'ok')::INT)::BIGINT AS ok, sum(contains(f, 'bad_')::INT)::BIGINT AS bad, sum(contains(f, 'warn_')::INT)::BIGINT AS warn FROM f""")
def flag_level_counts(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("flags", F.coalesce(F.nullif(F.expr(FLAGS), F.lit("")), F.lit("ok")))
    return summaries.flag_levels(e, "flags")


@query("SELECT count(DISTINCT user_id)::BIGINT AS frames, min(user_id)::BIGINT AS first, max(user_id)::BIGINT AS last, round(count(DISTINCT user_id) / 1000.0, 4) AS ratio FROM events WHERE event_type = 'error'")
def frame_coverage(spark, sf_dir):
    got = summaries.coverage(load(spark, sf_dir, "events").filter("event_type = 'error'"), "user_id", 1000)
    return got.select("frames", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.round("ratio", 4).alias("ratio"))


@query("""
WITH v AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE embedding[3] > -0.1) SELECT label, round(median(x), 4) AS x, round(median(y), 4) AS y FROM v GROUP BY label""")
def component_medians(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("label", *[F.get("embedding", i).cast("double").alias(n) for i, n in enumerate("xyz")])
    e = e.withColumn("x", F.when(F.col("z") > -0.1, F.col("x")).otherwise(float("nan")))
    return summaries.component_medians(e, ["label"], ["x", "y"]).select("label", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""
WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY 1), d AS (SELECT user_id, median(abs(value - med)) AS mad FROM events JOIN m USING (user_id) GROUP BY 1)
SELECT user_id, round(any_value(med), 4) AS median, round(any_value(mad), 4) AS mad, count(*)::BIGINT AS inliers, round(avg(value) + 1e-9, 4) AS mean
FROM events JOIN m USING (user_id) JOIN d USING (user_id) WHERE abs(value - med) <= 1.5 * greatest(mad, 1e-6) GROUP BY user_id""")
def inlier_means(spark, sf_dir):
    got = summaries.inlier_mean(load(spark, sf_dir, "events"), ["user_id"], "value", 1.5)
    return got.select("user_id", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), "inliers", F.round(F.col("mean") + 1e-9, 4).alias("mean"))  # values have two places, so means can lie on a tie


@query("""
WITH p AS (SELECT user_id, count(v)::BIGINT AS count, median(v) AS median, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS spread, stddev_pop(v) AS std
  FROM (SELECT user_id, CASE WHEN value BETWEEN 5 AND 120 THEN value END AS v FROM events) GROUP BY 1)
SELECT user_id, count, round(median, 4) AS median, round(spread, 4) AS spread, round(std, 4) AS std, CASE WHEN count < 40 THEN 'too_few' WHEN spread > 60 THEN 'too_wide' ELSE 'ok' END AS status FROM p""")
def patch_reducers(spark, sf_dir):
    got = summaries.patch(load(spark, sf_dir, "events"), ["user_id"], "value", 5.0, 120.0, 40, 60.0)
    return got.select("user_id", "count", *[F.round(c, 4).alias(c) for c in ("median", "spread", "std")], "status")


@query("""
WITH m AS (SELECT user_id, median(value) AS med, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS spread FROM events GROUP BY 1)
SELECT user_id, count(*)::BIGINT AS count, round(sqrt(avg(pow(value - med, 2))), 4) AS rms, round(max(abs(value - med)), 4) AS max, round(any_value(spread), 4) AS spread FROM events JOIN m USING (user_id) GROUP BY user_id""")
def estimate_residuals(spark, sf_dir):
    got = summaries.residuals(load(spark, sf_dir, "events"), ["user_id"], "value")
    return got.select("user_id", "count", *[F.round(c, 4).alias(c) for c in ("rms", "max", "spread")])


@query("SELECT count(value)::BIGINT AS n, round(quantile_cont(value, 0.01) - 0.5, 4) AS low, round(quantile_cont(value, 0.99) + 0.5, 4) AS high FROM events")
def value_bounds(spark, sf_dir):
    return summaries.bounds(load(spark, sf_dir, "events"), "value", pad=0.5).select("n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("""
WITH d AS (SELECT event_type, value AS a, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 5 = 0 THEN NULL ELSE 100 - value END AS b FROM events), c AS (SELECT event_type, b - a AS d FROM d WHERE b IS NOT NULL)
SELECT event_type, count(*)::BIGINT AS pairs, sum((d < -1e-9)::INT)::BIGINT AS improved, sum((d > 1e-9)::INT)::BIGINT AS worse, sum((abs(d) <= 1e-9)::INT)::BIGINT AS unchanged,
  round(sum((d < -1e-9)::INT) / count(*), 4) AS improved_ratio, round(avg(d), 4) AS mean_change, round(median(d), 4) AS median_change FROM c GROUP BY event_type""")
def before_after_rollup(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("b", F.expr("CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 5 = 0 THEN double('nan') ELSE 100 - value END"))
    got = summaries.before_after(e, ["event_type"], "value", "b")
    return got.select("event_type", "pairs", "improved", "worse", "unchanged", *[F.round(c, 4).alias(c) for c in ("improved_ratio", "mean_change", "median_change")])


@query(f"""
WITH {E}, f AS (SELECT user_id, pos // 3 AS frame, max((event_type = 'view')::INT) AS a, max((event_type = 'click')::INT) AS b FROM e GROUP BY ALL),
s AS (SELECT user_id, sum(greatest(a, b))::BIGINT AS either, sum(a * b)::BIGINT AS in_both FROM f GROUP BY 1)
SELECT user_id, either, in_both, round(CASE WHEN either > 0 THEN in_both / either ELSE 0 END, 4) AS ratio, CASE WHEN either > 0 AND in_both / either >= 0.4 AND in_both >= 2 THEN 'model' ELSE 'interpolate' END AS method FROM s""")
def both_sides_ratio(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("frame", F.expr("pos div 3"))
    got = summaries.both_sides(e, "user_id", "frame", "event_type", ("view", "click"), 0.4)
    return got.select("user_id", F.col("either").cast("long").alias("either"), F.col("both").cast("long").alias("in_both"), F.round("ratio", 4).alias("ratio"), "method")


@query(f"""
WITH {E}, t AS (SELECT user_id, pos, epoch(ts) AS s FROM e), r AS (SELECT user_id, pos, s, s - lag(s) OVER (PARTITION BY user_id ORDER BY pos) AS d FROM t)
SELECT user_id, round(median(d), 3) AS per_step, max(pos)::INTEGER AS last_step, round(arg_max(s, pos), 3) AS last_elapsed FROM r GROUP BY user_id""")
def seconds_per_step(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    got = summaries.seconds_per_step(e, "user_id", "pos", "s")
    return got.select("user_id", F.round("per_step", 3).alias("per_step"), "last_step", F.round("last_elapsed", 3).alias("last_elapsed"))


@query(f"""
WITH {B}, p AS (SELECT l_orderkey, max(CASE WHEN candidate = 1 THEN x1 END) AS ax, max(CASE WHEN candidate = 1 THEN y1 END) AS ay, max(CASE WHEN candidate = 3 THEN x1 END) AS bx, max(CASE WHEN candidate = 3 THEN y1 END) AS bby FROM b GROUP BY 1)
SELECT l_orderkey, round(sqrt(pow(ax - bx, 2) + pow(ay - bby, 2)), 4) AS distance FROM p""")
def tip_distance(spark, sf_dir):
    got = summaries.pivot_distance(boxes(spark, sf_dir), ["l_orderkey"], "candidate", (1, 3), ["x1", "y1"])
    return got.select("l_orderkey", F.round("distance", 4).alias("distance"))
