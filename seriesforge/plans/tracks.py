"""Queries of the track and series operators: users are tracks, event types labels, values places and weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import box_iou
from seriesforge.operators import matching, relations, series, tracks
from seriesforge.plans.registry import B, E, boxes, events, query


@query(f"""
WITH {E}, v AS (SELECT user_id, lower(event_type) AS l, sum(greatest(0.01, value)) AS w, min(pos) AS f FROM e GROUP BY ALL),
m AS (SELECT user_id, first(l ORDER BY round(w, 6) DESC, f) AS majority FROM v GROUP BY user_id)
SELECT event_id, majority, (event_type <> majority)::INTEGER AS relabelled, round(CASE WHEN event_type <> majority THEN -value ELSE value END, 4) AS x
FROM e JOIN m USING (user_id)""")
def track_majority_relabel(spark, sf_dir):
    got = tracks.vote(events(spark, sf_dir), "user_id", "event_type", F.greatest(F.lit(0.01), F.col("value")), "pos")
    got = tracks.mirror_where(got.withColumn("x", F.col("value")), F.col("relabelled") == 1, ["x"])
    return got.select("event_id", F.col("majority_label").alias("majority"), "relabelled", F.round("x", 4).alias("x"))


@query(f"""
WITH {E}, s AS (SELECT user_id, event_type, count(*)::BIGINT AS rows, count(DISTINCT pos)::BIGINT AS frames, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last FROM e GROUP BY ALL),
d AS (SELECT event_type, first(user_id ORDER BY rows DESC, user_id) AS dominant FROM s GROUP BY event_type)
SELECT user_id, event_type, rows, frames, first, last, last - first + 1 AS duration, (user_id = dominant)::INTEGER AS dominant FROM s JOIN d USING (event_type)""")
def track_summaries(spark, sf_dir):
    got = tracks.track_summary(events(spark, sf_dir), "user_id", "pos", "event_type")
    best = tracks.dominant(got, "event_type", "rows", "user_id")
    return got.join(best, "event_type").select("user_id", "event_type", "rows", "frames", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"),
                                               "duration", (F.col("user_id") == F.col("dominant")).cast("int").alias("dominant"))


@query(f"""
WITH {E}, r AS (SELECT user_id, user_id % 3 AS side, value AS x, (event_id % 11) / 10.0 AS y, CASE WHEN event_id % 9 = 0 THEN 0.05 ELSE 1 + (event_id % 5) / 10.0 END AS depth, value * 10 + user_id % 7 AS area FROM e),
p AS (SELECT user_id, side, count(*) AS n, median(x) AS x, median(y) AS y, median(CASE WHEN depth > 0.1 AND area > 0 THEN area / (depth * depth) END) AS size FROM r GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, user_id) AS k FROM p)
SELECT a.user_id, a.n::BIGINT AS rows, CASE WHEN a.n < 40 THEN 'short_track' WHEN a.user_id = m.user_id OR a.n >= m.n * 0.9 THEN NULL
  WHEN sqrt(pow(a.x - m.x, 2) + pow(a.y - m.y, 2)) > 8 THEN 'position_outlier'
  WHEN m.size > 1e-9 AND (a.size / m.size > 1.1 OR a.size / m.size < 1 / 1.1) THEN 'size_outlier' END AS reason
FROM q a JOIN q m ON a.side = m.side AND m.k = 1""")
def track_filter(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("side", F.col("user_id") % 3).withColumn("y", F.expr("event_id % 11 / 10.0D")).withColumn(
        "depth", F.expr("IF(event_id % 9 = 0, 0.05D, 1 + event_id % 5 / 10.0D)")).withColumn("area", F.expr("value * 10 + user_id % 7"))
    got = tracks.filter_tracks(e, "user_id", "side", ["value", "y"], "depth", "area", least=40, relative=0.9, distance=8.0, ratio=1.1)
    return got.select("user_id", "rows", F.col("filter_reason").alias("reason"))


@query(f"""
WITH {E}, r AS (SELECT event_id, user_id, pos + (pos // 10) * 5 AS frame, value / 100 AS x, (event_id % 13) / 100.0 AS y FROM e),
s AS (SELECT *, frame - lag(frame) OVER w AS dp, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS prev,
  sqrt(pow(lead(x) OVER w - lag(x) OVER w, 2) + pow(lead(y) OVER w - lag(y) OVER w, 2)) AS skip FROM r WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
t AS (SELECT *, lead(dp) OVER w AS dn, lead(prev) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
m AS (SELECT *, median(CASE WHEN dp <= 3 THEN prev END) OVER (PARTITION BY user_id) AS med FROM t),
l AS (SELECT *, greatest(0.08, 1.5 * med) AS lim FROM m)
SELECT event_id, coalesce(dp <= 3 AND dn <= 3 AND prev > lim AND nxt > lim AND skip < 0.75 * lim, false)::INTEGER AS spike,
  round(CASE WHEN coalesce(dp <= 3 AND dn <= 3 AND prev > lim AND nxt > lim AND skip < 0.75 * lim, false) THEN greatest(prev, nxt) END, 4) AS distance FROM l""")
def track_spikes(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("frame", F.expr("pos + pos div 10 * 5")).withColumn("x", F.col("value") / 100).withColumn("y", F.expr("event_id % 13 / 100.0D"))
    got = tracks.spikes(e, "user_id", "frame", ["x", "y"], factor=1.5)
    return got.select("event_id", "spike", F.round("spike_distance", 4).alias("distance"))


@query(f"""
WITH {B}, n AS (SELECT l_returnflag, count(*) AS length FROM b GROUP BY 1),
r AS (SELECT b.*, length, row_number() OVER (PARTITION BY l_orderkey ORDER BY length DESC, confidence DESC, candidate) AS k FROM b JOIN n USING (l_returnflag))
SELECT l_orderkey, candidate::INTEGER AS candidate, l_returnflag FROM r WHERE k = 1""")
def best_candidate_per_frame(spark, sf_dir):
    b = boxes(spark, sf_dir)
    got = relations.lookup(b, b.groupBy("l_returnflag").agg(F.count("*").alias("length")), ["l_returnflag"], {"length": 0})
    return tracks.best_candidate(got, "l_orderkey", "length", "confidence", "candidate").select("l_orderkey", "candidate", "l_returnflag")


@query(f"""
WITH {E}, h AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM e)
SELECT h.event_id, CASE WHEN h.pos - p <= 1 THEN g.event_id END::DOUBLE AS from_event, CASE WHEN h.pos - p <= 1 THEN g.value END AS held, (h.pos - p)::DOUBLE AS hold_age,
  CASE WHEN p IS NULL THEN 'none_before' WHEN h.pos = p THEN 'ok' WHEN h.pos - p <= 1 THEN 'held' ELSE 'stale' END AS reason, 0 AS rank
FROM h LEFT JOIN e g ON g.user_id = h.user_id AND g.pos = p""")
def held_rows_with_reason(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("from_event", F.col("event_id")).withColumn("held", F.col("value"))
    return tracks.held_rows(e, "user_id", "pos", F.col("event_type") != "error", ["from_event", "held"], 1).select(
        "event_id", F.col("from_event").cast("double").alias("from_event"), "held", F.col("hold_age").cast("double").alias("hold_age"), "reason", "rank")


@query(f"""
WITH {E}, s AS (SELECT event_id, user_id, pos, value, (event_id % 10) / 10.0 AS y, epoch(ts) AS t FROM e)
SELECT event_id, round(sqrt(pow(value - lag(value) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 4) AS step, (row_number() OVER w - 1)::INTEGER AS place,
  round(t - min(t) OVER (PARTITION BY user_id), 3) AS since FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)""")
def vector_jump_and_place(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("y", F.expr("event_id % 10 / 10.0D")).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = series.over("user_id", "pos")
    return e.select("event_id", F.round(series.vector_jump([F.col("value"), F.col("y")], w), 4).alias("step"),
                    series.rank_in("user_id", "pos").alias("place"), F.round(series.rebased("t", "user_id"), 3).alias("since"))


@query(f"""
WITH {E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e), w AS (SELECT *, least(6, n) AS w FROM n),
x AS (SELECT event_id, user_id, n, w, unnest(generate_series(pos - w // 2, pos - w // 2 + w - 1)) AS p FROM w)
SELECT x.event_id, round(sum(v.value) / max(x.w), 4) AS average FROM x JOIN e v ON v.user_id = x.user_id AND v.pos = least(greatest(p, 1), x.n) GROUP BY x.event_id""")
def moving_average_edges(spark, sf_dir):
    return series.moving_average(events(spark, sf_dir), "user_id", "pos", "value", 6).select("event_id", F.round("average", 4).alias("average"))


@query(f"""
WITH {E}, s AS (SELECT event_id, user_id, pos, value AS x, (event_id % 10) / 10.0 AS y, pos + (pos // 4) * 0.5 AS t, CASE WHEN user_id % 2 = 0 AND pos % 3 > 0 THEN value / 7 END AS m FROM e),
d AS (SELECT *, count(*) OVER u AS n, count(m) OVER u AS have, median(m) OVER u AS med,
  sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / (t - lag(t) OVER w) AS v FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos), u AS (PARTITION BY user_id))
SELECT event_id, round(CASE WHEN have >= greatest(3, floor(n * 0.5)) THEN coalesce(m, med) WHEN pos = 1 THEN coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY pos), 0) ELSE v END, 4) AS speed FROM d""")
def speed_estimate(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", F.col("value")).withColumn("y", F.expr("event_id % 10 / 10.0D")).withColumn("t", F.expr("pos + pos div 4 * 0.5D")).withColumn(
        "m", F.expr("IF(user_id % 2 = 0 AND pos % 3 > 0, value / 7, NULL)"))
    return series.speed(e, "user_id", "t", ["x", "y"], "m").select("event_id", F.round("speed", 4).alias("speed"))


@query(f"""
WITH {E}, s AS (SELECT *, (event_id % 10) / 10.0 AS y FROM e)
SELECT event_id, round(median(value) OVER w, 4) AS x, round(median(y) OVER w, 4) AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def rolling_median_place(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("y", F.expr("event_id % 10 / 10.0D"))
    got = series.rolling_median(e, "user_id", "pos", ["value", "y"])
    return got.select("event_id", F.round("value_median", 4).alias("x"), F.round("y_median", 4).alias("y"))


@query(f"""
WITH {E}, m AS (SELECT event_id, user_id, pos, pos + (pos // 10) * 5 AS frame, event_type = 'error' OR event_id % 4 = 0 AS bad FROM e),
b AS (SELECT *, max(CASE WHEN bad THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
  min(CASE WHEN bad THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM m)
SELECT b.event_id, (b.bad OR coalesce(pb - pa - 1 <= 2 AND y.frame - x.frame - 1 <= 2, false))::INTEGER AS bridged
FROM b LEFT JOIN m x ON x.user_id = b.user_id AND x.pos = pa LEFT JOIN m y ON y.user_id = b.user_id AND y.pos = pb""")
def bridge_short_gaps(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("frame", F.expr("pos + pos div 10 * 5")).withColumn("bad", F.expr("event_type = 'error' OR event_id % 4 = 0"))
    return series.bridge_gaps(e, "user_id", "pos", "frame", "bad", 2).select("event_id", F.col("bridged").cast("int").alias("bridged"))


@query(f"""
WITH {E}, c AS (SELECT user_id, pos - 1 AS p, event_type IN ('purchase', 'view') AS c, count(*) OVER (PARTITION BY user_id) AS n,
  lag(event_type IN ('purchase', 'view')) OVER (PARTITION BY user_id ORDER BY pos) AS was FROM e),
k AS (SELECT *, min(CASE WHEN NOT was AND c THEN p END) OVER (PARTITION BY user_id) AS close_at FROM c)
SELECT user_id, any_value(close_at)::DOUBLE AS close_at, min(CASE WHEN was AND NOT c AND p >= greatest(close_at + 1, n // 3) THEN p END)::DOUBLE AS release_at FROM k GROUP BY user_id""")
def grip_transitions(spark, sf_dir):
    got = series.transitions(events(spark, sf_dir), "user_id", "pos", F.col("event_type").isin("purchase", "view"))
    return got.select("user_id", F.col("close_at").cast("double").alias("close_at"), F.col("release_at").cast("double").alias("release_at"))


@query(f"""
WITH {E}, k AS (SELECT event_id, user_id, pos, value, 50.0 + pos AS fill, event_type <> 'view' AS known FROM e),
b AS (SELECT *, max(CASE WHEN known THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
  min(CASE WHEN known THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM k)
SELECT b.event_id, round(CASE WHEN b.known THEN b.value ELSE b.fill + coalesce((x.value - x.fill) + (b.pos - pa) * 1.0 / (pb - pa) * ((y.value - y.fill) - (x.value - x.fill)), x.value - x.fill, y.value - y.fill, 0) END, 4) AS anchored
FROM b LEFT JOIN k x ON x.user_id = b.user_id AND x.pos = pa LEFT JOIN k y ON y.user_id = b.user_id AND y.pos = pb""")
def gap_anchor_ramp(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("fill", F.lit(50.0) + F.col("pos")).withColumn("known", F.col("event_type") != "view")
    return series.anchored(e, "user_id", "pos", "value", "fill", "known").select("event_id", F.round("anchored", 4).alias("anchored"))


@query(f"""
WITH {E}, k AS (SELECT user_id, pos, value FROM e WHERE event_type <> 'click'), r AS (SELECT user_id, unnest(generate_series(min(pos), max(pos))) AS pos FROM k GROUP BY user_id)
SELECT r.user_id, r.pos::INTEGER AS pos, k.value, CASE WHEN k.pos IS NULL THEN 'missing' ELSE 'observed' END AS reason FROM r LEFT JOIN k USING (user_id, pos)""")
def densify_series(spark, sf_dir):
    e = events(spark, sf_dir).filter("event_type <> 'click'").select("user_id", "pos", "value")
    return series.densified(e, "user_id", "pos").select("user_id", "pos", "value", "reason")


@query(f"""
WITH {E}, n AS (SELECT event_id, pos - 1 AS p FROM e), w AS (SELECT event_id, p, unnest(generate_series(0, p // 10)) AS win FROM n)
SELECT event_id, win::BIGINT AS win, (win = p // 10)::INTEGER AS last FROM w WHERE p - win * 10 < 14""")
def sliding_window_rows(spark, sf_dir):
    got = series.sliding_windows(events(spark, sf_dir), "user_id", "pos", 14, 10, "win")
    return got.select("event_id", "win", F.col("last").cast("int").alias("last"))


@query(f"""
WITH {E}, a AS (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM e)
SELECT event_id, round(greatest(-20, least(20, m - value)), 4) AS delta, (abs(m - value) > 20)::INTEGER AS clipped, round(value + greatest(-20, least(20, m - value)), 4) AS moved FROM a""")
def clipped_smoothing(spark, sf_dir):
    near = F.avg("value").over(Window.partitionBy("user_id").orderBy("pos").rowsBetween(-1, 1))
    got = series.clipped_delta(events(spark, sf_dir).withColumn("m", near), "value", "m", 20.0)
    return got.select("event_id", F.round("delta", 4).alias("delta"), "clipped", F.round("moved", 4).alias("moved"))


@query(f"""
WITH {E}, q AS (SELECT event_id, user_id, pos, cos(value / 40) AS w, sin(value / 40) AS x FROM e),
d AS (SELECT *, w * lag(w) OVER o + x * lag(x) OVER o AS dot FROM q WINDOW o AS (PARTITION BY user_id ORDER BY pos)),
f AS (SELECT *, sum(CASE WHEN dot < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) % 2 AS odd FROM d)
SELECT event_id, round(CASE WHEN odd = 1 THEN -w ELSE w END, 4) AS w, round(CASE WHEN odd = 1 THEN -x ELSE x END, 4) AS x FROM f""")
def quaternion_continuity(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("w", F.cos(F.col("value") / 40)).withColumn("x", F.sin(F.col("value") / 40)).withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    got = series.steady_signs(e, "user_id", "pos", ["w", "x", "y", "z"])
    return got.select("event_id", F.round("w", 4).alias("w"), F.round("x", 4).alias("x"))


@query(f"""
WITH RECURSIVE {B}, i AS (SELECT a.l_orderkey AS k, a.candidate AS a, b.candidate AS b,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i FROM b a JOIN b ON a.l_orderkey = b.l_orderkey),
near AS (SELECT k, a, list(b) AS bs FROM i WHERE i / (400 - i) > 0.3 GROUP BY k, a),
o AS (SELECT l_orderkey AS k, candidate AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, candidate) AS r FROM b),
s AS (SELECT o.k, o.c, o.r, n.bs FROM o JOIN near n ON n.k = o.k AND n.a = o.c),
g AS (SELECT k, 0::BIGINT AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT k FROM o)
  UNION ALL SELECT g.k, s.r, CASE WHEN len(list_intersect(s.bs, g.kept)) = 0 THEN list_append(g.kept, s.c) ELSE g.kept END FROM g JOIN s ON s.k = g.k AND s.r = g.r + 1),
f AS (SELECT k, arg_max(kept, r) AS kept FROM g GROUP BY k)
SELECT o.k AS l_orderkey, o.c::INTEGER AS candidate, (NOT list_contains(f.kept, o.c))::INTEGER AS dropped FROM o JOIN f USING (k)""")
def greedy_dedup(spark, sf_dir):
    return matching.greedy_dedup(boxes(spark, sf_dir), "l_orderkey", "candidate", "confidence")


@query(f"""
WITH RECURSIVE {B}, p AS (SELECT a.l_orderkey AS k, a.candidate AS i, b.candidate AS j,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS n, sqrt(pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2)) AS far
  FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.candidate < b.candidate),
s AS (SELECT k, i, j, row_number() OVER (PARTITION BY k ORDER BY i, j) AS r FROM p WHERE n / (400 - n) >= 0.3 OR far <= 3),
g AS (SELECT DISTINCT k, 0::BIGINT AS r, []::BIGINT[][] AS c FROM s
  UNION ALL SELECT g.k, s.r, CASE WHEN len(list_filter(g.c, lambda m: list_contains(m, s.i) OR list_contains(m, s.j))) = 0 THEN list_append(g.c, [s.i, s.j])
    ELSE list_transform(g.c, lambda m, n: CASE WHEN n = list_position(list_transform(g.c, lambda m: list_contains(m, s.i) OR list_contains(m, s.j)), true)
      THEN list_concat(m, list_filter([s.i, s.j], lambda x: NOT list_contains(m, x))) ELSE m END) END FROM g JOIN s ON s.k = g.k AND s.r = g.r + 1),
f AS (SELECT k, arg_max(c, r) AS c FROM g GROUP BY k), u AS (SELECT k, unnest(range(len(c))) AS n, unnest(c) AS m FROM f),
e AS (SELECT u.k, u.n, unnest(u.m) AS x, unnest(range(len(u.m))) AS w FROM u),
t AS (SELECT e.k, e.n, e.x, row_number() OVER (PARTITION BY e.k, e.n ORDER BY b.confidence DESC, e.w) AS place FROM e JOIN b ON b.l_orderkey = e.k AND b.candidate = e.x)
SELECT b.l_orderkey, b.candidate::INTEGER AS candidate, coalesce(max(t.n), -1)::INTEGER AS cluster, coalesce(max((t.place > 1)::INTEGER), 0) AS dropped
FROM b LEFT JOIN t ON t.k = b.l_orderkey AND t.x = b.candidate GROUP BY ALL""")
def duplicate_clusters(spark, sf_dir):
    return matching.mark_duplicates(boxes(spark, sf_dir), "l_orderkey", "candidate", "confidence", least=0.3, reach=3.0)


@query()
def frame_chain_tracker(spark, sf_dir):
    one = boxes(spark, sf_dir).withColumn("session", F.expr("l_orderkey div 64")).withColumnRenamed("l_orderkey", "frame")
    return matching.chain(one, "session", "frame", "candidate")


@query(f"""
WITH {B}, p AS (SELECT a.l_orderkey, a.candidate AS a, b.candidate AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i
  FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.candidate < b.candidate)
SELECT l_orderkey, round(max(i / (400 - i)), 4) AS most, count(*)::BIGINT AS pairs FROM p GROUP BY l_orderkey""")
def frame_overlap_summary(spark, sf_dir):
    got = relations.group_pairs(boxes(spark, sf_dir), ["l_orderkey"], "candidate", ["x1", "y1", "x2", "y2"], box_iou, "iou")
    return got.groupBy("l_orderkey").agg(F.round(F.max("iou"), 4).alias("most"), F.count("*").alias("pairs"))
