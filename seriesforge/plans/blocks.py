"""Queries of long series in blocks, each with the SQL of the plain window; and of phases painted over one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import blocks, relations, series
from seriesforge.plans.registry import E, events, query
from seriesforge.session import load

#: Events of this many microseconds share a slot when places are counted; rows of a block.
SLOT, ROWS = 6 * 3600 * 10**6, 64


def numbered(spark, sf_dir):
    """Events with their place in the user's series, and value and trust; no task needs to hold a user."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return blocks.numbered(e, "user_id", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / SLOT)


@query(f"WITH {E} SELECT event_id, user_id, pos FROM e")
def series_places(spark, sf_dir):
    return numbered(spark, sf_dir).select("event_id", "user_id", "pos")


@query(f"""
WITH {E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e), w AS (SELECT *, least(6, n) AS w FROM n),
x AS (SELECT event_id, user_id, n, w, unnest(generate_series(pos - w // 2, pos - w // 2 + w - 1)) AS p FROM w)
SELECT x.event_id, round(sum(v.value) / max(x.w), 4) AS average FROM x JOIN e v ON v.user_id = x.user_id AND v.pos = least(greatest(p, 1), x.n) GROUP BY x.event_id""")
def moving_average_in_blocks(spark, sf_dir):
    got = blocks.in_blocks(numbered(spark, sf_dir), "user_id", "pos", lambda d, k, o: series.moving_average(d, k, o, "value", 6), halo=6, rows=ROWS)
    return got.select("event_id", F.round("average", 4).alias("average"))


@query(f"""
WITH {E}, w AS (SELECT event_id, value, median(value) OVER x AS med, list(value) OVER x AS near FROM e
  WINDOW x AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
m AS (SELECT *, list_aggregate(list_transform(near, lambda x: abs(x - med)), 'median') AS mad FROM w)
SELECT event_id, round(med, 4) AS med, round(mad, 4) AS mad, (len(near) >= 3 AND abs(value - med) > 5 * (mad + 1e-6))::INTEGER AS outlier FROM m""")
def rolling_mad_in_blocks(spark, sf_dir):
    got = blocks.in_blocks(numbered(spark, sf_dir), "user_id", "pos", lambda d, k, o: series.rolling_mad_outliers(d, k, o, "value"), halo=5, rows=ROWS)
    return got.select("event_id", F.round("med", 4).alias("med"), F.round("mad", 4).alias("mad"), "outlier")


@query(f"""
WITH {E}, t AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS t FROM e)
SELECT a.event_id, round(CASE WHEN sum(b.t * exp(-0.5 * pow((b.pos - a.pos) / 2.0, 2))) > 1e-12
  THEN sum(b.t * exp(-0.5 * pow((b.pos - a.pos) / 2.0, 2)) * b.value) / sum(b.t * exp(-0.5 * pow((b.pos - a.pos) / 2.0, 2))) ELSE any_value(a.value) END, 4) AS smooth
FROM t a JOIN t b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 6 AND a.pos + 6 GROUP BY a.event_id""")
def gaussian_in_blocks(spark, sf_dir):
    e = numbered(spark, sf_dir).withColumn("t", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0))
    got = blocks.in_blocks(e, "user_id", "pos", lambda d, k, o: series.gaussian_smooth(d, k, o, "value", "t", 2.0), halo=6, rows=ROWS)
    return got.select("event_id", F.round("smooth", 4).alias("smooth"))


@query(f"""
WITH {E}, p AS (SELECT user_id, event_id AS o, event_type AS name, pos - 2 AS a, pos + (event_id % 11) - 1 AS b FROM e WHERE event_id % 3 = 0)
SELECT e.event_id, coalesce(arg_max(p.name, p.o), 'unknown') AS phase FROM e LEFT JOIN p ON p.user_id = e.user_id AND e.pos BETWEEN p.a AND p.b GROUP BY e.event_id""")
def overlapping_phases(spark, sf_dir):
    e = events(spark, sf_dir)
    phases = e.filter("event_id % 3 = 0").selectExpr("user_id", "event_id AS o", "event_type AS phase", "pos - 2 AS first", "pos + event_id % 11 - 1 AS last")
    return relations.painted_phases(e.drop("event_type"), phases, "user_id", "pos", "phase", "o").select("event_id", "phase")
