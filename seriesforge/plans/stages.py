"""Queries of the gates: a user is a session, its events are the candidates of each stage.

What a session lacks depends on its number, so that over many of them every check fails somewhere; counts, shares and flags are measured
from the rows. The SQL adds the errors and warnings of each session up by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import stages
from seriesforge.plans.registry import B, boxes, events, query
from seriesforge.session import load

KEY = "session"
BAD = "user_id % 7 = 0 AND event_id % 4 = 0"
FLAG = "CASE WHEN user_id % 6 = 1 AND event_id % 5 = 0 THEN 'bad_jump' WHEN user_id % 4 = 1 AND event_id % 6 = 0 THEN 'warn_gap|warn_jump' ELSE 'ok' END"
PRESENT, QUALITY = "user_id % 17 > 0 AND NOT (user_id % 18 = 4 AND event_id % 16 = 0)", "user_id % 19 > 0 AND (user_id % 8 > 0 OR event_id % 3 > 0)"
SELECTED = "(event_type <> 'error' OR user_id % 2 = 1)"
INFILLED = "CASE WHEN user_id % 2 = 1 THEN {frame} < user_id % 3 ELSE event_type = 'signup' END"
#: Of a session's u and n: the columns of its summary.
SUMMARY = {"ok": "u % 11 > 0", "candidates": "CASE WHEN u % 29 = 1 THEN 0 WHEN u % 9 = 0 THEN n + 1 ELSE n END", "candidates_in": "n + CASE WHEN u % 9 = 0 THEN 1 ELSE 0 END",
           "candidates_out": "n - CASE WHEN u % 16 = 1 THEN 1 ELSE 0 END", "infilled_candidates": "u % 3", "fallback_ratio": "u % 10 / 10.0", "template_ratio": "u % 12 / 40.0",
           "enabled_by_default": "u % 14 = 1", "stride": "CASE WHEN u % 15 = 0 THEN 2 ELSE 1 END", "frames_exported": "CASE WHEN u % 22 = 1 THEN 0 ELSE n END"}
EXPECTED = "CASE WHEN u % 3 > 0 THEN n + CASE WHEN u % 10 = 0 THEN 5 ELSE 0 END END"
TOTAL = "n + CASE WHEN u % 12 = 2 THEN 1 ELSE 0 END"

P = f"""e AS (SELECT user_id AS u, user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events),
s AS (SELECT u, count(*) AS n FROM e GROUP BY u),
p AS (SELECT u, n, {EXPECTED} AS expected, u % 2 = 0 AS need_all, {TOTAL} AS total, u % 13 > 0 AS ran, CASE WHEN u % 5 = 0 THEN 2 ELSE 0 END AS se, CASE WHEN u % 4 = 0 THEN 1 ELSE 0 END AS sw,
  {', '.join(f'{v} AS {k}' for k, v in SUMMARY.items())} FROM s),
r AS (SELECT u, count(*) AS rows, sum(CASE WHEN {BAD} THEN 1 ELSE 0 END) AS odd, count(DISTINCT frame) AS frames, min(frame) AS lo, max(frame) AS hi, median(value / 200) AS valid,
  sum(CASE WHEN u % 21 = 1 AND event_id % 9 = 0 THEN 1 ELSE 0 END) AS missing, sum((contains({FLAG}, 'bad_'))::INT) AS bad, sum((contains({FLAG}, 'warn_'))::INT) AS warn,
  sum({SELECTED}::INT) AS selected, sum(({INFILLED.format(frame='frame')})::INT) AS infilled FROM e WHERE {PRESENT} GROUP BY u),
q AS (SELECT u, count(*) AS quality FROM e WHERE {QUALITY} GROUP BY u),
m AS (SELECT p.*, coalesce(rows, 0) AS rows, coalesce(odd, 0) AS odd, coalesce(bad, 0) AS bad, coalesce(warn, 0) AS warn, coalesce(quality, 0) AS quality,
  frames, lo, hi, coalesce(valid, 0) AS valid, missing, selected, infilled, coalesce(NOT need_all OR (frames = total AND lo = 0 AND hi = total - 1), false) AS covered
  FROM p LEFT JOIN r USING (u) LEFT JOIN q USING (u))"""


def _sql(e1: str, e2: str, e5: str, w5: str, w1: str = "sw", ran: str = "ran", more: str = "") -> str:
    """Errors of the summary (e1), of tables (e2) and, where there are none, of what they hold (e5); warnings likewise."""
    return f"""
WITH {P}{more}, c AS (SELECT u, {ran} AS ran, ({e1})::BIGINT AS e1, ({e2})::BIGINT AS e2, ({e5})::BIGINT AS e5, ({w1})::BIGINT AS w1, ({w5})::BIGINT AS w5 FROM m),
t AS (SELECT u, ran, CASE WHEN ran THEN e1 + e2 + CASE WHEN e1 + e2 = 0 THEN e5 ELSE 0 END ELSE 0 END AS errors,
  CASE WHEN ran THEN w1 + CASE WHEN e1 + e2 = 0 THEN w5 ELSE 0 END ELSE 1 END AS warnings FROM c)
SELECT u AS session, errors, warnings, CASE WHEN errors = 0 THEN 0 ELSE 2 END AS exit_code FROM t"""


E1 = "se + (NOT ok)::INT"
ASKED = "(expected > 0 AND candidates <> expected)::INT"
AWAY = "CASE WHEN rows = 0 OR quality = 0 THEN 1 ELSE 0 END"
COUNT = "coalesce((expected > 0 AND rows <> expected)::INT, 0)"
FLAGGED = "(bad > 0)::INT + (warn > 0)::INT"


def _inputs(spark, sf_dir):
    """sessions (with expected, need_all, total_frames), summaries, rows and quality rows."""
    e = events(spark, sf_dir).withColumn("frame_index", F.col("pos") - 1).withColumn(KEY, F.col("user_id"))
    per = e.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("u", F.col("user_id"))
    sessions = per.selectExpr(f"u AS {KEY}", f"{EXPECTED} AS expected", "u % 2 = 0 AS need_all", f"{TOTAL} AS total_frames")
    lists = ["CASE WHEN u % 5 = 0 THEN array('a', 'b') END AS hard_errors", "CASE WHEN u % 4 = 0 THEN array('w') ELSE array() END AS warnings"]
    summary = per.filter("u % 13 > 0").selectExpr(f"u AS {KEY}", *[f"{v} AS {k}" for k, v in SUMMARY.items()], *lists)
    return sessions, stages.summarised(sessions, KEY, summary), e.filter(PRESENT), e.filter(QUALITY)


def _stage(rows, gate: str, flag: str):
    """rows with every column that the gate asks for; those that must be finite hold NaN where BAD."""
    own = {c: F.lit(0) for c in stages.REQUIRED[gate] if c not in rows.columns}
    own |= {c: F.array(F.col("value"), F.when(F.expr(BAD), float("nan")).otherwise(1.0)) for c in stages.FINITE[gate]}
    return rows.withColumns(own | {flag: F.expr(FLAG)})


def _judged(measures, gate: str):
    return stages.report(stages.lines(measures, KEY, gate, stages.GATES[gate]), KEY).select(KEY, "errors", "warnings", "exit_code")


def measures_of(spark, sf_dir, gate: str):
    """The measures of one of the gates E, F0, F1, F, G and H."""
    _, sessions, rows, quality = _inputs(spark, sf_dir)
    flag = {"E": "qc_flag", "F0": "depth_smooth_qc_flag", "F1": "motion_infiller_qc_flag", "F": "mano_smoothing_qc_flag", "G": "mano_visibility_qc_flag", "H": "visibility_realign_qc_flag"}[gate]
    more = {"E": {"selected": F.sum(F.expr(SELECTED).cast("long"))}, "F1": {"infilled": F.sum(F.expr(INFILLED.format(frame="frame_index")).cast("long"))}}.get(gate, {})
    m = stages.stage_measures(sessions, KEY, _stage(rows, gate, flag), stages.REQUIRED[gate], stages.FINITE[gate], flag, **more)
    m = stages.counted(m, KEY, "quality_rows", quality)
    if gate == "F0":
        m = stages.counted(m, KEY, "track_rows", quality.filter("user_id % 20 > 1").select(KEY, "event_type").distinct())
    if gate == "G":
        joints = quality.withColumn("joint", F.explode(F.sequence(F.lit(0), F.lit(20)))).filter("NOT (user_id % 26 = 1 AND joint = 7)")
        m = stages.counted(m, KEY, "joint_rows", joints)
    return m


@query(_sql(f"{E1} + (candidates <= 0)::INT", AWAY,
            "3 * (odd > 0)::INT + (selected <> candidates)::INT + coalesce((need_all AND expected > 0 AND (rows <> expected OR candidates <> expected))::INT, 0) + (quality <> candidates)::INT",
            "(bad > 0)::INT + (fallback_ratio > 0.5)::INT"))
def gate_alignment(spark, sf_dir):
    return _judged(measures_of(spark, sf_dir, "E"), "E")


@query(_sql(f"{E1} + coalesce({ASKED}, 0)", "CASE WHEN rows = 0 THEN 1 ELSE (quality = 0)::INT + (quality = 0 OR u % 20 <= 1)::INT END", f"{COUNT} + 3 * (odd > 0)::INT + (quality <> rows)::INT", FLAGGED))
def gate_depth_smooth(spark, sf_dir):
    return _judged(measures_of(spark, sf_dir, "F0"), "F0")


@query(_sql(f"{E1} + coalesce((expected > 0 AND candidates_in <> expected)::INT, 0) + (candidates_out < candidates_in)::INT", AWAY,
            "(rows <> candidates_out)::INT + 3 * (odd > 0)::INT + (infilled <> infilled_candidates)::INT + (quality <> rows)::INT", FLAGGED))
def gate_infill(spark, sf_dir):
    return _judged(measures_of(spark, sf_dir, "F1"), "F1")


@query(_sql(f"{E1} + coalesce({ASKED}, 0)", AWAY, f"{COUNT} + 5 * (odd > 0)::INT + (quality <> rows)::INT", FLAGGED))
def gate_temporal_smooth(spark, sf_dir):
    return _judged(measures_of(spark, sf_dir, "F"), "F")


@query(_sql(f"{E1} + coalesce({ASKED}, 0)", "CASE WHEN rows = 0 THEN 1 ELSE 2 * (quality = 0)::INT END", f"{COUNT} + (quality <> rows)::INT + (quality * CASE WHEN u % 26 = 1 THEN 20 ELSE 21 END <> 21 * rows)::INT", FLAGGED))
def gate_visibility(spark, sf_dir):
    return _judged(measures_of(spark, sf_dir, "G"), "G")


@query(_sql(f"{E1} + coalesce({ASKED}, 0)", AWAY, f"{COUNT} + 3 * (odd > 0)::INT + (quality <> rows)::INT", FLAGGED, "sw + (enabled_by_default)::INT"))
def gate_realign(spark, sf_dir):
    return _judged(measures_of(spark, sf_dir, "H"), "H")


def depth_measures(spark, sf_dir):
    _, sessions, rows, _ = _inputs(spark, sf_dir)
    manifest = rows.withColumn("ratio", F.col("value") / 200).withColumn("exists", F.expr("NOT (user_id % 21 = 1 AND event_id % 9 = 0)"))
    return stages.manifest_measures(sessions, KEY, manifest, "frame_index", "ratio", "exists")


@query(f"""
WITH {P}, c AS (SELECT u, ran, (frames_exported <= 0)::BIGINT AS e1, rows = 0 AS away,
  (missing > 0)::INT + (valid < 0.05)::INT + (need_all AND stride <> 1)::INT + (NOT covered)::INT AS e3, (valid >= 0.05 AND valid < 0.15)::INT AS w3 FROM m),
t AS (SELECT u, CASE WHEN NOT ran THEN 1 WHEN away THEN e1 + 1 ELSE e1 + e3 END AS errors, CASE WHEN NOT ran OR away THEN 0 ELSE w3 END AS warnings FROM c)
SELECT u AS session, errors, warnings::BIGINT AS warnings, CASE WHEN errors = 0 THEN 0 ELSE 2 END AS exit_code FROM t""")
def gate_depth(spark, sf_dir):
    return _judged(depth_measures(spark, sf_dir), "D")


def stabilised_measures(spark, sf_dir):
    m = stages.counted(depth_measures(spark, sf_dir), KEY, "quality_rows", _inputs(spark, sf_dir)[3])
    flags = _inputs(spark, sf_dir)[2].groupBy(KEY).agg(F.sum(F.contains(F.expr(FLAG), F.lit("warn_")).cast("long")).alias("warn_flags"))
    return m.join(flags, KEY, "left")


@query(f"""
WITH {P}, c AS (SELECT u, ran, sw, se + (NOT ok)::INT + (template_ratio < 0.1)::INT AS e1, rows = 0 AS away, quality = 0 AS bare, (missing > 0)::INT + (quality <> rows)::INT + (NOT covered)::INT AS e4, (warn > 0)::INT AS w4 FROM m),
t AS (SELECT u, CASE WHEN NOT ran THEN 0 WHEN away OR bare THEN e1 + 1 ELSE e1 + e4 END::BIGINT AS errors, CASE WHEN NOT ran THEN 1 WHEN away OR bare THEN sw ELSE sw + w4 END::BIGINT AS warnings FROM c)
SELECT u AS session, errors, warnings, CASE WHEN errors = 0 THEN 0 ELSE 2 END AS exit_code FROM t""")
def gate_stabilised_depth(spark, sf_dir):
    return _judged(stabilised_measures(spark, sf_dir), "D1")


def input_measures(spark, sf_dir):
    sessions, _, rows, _ = _inputs(spark, sf_dir)
    per = rows.groupBy(KEY).agg(F.count("*").alias("n"))
    side = lambda s, opened, frames, width: per.selectExpr(KEY, f"'{s}' AS side", f"{opened} AS opened", f"{frames} AS frames", f"{width} AS width", "480 AS height")
    videos = side("left", "session % 23 > 0", "n", "640").unionByName(side("right", "session % 20 > 0", "n + CASE WHEN session % 6 = 0 THEN 1 ELSE 0 END", "640 + CASE WHEN session % 8 = 1 THEN 2 ELSE 0 END"))
    metadata = per.filter("session % 10 > 0").selectExpr(KEY, "640 AS crop_width", "480 + CASE WHEN session % 9 = 0 THEN 1 ELSE 0 END AS crop_height")
    return stages.video_measures(sessions, KEY, videos, metadata, per.filter("session % 12 > 0"), per.filter("session % 4 > 0"))


@query(f"""
WITH {P}, c AS (SELECT u, rows = 0 AS away, (u % 23 = 0)::INT + (u % 20 = 0)::INT AS e1, (u % 6 = 0)::INT + (u % 8 = 1)::INT + (u % 10 = 0)::INT + (u % 10 > 0 AND u % 9 = 0)::INT + (u % 12 = 0)::INT AS e3, (u % 4 = 0)::INT AS w FROM m),
t AS (SELECT u, CASE WHEN away THEN 2 WHEN e1 > 0 THEN e1 ELSE e3 END::BIGINT AS errors, CASE WHEN away OR e1 > 0 THEN 0 ELSE w END::BIGINT AS warnings FROM c)
SELECT u AS session, errors, warnings, CASE WHEN errors = 0 THEN 0 ELSE 2 END AS exit_code FROM t""")
def gate_inputs(spark, sf_dir):
    return _judged(input_measures(spark, sf_dir), "A")


def candidate_measures(spark, sf_dir):
    """Sessions of 64 orders; an order is a frame, its lines are candidates with boxes."""
    b = boxes(spark, sf_dir).withColumn(KEY, F.expr("l_orderkey div 64"))
    sessions = b.select(KEY).distinct()
    rows = b.filter("session % 9 > 0")
    own = {c: F.lit(0) for c in stages.REQUIRED["B"]} | {c: F.array(F.when(F.expr("session % 5 = 0 AND candidate = 3"), float("nan")).otherwise(F.col("x1"))) for c in stages.FINITE["B"]}
    m = stages.stage_measures(sessions, KEY, rows.withColumns(own), stages.REQUIRED["B"], stages.FINITE["B"])
    return stages.overlap_measures(m, KEY, rows, "l_orderkey", "candidate", "l_returnflag", ["x1", "y1", "x2", "y2"])


@query(f"""
WITH {B}, k AS (SELECT *, l_orderkey // 64 AS session FROM b), s AS (SELECT session, session % 9 > 0 AS there, max((session % 5 = 0 AND candidate = 3)::INT) AS odd FROM k GROUP BY session),
o AS (SELECT x.session, count(*) AS n FROM k x JOIN k y ON x.l_orderkey = y.l_orderkey AND x.l_returnflag = y.l_returnflag AND x.candidate < y.candidate
  WHERE greatest(0, least(x.x2, y.x2) - greatest(x.x1, y.x1)) * greatest(0, least(x.y2, y.y2) - greatest(x.y1, y.y1)) / (400 - greatest(0, least(x.x2, y.x2) - greatest(x.x1, y.x1)) * greatest(0, least(x.y2, y.y2) - greatest(x.y1, y.y1))) > 0.3 GROUP BY 1),
t AS (SELECT session, CASE WHEN NOT there THEN 1 ELSE 7 * odd + (coalesce(n, 0) > 0)::INT END::BIGINT AS errors FROM s LEFT JOIN o USING (session))
SELECT session, errors, 0::BIGINT AS warnings, CASE WHEN errors = 0 THEN 0 ELSE 2 END AS exit_code FROM t""")
def gate_candidates(spark, sf_dir):
    return _judged(candidate_measures(spark, sf_dir), "B")


MEASURES = {"A": input_measures, "B": candidate_measures, "D": depth_measures, "D1": stabilised_measures} | {
    g: (lambda spark, sf_dir, g=g: measures_of(spark, sf_dir, g)) for g in ("E", "F0", "F1", "F", "G", "H")}


C = """c AS (SELECT vec_id, label, embedding[1]::DOUBLE * 400 AS x, embedding[2]::DOUBLE * 400 AS y, embedding[3]::DOUBLE * 200 AS w, embedding[4]::DOUBLE AS z, embedding FROM embeddings),
f AS (SELECT *, concat_ws(';', CASE WHEN NOT z > 0 THEN 'non_positive_cam_t_z' END,
    CASE WHEN NOT w > 0 THEN 'invalid_bbox' WHEN NOT (x + w >= -16 AND x <= 64 + 16 AND y + w >= -12 AND y <= 48 + 12) THEN 'bbox_out_of_image_range' END,
    CASE WHEN vec_id % 11 = 0 THEN 'non_finite_joints_cam' END, CASE WHEN vec_id % 13 = 0 THEN 'non_finite_vertices_cam' END) AS hard,
  (SELECT count(*) FROM range(10) r(i) WHERE 32 + 150 * embedding[5 + 2 * i]::DOUBLE >= 0 AND 32 + 150 * embedding[5 + 2 * i]::DOUBLE < 64
    AND 24 + 150 * embedding[6 + 2 * i]::DOUBLE >= 0 AND 24 + 150 * embedding[6 + 2 * i]::DOUBLE < 48) / 10.0 AS inside FROM c)"""


def _checked(spark, sf_dir):
    at = lambda i, k: k * F.get("embedding", i).cast("double")
    uv = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((32 + at(4 + 2 * i, 150)).alias("u"), (24 + at(5 + 2 * i, 150)).alias("v")))
    odd = lambda n: F.array(F.when(F.expr(f"vec_id % {n} = 0"), float("inf")).otherwise(1.0))
    df = load(spark, sf_dir, "embeddings").select("vec_id", "label", at(0, 400).alias("x1"), at(1, 400).alias("y1"), at(2, 200).alias("w"), at(3, 1).alias("z"), uv.alias("uv"), odd(11).alias("joints"), odd(13).alias("vertices"))
    df = df.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("w"))
    return stages.candidate_faults(df, ["x1", "y1", "x2", "y2"], "uv", "z", "joints", "vertices", F.lit(64), F.lit(48))


@query(f"WITH {C} SELECT vec_id, hard AS hard_reasons, CASE WHEN inside < 0.35 THEN 'low_uv_in_image_ratio' ELSE '' END AS warning_reasons, round(inside, 4) AS inside FROM f")
def candidate_faults(spark, sf_dir):
    return _checked(spark, sf_dir).select("vec_id", "hard_reasons", "warning_reasons", F.round("uv_in_image_ratio", 4).alias("inside"))


@query(f"""
WITH {C} SELECT label, count(*)::BIGINT AS candidates, count(DISTINCT vec_id // 2)::BIGINT AS frames, count(DISTINCT vec_id % 3)::BIGINT AS tracks, round(min(z), 6) AS least_z, round(median(z), 6) AS median_z, round(max(z), 6) AS greatest_z,
  sum((z > 0)::INT)::BIGINT AS positive_z, sum((hard <> '')::INT)::BIGINT AS hard_errors, sum((inside < 0.35)::INT)::BIGINT AS warnings FROM f GROUP BY label""")
def stage_summary(spark, sf_dir):
    df = _checked(spark, sf_dir).withColumn("frame", F.expr("vec_id div 2")).withColumn("track", F.expr("vec_id % 3"))
    got = stages.stage_summary(df, ["label"], "frame", "track", "z")
    return got.withColumns({c: F.round(c, 6) for c in ("least_z", "median_z", "greatest_z")})


@query(f"""
WITH {C}, b AS (SELECT label, vec_id // 2 AS frame, hard, vec_id % 3 AS track FROM f WHERE hard <> ''),
i AS (SELECT label, frame, 'hard' AS field, unnest(string_split(replace(hard, ';', '|'), '|')) AS value FROM b UNION ALL SELECT label, frame, 'track', track::VARCHAR FROM b)
SELECT label, field, value, count(*)::BIGINT AS rows, count(DISTINCT frame)::BIGINT AS frames FROM i GROUP BY ALL""")
def fault_review(spark, sf_dir):
    df = _checked(spark, sf_dir).withColumn("hard", F.replace("hard_reasons", F.lit(";"), F.lit("|"))).withColumn("frame", F.expr("vec_id div 2")).withColumn("track", F.expr("vec_id % 3"))
    return stages.review(df, ["label"], F.col("hard_error") == 1, "frame", ["hard", "track"])
