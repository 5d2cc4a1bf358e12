"""Queries of the quality flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import gates
from seriesforge.plans.registry import query
from seriesforge.session import load

# Measures of a row, the same in both dialects: value / 500 as metres, event_id for the rest.
ALIGN = "CASE WHEN event_id % 6 = 0 THEN 'depth_few_joints' ELSE 'depth_reliable_joints' END AS source, CASE WHEN event_id % 11 > 0 THEN value / 1000 END AS rms, CASE WHEN event_id % 5 > 0 THEN value / 500 END AS jump"
DEPTH = "CASE WHEN event_id % 6 = 0 THEN 'kept' ELSE 'depth_smooth_ok' END AS source, CASE WHEN event_id % 2 = 0 THEN -value / 500 ELSE value / 400 END AS delta, event_id % 3 AS clipped, value / 600 AS jump"
INFILL = "CASE WHEN event_id % 13 = 0 THEN 0.5 ELSE 1.0 END AS finite_share, value / 300 AS jump, event_id % 2 AS infilled, CASE WHEN event_id % 4 = 0 THEN 999 ELSE 3 END AS gap"
SMOOTH = "CASE WHEN event_id % 6 = 0 THEN 'copied' ELSE 'smoothed_mano_forward' END AS source, CASE WHEN event_id % 13 = 0 THEN 0.5 ELSE 1.0 END AS finite_share, value / 700 AS rms, value / 500 AS jump, CASE WHEN event_id % 7 > 0 THEN value / 2 END AS rot_delta, value * 0.9 AS raw_rot_jump, CASE WHEN event_id % 3 > 0 THEN value * 0.8 END AS rot_jump, event_id % 2 AS near_flip"
ANCHOR = "CASE WHEN event_id % 6 = 0 THEN 'no_anchor' ELSE 'anchor_lock_smooth_ok' END AS source, CASE WHEN event_id % 2 = 0 THEN -value / 500 ELSE value / 400 END AS delta, value / 600 AS jump"
SEEN = "event_id % 9 AS zbuffer, event_id % 5 AS reliable, CASE WHEN event_id % 4 > 0 THEN value / 300 END AS vertex_ratio"
REALIGN = "CASE WHEN event_id % 6 = 0 THEN 'keep_previous' WHEN event_id % 2 = 0 THEN 'visible_stable_joints' ELSE 'visible_reliable_joints' END AS source, event_id % 3 AS rejected, CASE WHEN event_id % 11 > 0 THEN value / 1000 END AS rms, value / 500 AS delta"
SCALE = "1 + (value - 50) / 300 AS scale, (value - 50) / 400 AS shift, CASE WHEN event_id % 5 > 0 THEN value END AS rmse_after, CASE WHEN event_id % 7 > 0 THEN 60.0 END AS rmse_before"


def _sql(measures: str, *cases: str) -> str:
    return f"""WITH m AS (SELECT event_id, {measures} FROM events) SELECT event_id, coalesce(nullif(concat_ws('|', {', '.join('CASE ' + c + ' END' for c in cases)}), ''), 'ok') AS flag FROM m"""


def _flags(spark, sf_dir, measures: str, stage: str):
    m = load(spark, sf_dir, "events").selectExpr("event_id", *[x.strip() for x in _columns(measures)])
    return m.select("event_id", gates.stage_flag(gates.STAGES[stage]).alias("flag"))


def _columns(text: str) -> list[str]:
    """The select list cut at commas (the measures hold none inside)."""
    return text.split(", ")


@query(_sql(ALIGN, "WHEN source <> 'depth_reliable_joints' THEN source", "WHEN rms IS NULL THEN 'missing_alignment_rms' WHEN rms > 0.08 THEN 'bad_alignment_rms' WHEN rms > 0.035 THEN 'warn_alignment_rms'",
            "WHEN jump > 0.15 THEN 'bad_cam_t_jump' WHEN jump > 0.08 THEN 'warn_cam_t_jump'"))
def flag_align(spark, sf_dir):
    return _flags(spark, sf_dir, ALIGN, "align")


@query(_sql(DEPTH, "WHEN source <> 'depth_smooth_ok' THEN source", "WHEN abs(delta) > 0.16 THEN 'bad_large_depth_smooth_delta' WHEN abs(delta) > 0.08 THEN 'warn_large_depth_smooth_delta'",
            "WHEN clipped > 0 THEN 'warn_delta_z_clipped'", "WHEN jump > 0.16 THEN 'bad_after_depth_smooth_jump' WHEN jump > 0.09 THEN 'warn_after_depth_smooth_jump'"))
def flag_depth_smooth(spark, sf_dir):
    return _flags(spark, sf_dir, DEPTH, "depth_smooth")


@query(_sql(INFILL, "WHEN finite_share < 1 THEN 'bad_non_finite_geometry'", "WHEN jump > 0.22 THEN 'bad_wrist_jump' WHEN jump > 0.12 THEN 'warn_wrist_jump'", "WHEN infilled > 0 AND gap >= 999 THEN 'warn_edge_gap_fill'"))
def flag_infill(spark, sf_dir):
    return _flags(spark, sf_dir, INFILL, "infill")


@query(_sql(SMOOTH, "WHEN source <> 'smoothed_mano_forward' THEN source", "WHEN finite_share < 1 THEN 'bad_non_finite_smooth_geometry'",
            "WHEN rms > 0.12 THEN 'bad_input_to_smooth_joint_rms' WHEN rms > 0.06 THEN 'warn_input_to_smooth_joint_rms'", "WHEN jump > 0.16 THEN 'bad_smooth_wrist_jump' WHEN jump > 0.09 THEN 'warn_smooth_wrist_jump'",
            "WHEN rot_delta > 45 THEN 'bad_global_rot_delta' WHEN rot_delta > 30 THEN 'warn_global_rot_delta'", "WHEN raw_rot_jump > 100 THEN 'bad_raw_global_rot_jump' WHEN raw_rot_jump > 60 THEN 'warn_raw_global_rot_jump'",
            "WHEN rot_jump > 100 THEN 'bad_smooth_global_rot_jump' WHEN rot_jump > 60 THEN 'warn_smooth_global_rot_jump'",
            "WHEN rot_delta > 45 OR raw_rot_jump > 100 OR rot_jump > 100 THEN 'bad_wrist_orientation_flip_occlusion_suspect' WHEN near_flip > 0 THEN 'warn_near_wrist_orientation_flip_occlusion_suspect'"))
def flag_temporal_smooth(spark, sf_dir):
    return _flags(spark, sf_dir, SMOOTH, "temporal_smooth")


@query(_sql(ANCHOR, "WHEN source <> 'anchor_lock_smooth_ok' THEN source", "WHEN abs(delta) > 0.16 THEN 'bad_large_anchor_depth_smooth_delta' WHEN abs(delta) > 0.08 THEN 'warn_large_anchor_depth_smooth_delta'",
            "WHEN jump > 0.16 THEN 'bad_after_anchor_lock_wrist_z_jump' WHEN jump > 0.09 THEN 'warn_after_anchor_lock_wrist_z_jump'"))
def flag_anchor_lock(spark, sf_dir):
    return _flags(spark, sf_dir, ANCHOR, "anchor_lock")


@query(_sql(SEEN, "WHEN zbuffer <= 0 THEN 'bad_empty_zbuffer'", "WHEN reliable < 2 THEN 'bad_low_visible_reliable_joints'", "WHEN vertex_ratio < 0.18 THEN 'warn_low_visible_vertex_ratio'"))
def flag_visibility(spark, sf_dir):
    return _flags(spark, sf_dir, SEEN, "visibility")


@query(_sql(REALIGN, "WHEN source NOT IN ('visible_reliable_joints', 'visible_stable_joints') THEN source", "WHEN rejected > 0 THEN 'bad_rms_rejected_keep_previous'",
            "WHEN rms IS NULL THEN 'missing_visibility_realign_rms' WHEN rms > 0.08 THEN 'bad_visibility_realign_rms' WHEN rms > 0.035 THEN 'warn_visibility_realign_rms'",
            "WHEN delta > 0.16 THEN 'bad_visibility_realign_delta' WHEN delta > 0.08 THEN 'warn_visibility_realign_delta'"))
def flag_realign(spark, sf_dir):
    return _flags(spark, sf_dir, REALIGN, "realign")


@query(_sql(SCALE, "WHEN abs(scale - 1) > 0.1 THEN 'warn_large_scale_correction'", "WHEN abs(shift) > 0.1 THEN 'warn_large_offset_correction'", "WHEN rmse_after IS NULL THEN 'warn_no_background_rmse'",
            "WHEN rmse_after > rmse_before * 1.1 THEN 'warn_background_rmse_worse'"))
def flag_depth(spark, sf_dir):
    return _flags(spark, sf_dir, SCALE, "depth")


@query("""
SELECT event_id, (event_id % 17 = 0 OR value > 60 OR value * 0.9 > 90 OR (event_id % 2 = 0 AND value / 500 > 0.08))::INTEGER AS bad FROM events""")
def flag_bad_pose(spark, sf_dir):
    v = F.col("value")
    bad = gates.bad_pose(v / 2, v * 0.9, F.lit(float("nan")), F.expr("event_id % 17 = 0"), F.expr("event_id % 2 = 0"), v / 500)
    return load(spark, sf_dir, "events").select("event_id", bad.cast("int").alias("bad"))
