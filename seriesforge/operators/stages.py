"""Gates between stages: what a stage's tables hold is measured per session, checked in order, and reported.

A gate reads the sessions (what is expected of them), the stage's summary rows, its rows, and its quality tables; each is aggregated
once, by session. Checks stand in phases: those of a phase are asked only where no error of the phases that must be passed before
has come up, so that a missing table is one error and not ten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.functions.scalars import box_iou, finite
from seriesforge.operators.relations import group_pairs


@dataclass(frozen=True)
class Check:
    """Its SQL condition over the measures must hold (NULL doesn't). times: how many errors or warnings it stands for if not.

    Phase 0 ends the gate if it fails, whatever its level. An error of phase 2 or more ends the phases after it; those from
    `STRICT` on are asked only where no error at all came before.
    """

    name: str
    condition: str
    level: str = "error"
    phase: int = 5
    times: str = "1"


STRICT = 5


def lines(measures: DataFrame, key: str, node: str, checks: tuple[Check, ...]) -> DataFrame:
    """key, node, check, level, ok and times of every check that is asked of a session's measures."""
    ok = {c.name: F.coalesce(F.expr(c.condition), F.lit(False)) for c in checks}
    got = measures.withColumns({f"_ok_{i}": ok[c.name] for i, c in enumerate(checks)})

    def passed(phase: int) -> Column:
        must = [i for i, c in enumerate(checks) if c.phase < phase and (
            c.phase == 0 or c.level == "error" and (c.phase >= 2 or phase >= STRICT))]
        out = F.lit(True)
        for i in must:
            out &= F.col(f"_ok_{i}")
        return out

    one = [F.when(passed(c.phase), F.struct(
        F.lit(c.name).alias("check"), F.lit(c.level).alias("level"), F.col(f"_ok_{i}").alias("ok"),
        F.when(F.col(f"_ok_{i}"), 0).otherwise(F.expr(c.times)).cast("long").alias("times"))) for i, c in enumerate(checks)]
    return got.select(key, F.lit(node).alias("node"), F.explode(F.array_compact(F.array(*one))).alias("_l")).select(key, "node", "_l.*")


def report(asked: DataFrame, *keys: str) -> DataFrame:
    """keys, errors, warnings, ok and exit_code (0, or 2 with an error) of lines()."""
    total = lambda level: F.sum(F.when(F.col("level") == level, F.col("times")).otherwise(0))
    got = asked.groupBy(*keys).agg(total("error").alias("errors"), total("warning").alias("warnings"))
    return got.withColumn("ok", F.col("errors") == 0).withColumn("exit_code", F.when(F.col("errors") == 0, 0).otherwise(2))


def numbers(c: Column, kind: T.DataType) -> Column:
    """The numbers of a column of any shape (numbers, arrays, structs) as one array."""
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.transform(c, lambda x: numbers(x, kind.elementType)))
    if isinstance(kind, T.StructType):
        return F.concat(*[numbers(c.getField(f.name), f.dataType) for f in kind.fields])
    return F.array(c.cast("double"))


def finite_share(df: DataFrame, column: str) -> Column:
    """Aggregate: which share of the column's numbers is finite; NULLs aren't. NULL without any."""
    all_ = F.coalesce(numbers(F.col(column), df.schema[column].dataType), F.array(F.lit(None).cast("double")))
    return F.sum(F.size(F.filter(all_, lambda x: finite(x).isNotNull()))) / F.sum(F.size(all_))


#: What a stage's rows need, by gate, and which of their columns have to be finite.
REQUIRED: dict[str, tuple[str, ...]] = {
    "B": ("track_id", "hand_label", "is_right", "bbox_xyxy", "det_conf", "global_orient", "hand_pose", "betas", "cam_t", "joints_3d_rel", "vertices_rel", "joints_uv"),
    "E": ("frame_index", "track_id", "hand_label", "bbox_xyxy", "cam_t", "cam_t_wilor", "cam_t_depth", "joints_cam_depth", "vertices_cam_depth", "alignment_source",
          "alignment_valid_joint_count", "alignment_joint_ids", "alignment_sampled_depths_m", "alignment_rms_m", "alignment_max_residual_m", "diagnosis_category", "qc_issue_tags",
          "bbox_visible_ratio", "joint_visible_ratio", "bbox_touches_edge"),
    "F0": ("frame_index", "track_id", "cam_t_depth_before_depth_smooth", "cam_t_depth", "joints_cam_depth", "vertices_cam_depth", "cam_t_depth_smooth", "joints_cam_depth_smooth",
           "vertices_cam_depth_smooth", "depth_smooth_delta_z_m", "depth_smooth_trust", "depth_smooth_valid_sample_count", "depth_smooth_status", "depth_smooth_qc_flag"),
    "F1": ("frame_index", "candidate_index", "track_id", "hand_label", "motion_infilled", "motion_infiller_method", "motion_infiller_gap_len", "motion_infiller_qc_flag", "cam_t_depth",
           "joints_cam_depth", "vertices_cam_depth"),
    "F": ("frame_index", "track_id", "hand_label", "cam_t_smooth", "joints_cam_smooth", "vertices_cam_smooth", "joints_3d_rel_smooth", "vertices_rel_smooth", "global_orient_smooth",
          "hand_pose_smooth", "betas_smooth", "joints_uv_smooth_depth_camera", "mano_smoothing_status", "mano_smoothing_qc_flag"),
    "G": ("frame_index", "track_id", "hand_label", "mano_vertex_visible", "mano_joint_visible", "mano_joint_mesh_visible_ratio", "mano_joint_mesh_surface_margin_m",
          "mano_visible_vertex_ratio", "mano_visible_joint_count", "mano_visible_reliable_joint_count", "mano_visibility_qc_flag"),
    "H": ("frame_index", "track_id", "cam_t_visibility_depth_candidate", "cam_t_visibility_depth", "joints_cam_visibility_depth", "vertices_cam_visibility_depth",
          "visibility_realign_source", "visibility_realign_selected_joint_count", "visibility_realign_rms_m", "visibility_realign_delta_m", "visibility_realign_qc_flag"),
}
FINITE: dict[str, tuple[str, ...]] = {
    "B": ("global_orient", "hand_pose", "betas", "cam_t", "joints_3d_rel", "vertices_rel", "joints_uv"),
    "E": ("cam_t_depth", "joints_cam_depth", "vertices_cam_depth"), "F0": ("cam_t_depth", "joints_cam_depth", "vertices_cam_depth"),
    "F1": ("cam_t_depth", "joints_cam_depth", "vertices_cam_depth"),
    "F": ("cam_t_smooth", "joints_cam_smooth", "vertices_cam_smooth", "global_orient_smooth", "hand_pose_smooth"),
    "G": ("mano_visible_vertex_ratio", "mano_joint_mesh_visible_ratio", "mano_joint_mesh_surface_margin_m"),
    "H": ("cam_t_visibility_depth", "joints_cam_visibility_depth", "vertices_cam_visibility_depth"),
}


def _ran(level: str = "warning") -> Check:
    return Check("summary there", "has_summary", level, 0)


SUMMARY = (Check("summary errors", "summary_errors = 0", "error", 1, "summary_errors"), Check("summary warnings", "summary_warnings = 0", "warning", 1, "summary_warnings"),
           Check("summary ok", "summary_ok", "error", 1))
TABLES = (Check("rows there", "rows > 0", "error", 2), Check("quality rows there", "quality_rows > 0", "error", 3), Check("fields there", "missing_fields = 0", "error", 4, "missing_fields"))
FLAGS = (Check("bad flags", "bad_flags = 0", "warning"), Check("warn flags", "warn_flags = 0", "warning"))
WHOLE = (Check("finite", "not_finite = 0", "error", STRICT, "not_finite"), Check("quality rows agree", "quality_rows = rows"))
EXPECTED = Check("summary count as expected", "coalesce(expected, 0) <= 0 OR candidates = expected", "error", 1)
COUNTED = Check("rows as expected", "coalesce(expected, 0) <= 0 OR rows = expected")
COVERED = "NOT need_all OR coalesce(total_frames, 0) <= 0 OR (frames = total_frames AND first = 0 AND last = total_frames - 1)"

#: The checks of each gate.
GATES: dict[str, tuple[Check, ...]] = {
    "A": (Check("left opened", "left_opened", "error", 2), Check("right opened", "right_opened", "error", 2), Check("frame counts agree", "left_frames = right_frames", phase=3),
          Check("image sizes agree", "left_width = right_width AND left_height = right_height", phase=3), Check("metadata there", "has_metadata", phase=3),
          Check("crop fits", "NOT has_metadata OR (coalesce(crop_width, -1) = left_width AND coalesce(crop_height, -1) = left_height)", phase=3),
          Check("calibration there", "has_calibration", phase=3), Check("table frame there", "has_table_frame", "warning", 3)),
    "B": (Check("has candidates", "rows > 0", "error", 2), TABLES[2], Check("finite", "not_finite = 0", "error", STRICT, "not_finite"),
          Check("no overlap in a label", "overlaps = 0", "error", STRICT)),
    "D": (_ran("error"), Check("frames exported", "coalesce(frames_exported, 0) > 0", "error", 1), Check("manifest there", "rows > 0", "error", 2),
          Check("depth files there", "missing_files = 0", phase=3), Check("valid ratio", "coalesce(median_valid, 0) >= 0.05", phase=3),
          Check("valid ratio high", "coalesce(median_valid, 0) >= 0.15 OR coalesce(median_valid, 0) < 0.05", "warning", 3),
          Check("full rate", "NOT need_all OR coalesce(total_frames, 0) <= 0 OR coalesce(stride, 0) = 1", phase=3), Check("covered", COVERED, phase=3)),
    "D1": (_ran(), *SUMMARY, Check("template ratio", "coalesce(template_ratio, 0) >= 0.10", "error", 1), Check("manifest there", "rows > 0", "error", 2),
           Check("corrections there", "quality_rows > 0", "error", 3), Check("depth files there", "missing_files = 0", phase=4), Check("corrections agree", "quality_rows = rows", phase=4),
           Check("covered", COVERED, phase=4), Check("warn flags", "warn_flags = 0", "warning", 4)),
    "E": (_ran(), *SUMMARY, Check("candidates selected", "candidates > 0", "error", 1), *TABLES, WHOLE[0], Check("selected rows agree", "selected = candidates"),
          Check("all candidates", "NOT need_all OR coalesce(expected, 0) <= 0 OR (rows = expected AND candidates = expected)"), Check("quality rows agree", "quality_rows = candidates"),
          FLAGS[0], Check("fallback ratio", "coalesce(fallback_ratio, 0) <= 0.5", "warning")),
    "F0": (_ran(), *SUMMARY, EXPECTED, *TABLES[:2], Check("track rows there", "track_rows > 0", "error", 3), TABLES[2], COUNTED, *WHOLE, *FLAGS),
    "F1": (_ran(), *SUMMARY, Check("input count as expected", "coalesce(expected, 0) <= 0 OR candidates_in = expected", "error", 1),
           Check("never fewer", "candidates_out >= candidates_in", "error", 1), *TABLES, Check("rows as put out", "rows = candidates_out"), WHOLE[0],
           Check("infilled rows agree", "infilled = infilled_candidates"), WHOLE[1], *FLAGS),
    "F": (_ran(), *SUMMARY, EXPECTED, *TABLES, COUNTED, *WHOLE, *FLAGS),
    "G": (_ran(), *SUMMARY, EXPECTED, TABLES[0], Check("joint rows there", "joint_rows > 0", "error", 3), TABLES[1], TABLES[2], COUNTED,
          Check("mostly finite", "half_finite = 0", "warning", STRICT, "half_finite"), WHOLE[1], Check("joint rows agree", "joint_rows = 21 * rows"), *FLAGS),
    "H": (_ran(), *SUMMARY, Check("off by default", "NOT coalesce(enabled_by_default, false)", "warning", 1), EXPECTED, *TABLES, COUNTED, *WHOLE, *FLAGS),
}


def counted(sessions: DataFrame, key: str, out: str, table: DataFrame | None) -> DataFrame:
    """sessions with the number of the table's rows that they have; 0 without a table."""
    if table is None:
        return sessions.withColumn(out, F.lit(0).cast("long"))
    return sessions.join(table.groupBy(key).agg(F.count("*").alias(out)), key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def summarised(sessions: DataFrame, key: str, summary: DataFrame) -> DataFrame:
    """sessions with their summary's columns, has_summary, and summary_errors and summary_warnings from its arrays hard_errors and warnings.

    A session has one summary row or none; lists that are NULL are empty, and NULL is not ok.
    """
    got = sessions.join(summary.withColumn("has_summary", F.lit(True)), key, "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))
    for a, b in (("summary_errors", "hard_errors"), ("summary_warnings", "warnings")):
        if b in summary.columns:
            got = got.withColumn(a, F.coalesce(F.size(b), F.lit(0)).cast("long")).withColumn(a, F.greatest(a, F.lit(0)))
    return got.withColumn("summary_ok", F.coalesce("ok", F.lit(False))) if "ok" in summary.columns else got


def stage_measures(sessions: DataFrame, key: str, rows: DataFrame, required: tuple[str, ...], finite_columns: tuple[str, ...], flag: str | None = None,
                   **more: Column) -> DataFrame:
    """sessions with what one pass over a stage's rows measures: rows, missing_fields, not_finite and half_finite (how many of the columns have
    numbers that aren't finite, or fewer than half of them), bad_flags and warn_flags (rows), and further aggregates."""
    there = [c for c in finite_columns if c in rows.columns]
    shares = {f"_finite_{i}": finite_share(rows, c) for i, c in enumerate(there)}
    has = lambda x: F.sum(F.contains(F.col(flag), F.lit(x)).cast("long")) if flag in rows.columns else F.lit(0)
    flags = {"bad_flags": has("bad_"), "warn_flags": has("warn_")} if flag else {}
    per = rows.groupBy(key).agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in (shares | flags | more).items()])
    below = lambda most: sum((F.coalesce((F.col(n) < most).cast("int"), F.lit(0)) for n in shares), F.lit(0))
    got = sessions.join(per, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    got = got.withColumn("missing_fields", F.lit(sum(c not in rows.columns for c in required))).withColumn("not_finite", below(1.0)).withColumn("half_finite", below(0.5))
    return got.withColumns({n: F.coalesce(n, F.lit(0)) for n in flags}).drop(*shares)


def video_measures(sessions: DataFrame, key: str, videos: DataFrame, metadata: DataFrame, calibration: DataFrame, table_frames: DataFrame) -> DataFrame:
    """Measures of gate A: videos holds key, side (left, right), opened, frames, width and height; metadata key, crop_width and crop_height."""
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    per = videos.groupBy(key).agg(*[of(s, c) for s in ("left", "right") for c in ("opened", "frames", "width", "height")])
    got = sessions.join(per, key, "left").join(metadata.select(key, "crop_width", "crop_height", F.lit(True).alias("has_metadata")), key, "left")
    got = got.withColumn("has_metadata", F.coalesce("has_metadata", F.lit(False)))
    for out, table in (("has_calibration", calibration), ("has_table_frame", table_frames)):
        got = counted(got, key, out, table).withColumn(out, F.col(out) > 0)
    return got


def overlap_measures(sessions: DataFrame, key: str, rows: DataFrame, frame: str, candidate: str, label: str, box: list[str], most: float = 0.30) -> DataFrame:
    """sessions with overlaps: pairs of one frame and label whose boxes overlap by more than `most`."""
    pairs = group_pairs(rows, [key, frame, label], candidate, box, box_iou, "iou")
    per = pairs.groupBy(key).agg(F.sum((F.col("iou") > most).cast("long")).alias("overlaps"))
    return sessions.join(per, key, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))


def manifest_measures(sessions: DataFrame, key: str, manifest: DataFrame, frame: str, ratio: str, exists: str) -> DataFrame:
    """sessions with rows, frames (distinct), first, last, median_valid and missing_files of a depth manifest."""
    per = manifest.groupBy(key).agg(
        F.count("*").alias("rows"), F.countDistinct(frame).alias("frames"), F.min(frame).alias("first"), F.max(frame).alias("last"),
        F.percentile(finite(F.col(ratio)), 0.5).alias("median_valid"), F.sum((~F.coalesce(F.col(exists), F.lit(False))).cast("long")).alias("missing_files"))
    return sessions.join(per, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def candidate_faults(df: DataFrame, box: list[str], uv: str, cam_z: str, joints: str, vertices: str, width: Column, height: Column, margin: float = 0.25) -> DataFrame:
    """df with hard_reasons and warning_reasons (";"-joined), hard_error and warning (0 or 1) of each candidate.

    Hard: depth that isn't positive, a box that isn't finite or has no area, a box that is wholly further than `margin` of the image's size
    outside it (or an image without size), joints or vertices that aren't finite throughout. Warning: fewer than 0.35 of the points inside the image.
    """
    x1, y1, x2, y2 = (finite(F.col(c)) for c in box)
    valid = F.coalesce((x2 > x1) & (y2 > y1), F.lit(False))
    mx, my = width * margin, height * margin
    near = (width > 0) & (height > 0) & ((x2 >= -mx) & (x1 <= width + mx) & (y2 >= -my) & (y1 <= height + my))
    whole = lambda c: F.forall(numbers(F.col(c), df.schema[c].dataType), lambda x: finite(x).isNotNull())
    inside = F.filter(uv, lambda p: (finite(p["u"]) >= 0) & (p["u"] < width) & (finite(p["v"]) >= 0) & (p["v"] < height))
    share = F.when((width > 0) & (height > 0) & (F.size(uv) > 0), F.size(inside) / F.size(uv))
    hard = F.concat_ws(";", F.when(~F.coalesce(finite(F.col(cam_z)) > 0, F.lit(False)), "non_positive_cam_t_z"),
                       F.when(~valid, "invalid_bbox").when(~F.coalesce(near, F.lit(False)), "bbox_out_of_image_range"),
                       F.when(~F.coalesce(whole(joints), F.lit(False)), "non_finite_joints_cam"), F.when(~F.coalesce(whole(vertices), F.lit(False)), "non_finite_vertices_cam"))
    got = df.withColumn("uv_in_image_ratio", share).withColumn("hard_reasons", hard).withColumn(
        "warning_reasons", F.when(F.col("uv_in_image_ratio") < 0.35, "low_uv_in_image_ratio").otherwise(""))
    return got.withColumn("hard_error", (F.col("hard_reasons") != "").cast("int")).withColumn("warning", (F.col("warning_reasons") != "").cast("int"))


def stage_summary(df: DataFrame, keys: list[str], frame: str, track: str, cam_z: str) -> DataFrame:
    """Roll-up of candidate_faults() by keys: candidates, frames, tracks, depth (least, median, greatest, how many positive) and faulty rows."""
    z = finite(F.col(cam_z))
    return df.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.countDistinct(frame).alias("frames"), F.countDistinct(track).alias("tracks"), F.min(z).alias("least_z"), F.percentile(z, 0.5).alias("median_z"),
        F.max(z).alias("greatest_z"), F.sum((z > 0).cast("long")).alias("positive_z"), F.sum("hard_error").alias("hard_errors"), F.sum("warning").alias("warnings"))


def review(df: DataFrame, keys: list[str], bad: Column, frame: str, columns: list[str]) -> DataFrame:
    """keys, field, value, rows and frames: the bad rows by each value of the columns; packed flags ("|") count once for each; NULL as ""."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns]))
    rows = df.filter(bad).select(*keys, frame, items.alias("_i")).withColumn("value", F.explode(F.split("_i.v", "[|]")))
    return rows.groupBy(*keys, F.col("_i.field").alias("field"), "value").agg(F.count("*").alias("rows"), F.countDistinct(frame).alias("frames"))
