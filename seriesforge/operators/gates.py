"""Quality flags of the stages as tables of rules. Gates between stages are in stages.py."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite, join_flags, level_flag


@dataclass(frozen=True)
class Level:
    """bad_name above bad, else warn_name above warn. missing: the flag of a value that isn't finite. size: by
    absolute value."""

    column: str
    name: str
    warn: float = float("inf")
    bad: float = float("inf")
    missing: str | None = None
    size: bool = False

    def flag(self) -> Column:
        c = F.abs(F.col(self.column)) if self.size else F.col(self.column)
        if self.missing is None:
            return level_flag(c, self.warn, self.bad, self.name)
        return F.when(finite(c).isNull(), self.missing).otherwise(level_flag(c, self.warn, self.bad, self.name))


@dataclass(frozen=True)
class Test:
    """name, where an SQL condition holds; NULL doesn't."""

    condition: str
    name: str

    def flag(self) -> Column:
        return F.when(F.expr(self.condition), self.name)


@dataclass(frozen=True)
class Status:
    """The text of a column itself, unless it is one of the good ones."""

    column: str
    good: tuple[str, ...]

    def flag(self) -> Column:
        return F.when(~F.col(self.column).isin(*self.good), F.col(self.column))


Rule = Level | Test | Status

# The stages' flags in their order, with default thresholds (metres, degrees, pixels, ratios).
STAGES: dict[str, tuple[Rule, ...]] = {
    "align": (
        Status("source", ("depth_reliable_joints",)), Level("rms", "alignment_rms", 0.035, 0.080, "missing_alignment_rms"),
        Level("jump", "cam_t_jump", 0.080, 0.150),
    ),
    "depth_smooth": (
        Status("source", ("depth_smooth_ok",)), Level("delta", "large_depth_smooth_delta", 0.080, 0.160, size=True),
        Test("clipped > 0", "warn_delta_z_clipped"), Level("jump", "after_depth_smooth_jump", 0.090, 0.160),
    ),
    "infill": (
        Test("finite_share < 1", "bad_non_finite_geometry"), Level("jump", "wrist_jump", 0.120, 0.220),
        Test("infilled > 0 AND gap >= 999", "warn_edge_gap_fill"),
    ),
    "temporal_smooth": (
        Status("source", ("smoothed_mano_forward",)), Test("finite_share < 1", "bad_non_finite_smooth_geometry"),
        Level("rms", "input_to_smooth_joint_rms", 0.060, 0.120), Level("jump", "smooth_wrist_jump", 0.090, 0.160),
        Level("rot_delta", "global_rot_delta", 30.0, 45.0), Level("raw_rot_jump", "raw_global_rot_jump", 60.0, 100.0),
        Level("rot_jump", "smooth_global_rot_jump", 60.0, 100.0),
        Test("rot_delta > 45 OR raw_rot_jump > 100 OR rot_jump > 100", "bad_wrist_orientation_flip_occlusion_suspect"),
        Test("near_flip > 0 AND NOT coalesce(rot_delta > 45, false) AND NOT coalesce(raw_rot_jump > 100, false) AND NOT coalesce(rot_jump > 100, false)",
             "warn_near_wrist_orientation_flip_occlusion_suspect"),
    ),
    "anchor_lock": (
        Status("source", ("anchor_lock_smooth_ok",)), Level("delta", "large_anchor_depth_smooth_delta", 0.080, 0.160, size=True),
        Level("jump", "after_anchor_lock_wrist_z_jump", 0.090, 0.160),
    ),
    "visibility": (
        Test("zbuffer <= 0", "bad_empty_zbuffer"), Test("reliable < 2", "bad_low_visible_reliable_joints"),
        Test("vertex_ratio < 0.18", "warn_low_visible_vertex_ratio"),
    ),
    "realign": (
        Status("source", ("visible_reliable_joints", "visible_stable_joints")), Test("rejected > 0", "bad_rms_rejected_keep_previous"),
        Level("rms", "visibility_realign_rms", 0.035, 0.080, "missing_visibility_realign_rms"), Level("delta", "visibility_realign_delta", 0.080, 0.160),
    ),
    "depth": (
        Test("abs(scale - 1) > 0.10", "warn_large_scale_correction"), Test("abs(shift) > 0.10", "warn_large_offset_correction"),
        Test("rmse_after IS NULL OR isnan(rmse_after)", "warn_no_background_rmse"), Test("rmse_after > rmse_before * 1.10", "warn_background_rmse_worse"),
    ),
}


def stage_flag(rules: tuple[Rule, ...]) -> Column:
    """The rules' flags joined by "|"; "ok" if none fires. NaN and NULL fire only what asks for them."""
    return join_flags(*[r.flag() for r in rules])


def bad_pose(delta: Column, raw_jump: Column, smooth_jump: Column, flip: Column, infilled: Column, wrist_jump: Column) -> Column:
    """Whether a pose needs repair: it flips, turns too far (30 degrees from its input, 90 to its neighbour), or was filled
    in and jumps over 0.08."""
    over = lambda c, most: F.coalesce(finite(c) > most, F.lit(False))
    return F.coalesce(flip, F.lit(False)) | over(delta, 30.0) | over(raw_jump, 90.0) | over(smooth_jump, 90.0) | (
        F.coalesce(infilled, F.lit(False)) & over(wrist_jump, 0.080))
