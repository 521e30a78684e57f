"""Rule labels for windows in physical units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import all_of, any_of, is_true
from ..schema import N_ACTIONS

UNKNOWN = -1

# Rule thresholds.
THRESHOLDS = {
    "lc_flag_thresh": 0.5,
    "lateral_velocity_threshold": 0.1,
    "lateral_acceleration_threshold": 0.1,
    "lateral_velocity_slope_threshold": 0.003,
    "ay_zero_frac_threshold": 0.5,
    "brake_ax_neg_frac": 0.90,
    "brake_ax_last": -0.15,
    "tactical_brake_ax_last": -0.25,
    "tactical_brake_vx_slope": -0.01,
    "tactical_brake_thw": 2.0,
    "tactical_brake_ttc": 70.0,
    "interaction_thw_tight": 2.0,
    "interaction_ttc_tight": 60.0,
    "strong_acc_front_exists_min": 0.50,
    "strong_acc_ax_pos_frac": 0.90,
    "strong_acc_ax_last": 0.15,
    "constrained_acc_ax_pos_frac": 0.65,
    "constrained_acc_ax_last": 0.08,
    "constrained_acc_front_exists": 0.80,
    "free_flow_front_exists_max": 0.50,
    "constrained_follow_front_exists": 0.80,
    "constrained_follow_vx_last_max": 21.0,
    "constrained_follow_jerk_min": 0.75,
    "stable_follow_front_exists": 0.80,
    "stable_follow_vx_slope_abs_max": 0.008,
    "stable_follow_ax_last_abs_max": 0.20,
}

RULE_INPUTS = [
    "ax_last", "vx_last", "vx_slope", "ax_neg_frac", "ax_pos_frac", "front_exists_frac", "jerk_x_p95",
    "lc_left_present", "lc_right_present", "front_thw_last", "front_ttc_min", "ay_zero_frac",
    "vy_last", "ay_last", "vy_slope",
]


def thresholds(overrides: dict | None = None) -> dict[str, float]:
    """Defaults with keys replaced. A key that is no threshold is left aside: a settings file holds other keys as well."""
    return THRESHOLDS | {k: float(v) for k, v in (overrides or {}).items() if k in THRESHOLDS}


def rule_label(columns: list[str], overrides: dict | None = None, A: int = N_ACTIONS) -> Column:
    """Joint label of a window; the first rule that holds wins, a missing value never holds."""
    th = thresholds(overrides)
    required = [c for c in RULE_INPUTS if c not in (
        "front_thw_last", "front_ttc_min", "vy_last", "ay_last", "vy_slope", "ay_zero_frac")]
    lacking = [c for c in required if c not in columns]
    if lacking:
        raise KeyError(f"rule features missing: {lacking}")
    have = set(columns)

    def ge(c: str, t: str) -> Column:
        return is_true(F.col(c) >= th[t]) if c in have else F.lit(False)

    def le(c: str, t: str) -> Column:
        return is_true(F.col(c) <= th[t]) if c in have else F.lit(False)

    def abs_ge(c: str, t: str) -> Column:
        return is_true(F.abs(F.col(c)) >= th[t]) if c in have else F.lit(False)

    def abs_le(c: str, t: str) -> Column:
        return is_true(F.abs(F.col(c)) <= th[t])

    flagged = any_of(*[is_true(F.col(c) > th["lc_flag_thresh"]) for c in ("lc_left_present", "lc_right_present")])
    drifting = all_of(
        abs_ge("vy_last", "lateral_velocity_threshold"), abs_ge("ay_last", "lateral_acceleration_threshold"),
        abs_ge("vy_slope", "lateral_velocity_slope_threshold"), le("ay_zero_frac", "ay_zero_frac_threshold"),
    )
    front = ge("front_exists_frac", "stable_follow_front_exists")
    tight = front & (le("front_thw_last", "interaction_thw_tight") | le("front_ttc_min", "interaction_ttc_tight"))
    braking = all_of(ge("ax_neg_frac", "brake_ax_neg_frac"), le("ax_last", "brake_ax_last"), front)
    tactical = any_of(
        le("ax_last", "tactical_brake_ax_last"), le("vx_slope", "tactical_brake_vx_slope"),
        le("front_thw_last", "tactical_brake_thw"), le("front_ttc_min", "tactical_brake_ttc"),
    )
    strong = all_of(
        ge("ax_pos_frac", "strong_acc_ax_pos_frac"), ge("ax_last", "strong_acc_ax_last"),
        ge("front_exists_frac", "strong_acc_front_exists_min") | tight,
    )
    constrained = all_of(
        ge("ax_pos_frac", "constrained_acc_ax_pos_frac"), ge("ax_last", "constrained_acc_ax_last"),
        ge("front_exists_frac", "constrained_acc_front_exists"),
    )
    stop_go = le("vx_last", "constrained_follow_vx_last_max") & ge("jerk_x_p95", "constrained_follow_jerk_min")
    following = ge("front_exists_frac", "constrained_follow_front_exists") & (stop_go | tight)
    stable = all_of(
        front, abs_le("vx_slope", "stable_follow_vx_slope_abs_max"), abs_le("ax_last", "stable_follow_ax_last_abs_max"), ~tight
    )
    free = is_true(F.col("front_exists_frac") < th["free_flow_front_exists_max"])
    z = lambda s, a: F.lit(s * A + a)
    return (
        F.when(flagged | drifting, z(1, 1))
        .when(braking & tactical, z(1, 3)).when(braking, z(0, 1))
        .when(strong, z(1, 0)).when(constrained, z(0, 2)).when(following, z(1, 2))
        .when(stable, z(0, 3)).when(free, z(0, 0)).otherwise(F.lit(UNKNOWN)).cast("int")
    )


def with_labels(windows: DataFrame, overrides: dict | None = None, A: int = N_ACTIONS) -> DataFrame:
    return windows.withColumn("z", rule_label(windows.columns, overrides, A))
