"""Column vocabulary, feature lists and default settings.

The names and constants below are fixed values: results only line up with
existing track data and stored parameters if they are exactly these.
"""

from __future__ import annotations

# Keys -----------------------------------------------------------------------
KEYS = ["recording_id", "vehicle_id"]

# Raw track column -> internal name.
RAW_TO_INTERNAL = {
    "id": "vehicle_id",
    "frame": "frame",
    "x": "x",
    "y": "y",
    "width": "width",
    "height": "height",
    "xVelocity": "vx",
    "yVelocity": "vy",
    "xAcceleration": "ax",
    "yAcceleration": "ay",
    "laneId": "lane_id",
    "frontSightDistance": "front_sight_dist",
    "backSightDistance": "back_sight_dist",
    "dhw": "dhw",
    "thw": "thw",
    "ttc": "ttc",
    "precedingXVelocity": "preceding_vx",
    "precedingId": "preceding_id",
    "followingId": "following_id",
    "leftPrecedingId": "left_preceding_id",
    "leftAlongsideId": "left_alongside_id",
    "leftFollowingId": "left_following_id",
    "rightPrecedingId": "right_preceding_id",
    "rightAlongsideId": "right_alongside_id",
    "rightFollowingId": "right_following_id",
}

# Neighbour id column -> slot name.
NEIGHBOR_SLOTS = {
    "preceding_id": "front",
    "following_id": "rear",
    "left_preceding_id": "left_front",
    "left_alongside_id": "left_side",
    "left_following_id": "left_rear",
    "right_preceding_id": "right_front",
    "right_alongside_id": "right_side",
    "right_following_id": "right_rear",
}
REL_SUFFIXES = ["dx", "dy", "dvx", "dvy"]

META_COLS = ["meta_class", "meta_drivingDirection"]
RISK_RENAMES = {"thw": "front_thw", "ttc": "front_ttc", "dhw": "front_dhw"}

FRAME_FEATURES = (
    ["vx", "vy", "ax", "ay", "jerk_x", "jerk_y", "lc", "d_left_lane", "d_right_lane"]
    + list(RISK_RENAMES.values())
    + [f"{s}_exists" for s in NEIGHBOR_SLOTS.values()]
    + [f"{s}_{r}" for s in NEIGHBOR_SLOTS.values() for r in REL_SUFFIXES]
)

# Window feature groups, in output order.
EGO_FEATURES = [
    "vx_last", "vx_slope", "ax_last", "vy_last", "vy_slope", "ay_last",
    "ax_neg_frac", "ax_pos_frac", "ax_zero_frac",
    "ay_neg_frac", "ay_pos_frac", "ay_zero_frac",
    "jerk_x_p95", "jerk_y_p95",
]
LC_FEATURES = ["lc_left_present", "lc_right_present"]
LANE_FEATURES = ["d_left_lane_last", "d_left_lane_min", "d_right_lane_last", "d_right_lane_min"]
RISK_FEATURES = ["front_thw_last", "front_thw_vfrac", "front_ttc_min", "front_ttc_vfrac"]
NEIGHBOR_FEATURES = [
    "front_dx_min", "front_dvx_slope", "front_exists_frac",
    "left_side_dvx_last", "left_side_dvx_slope", "left_side_dy_last", "left_side_exists_frac",
    "right_side_dvx_last", "right_side_dvx_slope", "right_side_dy_last", "right_side_exists_frac",
    "left_front_dx_last", "left_front_dvx_slope", "left_front_dy_last", "left_front_exists_frac",
    "right_front_dx_last", "right_front_dvx_slope", "right_front_dy_last", "right_front_exists_frac",
]
FEATURE_GROUPS = {
    "ego_kinematics": EGO_FEATURES,
    "lane_change_flags": LC_FEATURES,
    "lane_geometry": LANE_FEATURES,
    "front_risk": RISK_FEATURES,
    "neighbor_interaction": NEIGHBOR_FEATURES,
}
WINDOW_FEATURES = [f for group in FEATURE_GROUPS.values() for f in group]
BINARY_FEATURES = LC_FEATURES
CONTINUOUS_FEATURES = [f for f in WINDOW_FEATURES if f not in BINARY_FEATURES]

# Feature subset used for state semantics.
SEMANTIC_FEATURES = (
    EGO_FEATURES + LC_FEATURES + LANE_FEATURES
    + ["front_exists_frac", "left_side_exists_frac", "right_side_exists_frac",
       "left_front_exists_frac", "right_front_exists_frac",
       "front_dx_min", "front_dvx_slope", "left_side_dy_last", "right_side_dy_last",
       "front_thw_last", "front_ttc_min"]
)

# Frame rate, windows, model sizes and smoothing constants.
FPS = 25.0
WINDOW_LEN = 50
WINDOW_STRIDE = 10
N_STYLES = 2
N_ACTIONS = 4
EPS = 1e-6
MIN_VAR = 1e-5
VAR_JITTER = 1e-6
MIN_STATE_MASS = 50.0

# Readable names of the (style, action) states.
STYLE_NAMES = {0: "low_interaction", 1: "high_interaction"}
ACTION_NAMES = {
    (0, 0): "free_flow",
    (0, 1): "mild_brake",
    (0, 2): "constrained_acceleration",
    (0, 3): "stable_following",
    (1, 0): "strong_acceleration",
    (1, 1): "lane_change",
    (1, 2): "constrained_following",
    (1, 3): "tactical_brake",
}

# Maneuver groups for horizon hits. The legacy table names a
# state (1, 4) that cannot occur with four actions.
MANEUVER_GROUPS = {
    (0, 1): "brake", (1, 3): "brake",
    (0, 2): "acceleration", (1, 0): "acceleration",
    (0, 3): "following", (1, 2): "following",
}
LEGACY_MANEUVER_GROUPS = {
    (0, 1): "brake", (1, 4): "brake",
    (0, 2): "acceleration", (1, 0): "acceleration",
    (0, 3): "following", (1, 2): "following",
}

# Readable lane position labels.
LANE_POS_LABELS = {
    -1: "unknown (-1)",
    0: "left violation (0)",
    1: "leftmost lane (1)",
    2: "middle lane(s) (2)",
    3: "rightmost lane (3)",
    4: "right violation (4)",
}
