"""Count-based sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import windows as win
from ..plans import frames as plan
from ..schema import KEYS, NEIGHBOR_SLOTS, WINDOW_FEATURES
from . import sql as S
from .registry import query

WK = [*KEYS, "window_idx", "start_frame"]
WKS = ", ".join(WK)

STATS = {
    "wnd_last": ["vx_last", "ax_last", "front_dx_last"],
    "wnd_slope": ["vx_slope", "ay_slope", "front_dvx_slope"],
    "wnd_min_max": ["ax_min", "ax_max", "ay_min", "ay_max"],
    "wnd_mean_std": ["vx_mean", "vx_std", "ay_mean", "ay_std"],
    "wnd_p95": ["jerk_x_p95", "jerk_y_p95"],
    "wnd_rms": ["jerk_x_rms", "jerk_y_rms"],
    "wnd_sign_fracs": [f"{c}_{s}_frac" for c in ("ax", "ay") for s in ("neg", "pos", "zero")],
    "wnd_kinematics": [f"{c}_{s}" for c in ("vx", "ax", "vy", "ay") for s in ("last", "slope")]
    + [f"{c}_{s}" for c in ("ax", "ay") for s in ("min", "max", "neg_frac", "pos_frac", "zero_frac")],
    "wnd_jerk_stats": [f"{c}_{s}" for c in ("jerk_x", "jerk_y") for s in ("mean", "std", "rms", "p95")],
    "wnd_lc_flags": ["lc_left_present", "lc_right_present"],
    "wnd_lane_geometry": [f"{c}_{s}" for c in ("d_left_lane", "d_right_lane") for s in ("last", "min")],
    "wnd_risk_masked": [f"{c}_{s}" for c in ("front_thw", "front_ttc", "front_dhw") for s in ("last", "min", "vfrac")],
    "wnd_exists_frac": [f"{s}_exists_frac" for s in NEIGHBOR_SLOTS.values()],
    "wnd_neighbor_rel": [f"{s}_{c}_{a}" for s in NEIGHBOR_SLOTS.values() for c in ("dx", "dy", "dvx", "dvy")
                         for a in ("last", "min", "slope")],
}
DIGITS = {"wnd_neighbor_rel": 5, "wnd_jerk_stats": 4, "wnd_p95": 4, "wnd_rms": 4}


def _stat_query(key: str, names: list[str], digits: int) -> None:
    ctes = S.windows(names)
    if all(not n.startswith(tuple(NEIGHBOR_SLOTS.values())) and "_lane" not in n for n in names):
        ctes = ctes.replace(S.FRAMES, S.KIN).replace("FROM frames)", "FROM kin)")

    @query(key, S.with_(ctes, f"SELECT {WKS}, {S.rounded_list(names, d=digits)} FROM windows"))
    def run(spark, d, names=names):
        df = win.windowize(plan.frames(spark, d), names)
        return df.select(*WK, *[rounded(F.col(n), digits).alias(n) for n in names])


for _key, _names in STATS.items():
    _stat_query(_key, _names, DIGITS.get(_key, 6))


@query("wnd_starts", S.with_(S.TRACKS + "," + S.members(50, 10, "tracks"), """
SELECT recording_id, vehicle_id, window_idx, min(frame) AS start_frame, w.n_windows, w.skipped FROM win_rows
JOIN (SELECT vehicle_id AS v, CASE WHEN count(*) >= 50 THEN 1 + (count(*) - 50) // 10 ELSE 0 END AS n_windows,
  count(*) < 50 AS skipped FROM tracks GROUP BY 1) w ON w.v = vehicle_id
GROUP BY recording_id, vehicle_id, window_idx, w.n_windows, w.skipped HAVING count(*) = 50"""))
def wnd_starts(spark, d):
    frames = plan.kinematic(spark, d).select(*KEYS, "t", "frame")
    counts = win.window_counts(frames, 50, 10).drop("n_rows")
    return win.window_starts(frames, 50, 10).join(counts, KEYS)


@query("wnd_full_vector", S.with_(S.windows(), f"SELECT {WKS}, meta_class, {S.rounded_list(WINDOW_FEATURES, d=4)} FROM windows"))
def wnd_full_vector(spark, d):
    df = win.windowize(plan.frames(spark, d))
    return df.select(*WK, "meta_class", *[rounded(F.col(n), 4).alias(n) for n in WINDOW_FEATURES])


@query("wnd_to_sequences", S.with_(S.KIN, """
SELECT recording_id, vehicle_id, t // 32 AS chunk, min(meta_class) AS meta_class, min(meta_drivingDirection) AS meta_drivingDirection,
  string_agg(frame || '/' || lc, ' ' ORDER BY t) AS rows FROM kin GROUP BY 1, 2, 3"""))
def wnd_to_sequences(spark, d):
    df = win.to_sequences(plan.kinematic(spark, d), ["lc"], chunk=32)
    text = F.array_join(F.transform("rows", lambda r: F.concat_ws("/", r["frame"].cast("string"), r["lc"].cast("string"))), " ")
    return df.select(*KEYS, "chunk", "meta_class", "meta_drivingDirection", text.alias("rows"))


@query("wnd_stack", S.with_(S.windows(["vx_last", "lc_left_present"]), f"""
SELECT {WKS}, 'vx_last' AS feature, {S.r('vx_last')} AS x FROM windows
UNION ALL SELECT {WKS}, 'lc_left_present', {S.r('lc_left_present')} FROM windows"""))
def wnd_stack(spark, d):
    df = plan.windows(spark, d).select(*WK, "vx_last", "lc_left_present")
    return df.unpivot(WK, ["vx_last", "lc_left_present"], "feature", "x").withColumn("x", rounded(F.col("x")))
