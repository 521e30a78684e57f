"""Per-trajectory ordered functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import kinematics as kin, runs
from ..plans import frames as plan
from ..schema import KEYS
from ..sources import events_view as view
from . import sql as S
from .registry import query

K = "recording_id, vehicle_id, frame"
FK = [*KEYS, "frame"]
VT = "(PARTITION BY vehicle_id ORDER BY t)"

# greedy debounce in SQL: jump from each kept event to the next allowed one
def debounced(events: str, gap: int) -> str:
    return f"""
deb AS (
  SELECT recording_id, vehicle_id, min(t) AS t FROM {events} GROUP BY 1, 2
  UNION ALL
  SELECT d.recording_id, d.vehicle_id,
    (SELECT min(e.t) FROM {events} e WHERE e.vehicle_id = d.vehicle_id AND e.t >= d.t + {gap}) AS t
  FROM deb d WHERE d.t IS NOT NULL),
kept AS (SELECT * FROM deb WHERE t IS NOT NULL)"""


def islands(mask: str, min_len: int, source: str = "kin") -> str:
    return f"""
SELECT recording_id, vehicle_id, min(t) AS start_t, max(t) AS end_t, count(*) AS length, (min(t) + max(t)) // 2 AS center
FROM (SELECT recording_id, vehicle_id, t, t - row_number() OVER {VT} AS g FROM {source} WHERE {mask})
GROUP BY recording_id, vehicle_id, g HAVING count(*) >= {min_len}"""


@query("win_lane_change", S.with_(S.KIN, f"SELECT {K}, lc FROM kin"))
def win_lane_change(spark, d):
    df = kin.direction_sign(plan.base_tracks(spark, d))
    return kin.lane_change(df, view.longest_track(spark, d)).select(*FK, "lc")


@query("win_jerk", S.with_(S.KIN, f"SELECT {K}, {S.rounded_list(['jerk_x', 'jerk_y'], d=4)} FROM kin"))
def win_jerk(spark, d):
    df = kin.vehicle_centric(kin.direction_sign(plan.base_tracks(spark, d)))
    df = kin.ordered_features(df, longest=view.longest_track(spark, d))
    return df.select(*FK, *[rounded(F.col(c), 4).alias(c) for c in ("jerk_x", "jerk_y")])


@query("win_row_index_len", S.with_(S.TRACKS, f"SELECT {K}, t, count(*) OVER (PARTITION BY vehicle_id) AS T_len FROM tracks"))
def win_row_index_len(spark, d):
    return runs.index_and_length(view.tracks(spark, d).select(*FK, "t")).select(*FK, "t", F.col("n_rows").alias("T_len"))


@query("win_events_from_lc", S.with_(S.KIN, f"""
SELECT {K}, t, CASE lc WHEN -1 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END AS lc_side FROM kin WHERE lc <> 0"""))
def win_events_from_lc(spark, d):
    return runs.lc_events(plan.kinematic(spark, d)).select(*FK, "t", "lc_side")


@query("win_events_from_lane", S.with_(S.TRACKS, f"""
SELECT {K}, t FROM (SELECT *, lag(lane_id) OVER {S.W_TRACK} AS p FROM tracks) WHERE lane_id <> p"""))
def win_events_from_lane(spark, d):
    return runs.lane_events(plan.kinematic(spark, d), longest=view.longest_track(spark, d)).select(*FK, "t")


@query("win_runs_to_centers", S.with_(S.KIN, islands("ax > 0", 2)))
def win_runs_to_centers(spark, d):
    return runs.mask_runs(plan.kinematic(spark, d), F.col("ax") > 0, 2, view.longest_track(spark, d))


@query("win_debounce", S.with_(S.KIN + ", e AS (SELECT recording_id, vehicle_id, t FROM kin WHERE lc <> 0)," + debounced("e", 10),
                               "SELECT * FROM kept", recursive=True))
def win_debounce(spark, d):
    events = runs.lc_events(plan.kinematic(spark, d)).select(*KEYS, "t")
    return runs.debounce(events, 10, view.longest_track(spark, d))


@query("win_run_lengths", S.with_(S.TRACKS, f"""
, c AS (SELECT *, CASE WHEN lane_id = lag(lane_id) OVER {VT} THEN 0 ELSE 1 END AS ch FROM tracks),
g AS (SELECT *, sum(ch) OVER {VT} AS run FROM c)
SELECT recording_id, vehicle_id, CAST(run AS BIGINT) AS run, min(lane_id) AS lane_id, min(t) AS start_t, count(*) AS duration
FROM g GROUP BY recording_id, vehicle_id, run"""))
def win_run_lengths(spark, d):
    return runs.run_lengths(plan.kinematic(spark, d), "lane_id", view.longest_track(spark, d))


@query("win_centered_feasible", S.with_(S.KIN, f"""
SELECT {K}, t - 25 >= 0 AND t + 25 <= n AS feasible, {S.r('t / n')} AS pos
FROM (SELECT *, count(*) OVER (PARTITION BY vehicle_id) AS n FROM kin) WHERE lc <> 0"""))
def win_centered_feasible(spark, d):
    df = runs.index_and_length(plan.kinematic(spark, d).select(*FK, "t", "lc")).where("lc <> 0")
    return df.select(
        *FK, runs.centered_feasible(F.col("t"), F.col("n_rows"), 50).alias("feasible"),
        rounded(F.col("t") / F.col("n_rows")).alias("pos"),
    )


@query("win_fill_unknown", S.with_(S.TRACKS, f"""
, z0 AS (SELECT recording_id, vehicle_id, frame, t, CASE WHEN event_id % 3 = 0 THEN lane_id ELSE -1 END AS z FROM tracks),
z1 AS (SELECT *, CASE WHEN z <> -1 THEN z END AS k, CASE WHEN z <> -1 THEN t END AS kt FROM z0),
z2 AS (SELECT *,
  last_value(k IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(kt IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
  first_value(k IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(kt IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r
  FROM z1)
SELECT {K}, CASE WHEN k IS NOT NULL THEN z WHEN l IS NULL AND r IS NULL THEN -1 WHEN l IS NULL THEN nv WHEN r IS NULL THEN pv
  WHEN r - l - 1 > 5 THEN -1 WHEN t < (l + r) // 2 THEN pv ELSE nv END AS z FROM z2"""))
def win_fill_unknown(spark, d):
    df = plan.kinematic(spark, d).select(*FK, "t", "lane_id", "event_id")
    df = df.select(*FK, "t", F.when(F.col("event_id") % 3 == 0, F.col("lane_id")).otherwise(-1).alias("z"))
    return runs.fill_unknown(df, longest=view.longest_track(spark, d)).select(*FK, "z")


@query("win_presence_prefix", S.with_(S.KIN + "," + S.members(50, 10, "kin"), """
SELECT recording_id, vehicle_id, window_idx, min(frame) AS start_frame, CAST(sum(CAST(lc <> 0 AS INTEGER)) AS BIGINT) AS n_lc,
  CAST(sum(CASE WHEN ax < -5 THEN 1 ELSE 0 END) AS BIGINT) AS n_brake FROM win_rows GROUP BY 1, 2, 3 HAVING count(*) = 50"""))
def win_presence_prefix(spark, d):
    flags = {"n_lc": F.col("lc") != 0, "n_brake": F.col("ax") < -5}
    return runs.presence(plan.kinematic(spark, d), flags, 50, 10)
