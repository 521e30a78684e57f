"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.ordering import in_segments
from ..operators import context, selection as sel
from ..operators.sampling import split_assign
from ..plans import frames as plan
from ..schema import KEYS, NEIGHBOR_SLOTS, REL_SUFFIXES
from ..sources import events_view as view
from . import sql as S
from .registry import query

K = "recording_id, vehicle_id, frame"
FK = [*KEYS, "frame"]


@query("join_tracks_meta", S.with_(S.TRACKS, f"SELECT {K}, meta_class, meta_drivingDirection FROM tracks"))
def join_tracks_meta(spark, d):
    t = view.tracks(spark, d).drop("drivingDirection")
    return context.join_tracks_meta(t, view.class_meta(spark, d)).select(*FK, "meta_class", "meta_drivingDirection")


@query("join_recording_meta", S.with_(S.TRACKS, f"""
SELECT {K}, '{view.UPPER_MARKINGS}' AS rec_upperLaneMarkings, '{view.LOWER_MARKINGS}' AS rec_lowerLaneMarkings FROM tracks"""))
def join_recording_meta(spark, d):
    df = context.join_recording_meta(view.tracks(spark, d), view.recording_meta(spark, d))
    return df.select(*FK, "rec_upperLaneMarkings", "rec_lowerLaneMarkings")


@query("join_neighbor_state", S.with_(S.KIN, f"""
SELECT e.recording_id, e.vehicle_id, e.frame, n.lane_id AS front_lane_id, {S.r('n.x_center')} AS front_x_center,
  {S.r('n.y_center')} AS front_y_center, {S.r('n.vx')} AS front_vx, {S.r('n.vy')} AS front_vy
FROM kin e LEFT JOIN kin n ON n.recording_id = e.recording_id AND n.frame = e.frame
  AND n.vehicle_id = e.preceding_id AND e.preceding_id > 0"""))
def join_neighbor_state(spark, d):
    df = context.join_neighbor_state(plan.kinematic(spark, d), "preceding_id", "front")
    num = [f"front_{c}" for c in ("x_center", "y_center", "vx", "vy")]
    return df.select(*FK, "front_lane_id", *[rounded(F.col(c)).alias(c) for c in num])


_CTX = [f"{s}_{r}" for s in NEIGHBOR_SLOTS.values() for r in REL_SUFFIXES]


@query("join_neighbor_context", S.with_(S.FRAMES, f"""
SELECT {K}, {", ".join(f"{s}_exists" for s in NEIGHBOR_SLOTS.values())}, {S.rounded_list(_CTX)} FROM frames"""))
def join_neighbor_context(spark, d):
    df = context.neighbor_context(plan.kinematic(spark, d))
    return df.select(
        *FK, *[f"{s}_exists" for s in NEIGHBOR_SLOTS.values()], *[rounded(F.col(c)).alias(c) for c in _CTX]
    )


@query("join_lane_interval", S.with_(S.LANES, f"SELECT {K}, {S.rounded_list(['d_left_lane', 'd_right_lane'])} FROM lanes"))
def join_lane_interval(spark, d):
    df = context.lane_distances(plan.kinematic(spark, d))
    return df.select(*FK, *[rounded(F.col(c)).alias(c) for c in ("d_left_lane", "d_right_lane")])


@query("join_split_missing", """
WITH u AS (SELECT DISTINCT user_id FROM events),
r AS (SELECT user_id, row_number() OVER (ORDER BY md5('123|' || (user_id % 5) || ':' || user_id)) - 1 AS rk, count(*) OVER () AS n FROM u),
long AS (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 70)
SELECT user_id % 5 AS recording_id, user_id AS vehicle_id FROM r
WHERE rk >= floor(0.8::DOUBLE * n) AND user_id NOT IN (SELECT user_id FROM long)""")
def join_split_missing(spark, d):
    meta = view.tracks_meta(spark, d)
    test = split_assign(meta.select(*KEYS), 0.7, 0.1, 123).where("split = 'test'")
    return sel.missing_members(test, meta.where("numFrames >= 70"))


@query("join_frame_to_window", S.with_(S.TRACKS, """
, w AS (SELECT vehicle_id, 1 + (count(*) - 50) // 10 AS n, min(frame) AS f0 FROM tracks GROUP BY 1 HAVING count(*) >= 50),
x AS (SELECT recording_id, vehicle_id, frame, f0, n, (frame - f0) AS o FROM tracks JOIN w USING (vehicle_id)
      WHERE frame <= f0 + (n - 1) * 10),
y AS (SELECT *, CAST(round_even(o / 10.0::DOUBLE, 0) AS BIGINT) AS idx FROM x)
SELECT recording_id, vehicle_id, frame, idx AS window_idx, CASE WHEN o % 10 <> 0 THEN f0 + idx * 10 END AS snapped FROM y"""))
def join_frame_to_window(spark, d):
    tracks = plan.kinematic(spark, d).select(*FK)
    grid = tracks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.min("frame").alias("f0")).where("n_rows >= 50")
    n = (1 + F.floor((F.col("n_rows") - 50) / 10)).cast("bigint")
    df = tracks.join(grid, KEYS).withColumn("n", n).where(F.col("frame") <= F.col("f0") + (F.col("n") - 1) * 10)
    idx = context.frame_to_window(F.col("frame"), F.col("f0"), F.col("n"), 10)
    df = df.withColumn("window_idx", idx)
    snapped = F.when((F.col("frame") - F.col("f0")) % 10 != 0, F.col("f0") + F.col("window_idx") * 10)
    return df.select(*FK, "window_idx", snapped.alias("snapped"))


@query("join_pred_truth", S.with_(S.TRACKS, f"""
SELECT {K}, lane_id AS pred, lead(lane_id, 1) OVER {S.W_TRACK} AS truth,
  array_to_string(list(lane_id) OVER (PARTITION BY vehicle_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), ',') AS horizon
FROM tracks"""))
def join_pred_truth(spark, d):
    df = plan.kinematic(spark, d).select(*FK, "t", F.col("lane_id").alias("pred"))
    ahead = lambda w: [{
        "truth": F.lead("pred", 1).over(w),
        "horizon": F.array_join(F.collect_list("pred").over(w.rowsBetween(1, 5)), ","),
    }]
    out = in_segments(df, ahead, after=5, longest=view.longest_track(spark, d))
    return out.select(*FK, "pred", "truth", F.when(F.col("horizon") != "", F.col("horizon")).alias("horizon"))
