"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.storage import scratch_path
from ..operators import context, kinematics as kin
from ..operators.windows import windowize
from ..plans import frames as plan
from ..schema import KEYS, RAW_TO_INTERNAL, WINDOW_FEATURES
from ..sources import bundles, events_view as view
from . import sql as S
from .registry import query
from .sets import SPLIT, split_table

K = "recording_id, vehicle_id, frame"
FK = [*KEYS, "frame"]


def write_bundles(spark, d) -> str:
    """The trajectory view as recording bundles (test input for the CSV reader)."""
    root = scratch_path(spark, "bundles")
    t = view.tracks(spark, d)
    back = {v: k for k, v in RAW_TO_INTERNAL.items()}
    absent = [c for c in RAW_TO_INTERNAL.values() if c not in t.columns]
    raw = t.withColumns({c: F.lit(None).cast("double") for c in absent}).select(
        "recording_id", *[F.col(v).alias(back[v]) for v in RAW_TO_INTERNAL.values()]
    )
    parts = {
        "tracks": raw,
        "tracksMeta": view.tracks_meta(spark, d).withColumnRenamed("vehicle_id", "id"),
        "recordingMeta": view.recording_meta(spark, d),
    }
    for part, df in parts.items():
        name = F.format_string(f"%02d_{part}.csv", F.col("recording_id"))
        df.withColumn("bundle", name).drop("recording_id").write.partitionBy("bundle").option("header", True).csv(
            f"{root}/{part}")
    return root




@query("src_tracks_csv", S.with_(S.TRACKS, f"""
SELECT {K}, {S.r('x')} AS x, {S.r('ax')} AS ax, lane_id, preceding_id, ti.numFrames AS n_frames, '{view.UPPER_MARKINGS}' AS upper
FROM tracks JOIN (SELECT vehicle_id AS v, count(*) AS numFrames FROM tracks GROUP BY 1) ti ON v = vehicle_id"""))
def src_tracks_csv(spark, d):
    t = bundles.read_bundle(spark, write_bundles(spark, d) + "/*")
    tracks = bundles.rename_tracks(t["tracks"])
    meta = bundles.rename_tracks_meta(t["tracksMeta"]).select(*KEYS, F.col("numFrames").alias("n_frames"))
    rec = t["recordingMeta"].select("recording_id", F.col("upperLaneMarkings").alias("upper"))
    df = tracks.join(meta, KEYS).join(rec, "recording_id")
    return df.select(*FK, rounded(F.col("x")).alias("x"), rounded(F.col("ax")).alias("ax"), "lane_id", "preceding_id", "n_frames", "upper")


_RENAMED = ["x", "y", "width", "height", "vx", "vy", "ax", "ay", "dhw", "thw", "ttc"]


@query("src_rename_map", S.with_(S.TRACKS, f"SELECT {K}, lane_id, {S.rounded_list(_RENAMED)} FROM tracks"))
def src_rename_map(spark, d):
    t = bundles.read_bundle(spark, write_bundles(spark, d) + "/*")["tracks"]
    df = bundles.rename_tracks(t)
    assert df.columns == ["recording_id", *RAW_TO_INTERNAL.values()]
    return df.select(*FK, "lane_id", *[rounded(F.col(c)).alias(c) for c in _RENAMED])


@query("src_load_recordings", S.with_(S.FRAMES, f"""
SELECT {K}, lc, {S.rounded_list(['vx', 'ay', 'jerk_x', 'd_left_lane', 'front_dx', 'left_side_dvx'], d=4)}, front_exists, meta_class
FROM frames WHERE recording_id < 3"""))
def src_load_recordings(spark, d):
    t = bundles.read_bundle(spark, write_bundles(spark, d) + "/*")
    tracks = bundles.first_recordings(bundles.rename_tracks(t["tracks"]), 3)
    df = plan.add_kinematics(kin.with_index(tracks), bundles.rename_tracks_meta(t["tracksMeta"]), t["recordingMeta"])
    df = plan.add_context(df)
    num = ["vx", "ay", "jerk_x", "d_left_lane", "front_dx", "left_side_dvx"]
    return df.select(*FK, "lc", *[rounded(F.col(c), 4).alias(c) for c in num], "front_exists", "meta_class")


@query("src_frame_range", S.with_(S.TRACKS, f"SELECT {K}, lane_id FROM tracks WHERE recording_id = 2 AND frame BETWEEN 10 AND 20"))
def src_frame_range(spark, d):
    df = plan.kinematic(spark, d).where("recording_id = 2")
    return bundles.frame_range(df, 10, 20).select(*FK, "lane_id")


@query("src_recording_meta", """
SELECT DISTINCT user_id % 5 AS recording_id, '0.0,20.0,40.0,60.0,80.0' AS upper, '10.0,30.0,50.0,70.0,90.0' AS lower FROM events""")
def src_recording_meta(spark, d):
    meta = view.recording_meta(spark, d).withColumn("upperLaneMarkings", F.concat("upperLaneMarkings", F.lit(";oops;")))
    lists = context.recording_meta_lists(meta)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return lists.select("recording_id", text("upper").alias("upper"), text("lower").alias("lower"))


@query("sink_frame_cache", S.with_(S.FRAMES, f"SELECT {K}, lc, front_exists, {S.rounded_list(['vx', 'd_left_lane'])} FROM frames"))
def sink_frame_cache(spark, d):
    folder = scratch_path(spark, "frame-cache")
    build = lambda: plan.add_context(plan.kinematic(spark, d))
    bundles.load_frame_cache(spark, folder, None, build, plan._inputs(d))
    df = bundles.load_frame_cache(spark, folder, None, build, plan._inputs(d))
    return df.select(
        F.col("recording_id").cast("bigint").alias("recording_id"), "vehicle_id", "frame", "lc", "front_exists",
        *[rounded(F.col(c)).alias(c) for c in ("vx", "d_left_lane")],
    )


_CACHED = WINDOW_FEATURES


@query("sink_window_cache", S.with_(S.windows(_CACHED), f"SELECT recording_id, vehicle_id, window_idx, start_frame, {S.rounded_list(_CACHED, d=5)} FROM windows"))
def sink_window_cache(spark, d):
    folder = scratch_path(spark, "window-cache")
    frames = plan.frames(spark, d)
    build = lambda f, W, s: windowize(f, _CACHED, W, s)
    bundles.load_window_cache(spark, folder, frames, 50, 10, build)
    df = bundles.load_window_cache(spark, folder, frames, 50, 10, build)
    return df.select(*KEYS, "window_idx", "start_frame", *[rounded(F.col(c), 5).alias(c) for c in _CACHED])


@query("sink_split_json", S.with_(SPLIT, "SELECT * FROM split"))
def sink_split_json(spark, d):
    path = scratch_path(spark, "split")
    bundles.save_split(split_table(spark, d), path, 123, 0.7, 0.1, 50, 10)
    return bundles.load_split(spark, path, "all")


@query("sink_report_tables", S.with_(S.KIN, "SELECT lc, count(*) AS frames FROM kin GROUP BY 1"))
def sink_report_tables(spark, d):
    from ..operators.reports import lc_frame_distribution

    path = scratch_path(spark, "report")
    bundles.write_report(lc_frame_distribution(plan.kinematic(spark, d)).select("lc", "frames"), path, "csv")
    return spark.read.option("header", True).schema("lc int, frames bigint").csv(path)
