"""Recordings to the frame table, frames to the window table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import cached_table
from ..operators import context, kinematics as kin
from ..operators.windows import windowize
from ..schema import FRAME_FEATURES, KEYS, META_COLS, WINDOW_LEN, WINDOW_STRIDE
from ..sources import events_view as view


def add_kinematics(tracks: DataFrame, meta: DataFrame, recording_meta: DataFrame,
                   longest: int | None = None) -> DataFrame:
    """Metadata, direction sign, normalisation, lane changes and jerk."""
    df = context.join_tracks_meta(tracks, meta)
    df = context.join_recording_meta(df, recording_meta)
    df = kin.direction_sign(kin.box_center(df), vehicles=meta)
    df = kin.rename_risk(kin.vehicle_centric(df))
    return kin.ordered_features(df, longest=longest)


def add_context(kinematic: DataFrame, extra: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Lane distances and neighbours; output is the frame table.

    Non-finite numbers became NULL when the tracks were read, so no column needs
    another cast here.
    """
    df = context.neighbor_context(context.lane_distances(kinematic), rows)
    return kin.prune_columns(df, KEYS, ["frame", "t"], FRAME_FEATURES, META_COLS, extra or [])


# The trajectory view of the test tables ---------------------------------------

def _inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/events.parquet", f"{sf_dir}/customer.parquet"]


def base_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tracks with metadata, before normalisation."""
    df = context.join_tracks_meta(view.tracks(spark, sf_dir).drop("drivingDirection"), view.class_meta(spark, sf_dir))
    return context.join_recording_meta(df, view.recording_meta(spark, sf_dir))


def build_kinematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = view.longest_track(spark, sf_dir)
    return add_kinematics(
        view.tracks(spark, sf_dir, longest).drop("drivingDirection"),
        view.class_meta(spark, sf_dir),
        view.recording_meta(spark, sf_dir),
        longest,
    )


def kinematic(spark: SparkSession, sf_dir: str, force: bool = False) -> DataFrame:
    """Normalised tracks plus lc and jerk, written once and read by every later job.

    The neighbour join reads it three times, so it is a table, not a plan.
    """
    return cached_table(spark, "kinematic", _inputs(sf_dir), lambda: build_kinematic(spark, sf_dir), force=force)


def frames(spark: SparkSession, sf_dir: str, force: bool = False) -> DataFrame:
    """The full frame table."""
    def build():
        kin_rows = kinematic(spark, sf_dir, force)
        return add_context(kin_rows, ["lane_id", "lane_pos", "event_id"], kin_rows.count())

    return cached_table(
        spark, "frames", _inputs(sf_dir),
        build, force=force,
    )


def windows(spark: SparkSession, sf_dir: str, W: int = WINDOW_LEN, stride: int = WINDOW_STRIDE,
            force: bool = False) -> DataFrame:
    """The full window table for one window setting."""
    return cached_table(
        spark, f"windows-W{W}-stride{stride}", _inputs(sf_dir),
        lambda: windowize(frames(spark, sf_dir), None, W, stride), force=force,
    )
