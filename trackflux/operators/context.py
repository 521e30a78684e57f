"""Joins: metadata, neighbours in the same frame, lane boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import number_list
from ..functions.ordering import parts_for
from ..functions.storage import checked_broadcast
from ..schema import NEIGHBOR_SLOTS

STATE_COLS = ["x_center", "y_center", "vx", "vy", "lane_id"]
FRAME_KEY = ["recording_id", "frame", "vehicle_id"]


def join_tracks_meta(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join on vehicle, columns prefixed ``meta_``.

    No broadcast hint: the planner broadcasts while the table is under its size
    threshold, and beyond it splits hot vehicles in a sort-merge join.
    """
    renamed = meta.withColumnsRenamed(
        {c: f"meta_{c}" for c in meta.columns if c not in ("recording_id", "vehicle_id")}
    )
    if "meta_class" in renamed.columns:
        renamed = renamed.withColumn("meta_class", F.lower(F.trim("meta_class")))
    return frames.join(renamed, ["recording_id", "vehicle_id"], "left")


def join_recording_meta(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach one row per recording, columns prefixed ``rec_``; broadcast if a count shows few recordings."""
    cols = [c for c in meta.columns if c != "recording_id"]
    one = meta.groupBy("recording_id").agg(*[F.first(c).alias(f"rec_{c}") for c in cols])
    return frames.join(checked_broadcast(one), "recording_id", "left")


def neighbor_states(frames: DataFrame) -> DataFrame:
    """Per (recording, frame, vehicle): the state others look up."""
    return frames.select(
        "recording_id", "frame", F.col("vehicle_id").alias("_nid"),
        F.struct(*STATE_COLS).alias("_state"),
    )


def join_neighbor_state(frames: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """Attach the state of one neighbour column."""
    other = neighbor_states(frames)
    cond_id = F.when(F.col(id_col) > 0, F.col(id_col))
    joined = frames.withColumn("_nid", cond_id).join(other, ["recording_id", "frame", "_nid"], "left")
    return joined.select(
        *[c for c in frames.columns], *[F.col("_state")[s].alias(f"{prefix}_{s}") for s in STATE_COLS]
    )


def neighbor_context(frames: DataFrame, rows: int | None = None) -> DataFrame:
    """Existence flag and relative position / speed for all eight slots.

    Slots are unpivoted, looked up with one equi-join on the full
    (recording, frame, neighbour) key and folded back with one aggregation on
    the ego key, whose groups hold at most eight rows. ``rows`` is the row count, if known: partitions follow it.
    """
    slots = {c: s for c, s in NEIGHBOR_SLOTS.items() if c in frames.columns}
    asks = frames.select(
        *FRAME_KEY,
        F.explode(F.filter(
            F.array(*[F.struct(F.lit(i).alias("slot"), F.col(c).cast("bigint").alias("nid")) for i, c in enumerate(slots)]),
            lambda a: a["nid"] > 0,
        )).alias("_ask"),
    ).select(*FRAME_KEY, F.col("_ask.slot").alias("_slot"), F.col("_ask.nid").alias("_nid"))
    read = ["x_center", "y_center", "vx", "vy"]
    # the answers of one vehicle lie apart, so they are shuffled as they are and become columns where they meet
    found = asks.join(neighbor_states(frames), ["recording_id", "frame", "_nid"]).select(
        *FRAME_KEY, "_slot", *[F.col("_state")[c].alias(f"_{c}") for c in read])
    parts = rows and parts_for(rows, frames.sparkSession.sparkContext.defaultParallelism)
    found = found.repartition(*([parts] if parts else []), *FRAME_KEY)
    # numbers one by one: a maximum of structs could not be hash aggregated
    per_ego = found.groupBy(*FRAME_KEY).agg(
        *[F.max(F.when(F.col("_slot") == i, F.col(f"_{c}"))).alias(f"_{s}_{c}") for i, s in enumerate(slots.values()) for c in read]
    )
    out = frames.join(per_ego, FRAME_KEY, "left")
    sign = F.col("dir_sign") if "dir_sign" in frames.columns else F.lit(1)
    cols = {}
    for s in slots.values():
        n = {c: F.col(f"_{s}_{c}") for c in read}
        cols[f"{s}_exists"] = n["x_center"].isNotNull().cast("int")
        cols[f"{s}_dx"] = (n["x_center"] - F.col("x_center")) * sign
        cols[f"{s}_dy"] = (n["y_center"] - F.col("y_center")) * sign
        cols[f"{s}_dvx"] = n["vx"] - F.col("vx")
        cols[f"{s}_dvy"] = n["vy"] - F.col("vy")
    return out.withColumns(cols).drop(*[f"_{s}_{c}" for s in slots.values() for c in read])


def lane_distances(
    frames: DataFrame,
    y: str = "y_center",
    direction: str = "meta_drivingDirection",
    upper: str = "rec_upperLaneMarkings",
    lower: str = "rec_lowerLaneMarkings",
) -> DataFrame:
    """Distances to the lane boundaries left and right of the vehicle."""
    d, yc = F.col(direction), F.col(y)
    marks = F.when(d == 1, _markings(frames, upper)).when(d == 2, _markings(frames, lower))
    out = frames.withColumn("_marks", marks)
    m = F.col("_marks")
    j = F.size(F.filter(m, lambda v: v <= yc))
    out = out.withColumn("_j", F.when(m.isNotNull() & yc.isNotNull() & (j >= 1) & (j < F.size(m)), j))
    lo, hi = F.element_at("_marks", F.col("_j")), F.element_at("_marks", F.col("_j") + 1)
    return out.withColumns({
        "d_left_lane": F.when(d == 2, yc - lo).otherwise(hi - yc),
        "d_right_lane": F.when(d == 2, hi - yc).otherwise(yc - lo),
    }).drop("_marks", "_j")


def _markings(frames: DataFrame, name: str) -> Column:
    if name not in frames.columns:
        return F.lit(None).cast("array<double>")
    c = F.col(name)
    return c if dict(frames.dtypes)[name].startswith("array") else number_list(c)


def recording_meta_lists(meta: DataFrame) -> DataFrame:
    """Marking strings of the first row per recording as sorted lists."""
    one = meta.groupBy("recording_id").agg(
        F.first("upperLaneMarkings").alias("u"), F.first("lowerLaneMarkings").alias("l")
    )
    return one.select("recording_id", number_list(F.col("u")).alias("upper"), number_list(F.col("l")).alias("lower"))


def frame_to_window(frame: Column, start: Column, n_windows: Column, stride: int) -> Column:
    """Nearest window index of an absolute frame (half to even, clamped); error outside."""
    last = start + (n_windows - 1) * stride
    idx = F.greatest(F.lit(0), F.least(n_windows - 1, F.bround((frame - start) / F.lit(float(stride))).cast("bigint")))
    bad = F.raise_error(F.concat(F.lit("frame outside window range: "), frame.cast("string")))
    return F.when((frame < start) | (frame > last), bad.cast("bigint")).otherwise(idx)
