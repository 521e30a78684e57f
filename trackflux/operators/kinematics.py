"""Projections and per-trajectory ordered features on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import finite, is_true
from ..functions.ordering import dense_index, in_segments
from ..functions.storage import checked_broadcast
from ..schema import FPS, NEIGHBOR_SLOTS, RISK_RENAMES


def prune_columns(df: DataFrame, *groups: list[str]) -> DataFrame:
    wanted = dict.fromkeys(c for g in groups for c in g)
    return df.select(*[c for c in wanted if c in df.columns])


def enforce_dtypes(df: DataFrame) -> DataFrame:
    """Typed casts by column role; non-finite numbers become NULL."""
    out = {}
    for name, dtype in df.dtypes:
        c = F.col(name)
        if name in ("recording_id", "vehicle_id", "frame") or name in NEIGHBOR_SLOTS:
            out[name] = c.try_cast("double").cast("bigint") if dtype == "string" else c.cast("bigint")
        elif name.endswith("_exists"):
            out[name] = F.coalesce(c.try_cast("double").cast("int"), F.lit(0))
        elif name in ("lc", "lane_id", "lane_pos", "meta_drivingDirection"):
            out[name] = c.try_cast("double").cast("int")
        elif name == "meta_class":
            out[name] = F.lower(F.trim(c))
        elif dtype in ("double", "float", "bigint", "int", "smallint", "tinyint") or dtype.startswith("decimal"):
            out[name] = finite(c.cast("double"))
    return df.withColumns(out)


def all_zero_columns(df: DataFrame, cols: list[str], tol: float = 1e-12) -> DataFrame:
    """(column, abs_sum, all_zero) in one pass."""
    sums = df.agg(*[F.coalesce(F.sum(F.abs(F.col(c).cast("double"))), F.lit(0.0)).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return sums.selectExpr(f"stack({len(cols)}, {pairs}) as (feature, abs_sum)").withColumn(
        "all_zero", F.col("abs_sum") < tol
    )


def box_center(df: DataFrame) -> DataFrame:
    w = F.col("width") / 2 if {"width", "height"} <= set(df.columns) else F.lit(0.0)
    h = F.col("height") / 2 if {"width", "height"} <= set(df.columns) else F.lit(0.0)
    return df.withColumns({"x_center": F.col("x") + w, "y_center": F.col("y") + h})


def direction_sign(df: DataFrame, dir_col: str = "meta_drivingDirection", vehicles: DataFrame | None = None) -> DataFrame:
    """Add ``dir_sign``, decided by the directions present in the recording.

    ``vehicles`` (recording_id, drivingDirection) saves a pass over all frames to find them.
    """
    d = F.col(dir_col)
    seen = df if vehicles is None else vehicles.select("recording_id", F.col("drivingDirection").alias(dir_col))
    present = seen.where(d.isNotNull()).groupBy("recording_id").agg(
        F.max((d == 0).cast("int")).alias("_d0"),
        F.max((d == 1).cast("int")).alias("_d1"),
        F.max((d == 2).cast("int")).alias("_d2"),
        F.max((~d.isin(0, 1, 2)).cast("int")).alias("_dx"),
    )
    one_two = (F.col("_d1") == 1) & (F.col("_d2") == 1) & (F.col("_d0") == 0) & (F.col("_dx") == 0)
    zero_one = (F.col("_d0") == 1) & (F.col("_d1") == 1) & (F.col("_d2") == 0) & (F.col("_dx") == 0)
    flips = present.select(
        "recording_id", F.when(one_two, F.lit(1)).when(zero_one, F.lit(0)).alias("_flip")
    )
    sign = F.when(is_true(d == F.col("_flip")), F.lit(-1)).otherwise(F.lit(1)).cast("int")
    flips = flips if vehicles is None else checked_broadcast(flips)
    return df.join(flips, "recording_id", "left").withColumn("dir_sign", sign).drop("_flip")


def vehicle_centric(df: DataFrame, flip_lateral: bool = True, flip_positions: bool = False) -> DataFrame:
    """Multiply kinematics by ``dir_sign`` so forward is always positive."""
    if "dir_sign" not in df.columns:
        df = df.withColumn("dir_sign", F.lit(1))
    cols = ["vx", "ax"] + (["vy", "ay"] if flip_lateral else [])
    cols += [c for c in ("x", "y", "x_center", "y_center") if c in df.columns] if flip_positions else []
    return df.withColumns({c: F.col(c) * F.col("dir_sign") for c in cols})


def speed() -> Column:
    return F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))


def rename_risk(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in RISK_RENAMES.items() if k in df.columns})


def neighbor_exists_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"{slot}_exists": (F.coalesce(F.col(c), F.lit(0)) > 0).cast("int") if c in df.columns else F.lit(0)
        for c, slot in NEIGHBOR_SLOTS.items()
    })


def with_index(df: DataFrame, longest: int | None = None) -> DataFrame:
    return df if "t" in df.columns else dense_index(df, F.col("frame"), longest=longest)


def lane_change_expr(window, lane: str = "lane_id", sign: Column | None = None) -> Column:
    lane_c = F.col(lane)
    s = F.coalesce(F.when(sign != 0, F.signum(sign)), F.lit(1)) if sign is not None else F.lit(1)
    return F.coalesce(F.signum(lane_c - F.lag(lane_c).over(window)) * s, F.lit(0.0)).cast("int")


def lane_change_sign(df: DataFrame, upper_direction: int = 1) -> Column | None:
    if "dir_sign" in df.columns:
        return F.col("dir_sign")
    if "meta_drivingDirection" in df.columns:
        return F.when(is_true(F.col("meta_drivingDirection") == upper_direction), -1).otherwise(1)
    return None


def jerk_expr(window, accel: str, dt: float) -> Column:
    step = (F.col(accel) - F.lag(accel).over(window)) / F.lit(dt)
    return F.when(F.col("t") == 0, F.lit(0.0)).otherwise(step)


def ordered_features(df: DataFrame, dt: float = 1.0 / FPS, longest: int | None = None) -> DataFrame:
    """``lc``, ``jerk_x`` and ``jerk_y`` in one bounded ordered pass."""
    if dt is None or dt <= 0:
        raise ValueError(f"dt must be positive, got {dt}")
    df = with_index(df, longest)
    sign = lane_change_sign(df)

    def steps(w):
        cols = {"lc": lane_change_expr(w, sign=sign) if "lane_id" in df.columns else F.lit(0)}
        for accel, jerk in (("ax", "jerk_x"), ("ay", "jerk_y")):
            cols[jerk] = jerk_expr(w, accel, dt) if accel in df.columns else F.lit(0.0)
        return [cols]

    return in_segments(df, steps, before=1, longest=longest)


def lane_change(df: DataFrame, longest: int | None = None) -> DataFrame:
    df = with_index(df, longest)
    sign = lane_change_sign(df)
    return in_segments(df, lambda w: [{"lc": lane_change_expr(w, sign=sign)}], before=1, longest=longest)


def pedal_turn(df: DataFrame, longest: int | None = None) -> DataFrame:
    """Driver input per frame from raw ax, mirrored for direction 1, and the change of y."""
    df = with_index(df, longest)
    flip = F.when(F.col("meta_drivingDirection") == 1, -1).otherwise(1)

    def steps(w):
        dy = (F.col("y") - F.coalesce(F.lag("y").over(w), F.col("y"))) * flip
        ax = F.col("ax") * flip
        return [{
            "pedal": F.when(ax > 0, "accelerate").when(ax < 0, "brake").otherwise("idle"),
            "turn": F.when(dy > 0, "right").when(dy < 0, "left").otherwise("straight"),
        }]

    return in_segments(df, steps, before=1, longest=longest)
