"""Trajectory view of the test tables: ``events`` rows become track frames.

Fixed values: the derivation is the fixture definition shared with the SQL
side, so column formulas here must stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordering import SEGMENT_ROWS, dense_index, in_segments, longest_key, spread
from ..schema import KEYS

LANE_CODES = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 5}
TRUCK_SEGMENTS = ["MACHINERY", "BUILDING"]
UPPER_MARKINGS = "0;20;40;60;80"
LOWER_MARKINGS = "[10;30;50;70;90]"
NEIGHBOR_OFFSETS = {
    "preceding_id": 5, "following_id": -5,
    "left_preceding_id": 10, "left_following_id": -10,
    "right_preceding_id": 15, "right_following_id": -15,
    "left_alongside_id": 20, "right_alongside_id": -20,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longest_track(spark: SparkSession, sf_dir: str) -> int:
    return longest_key(table(spark, sf_dir, "events"), ["user_id"])


def tracks(spark: SparkSession, sf_dir: str, longest: int | None = None) -> DataFrame:
    """Raw tracks: keys, dense ``t``, 1-based ``frame`` and unnormalised columns."""
    ev = table(spark, sf_dir, "events")
    if longest is None:
        longest = longest_track(spark, sf_dir)
    rows = ev.select(
        (F.col("user_id") % 5).alias("recording_id"),
        F.col("user_id").alias("vehicle_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
        (1 + F.expr("user_id div 5") % 2).cast("int").alias("drivingDirection"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        lane_code(F.col("event_type")).alias("lane_id"),
    )
    if longest <= SEGMENT_ROWS:  # longer tracks are shuffled by slices
        rows = spread(rows, KEYS, ev.count())
    rows = dense_index(rows, F.col("_us"), ["event_id"], longest=longest)
    rows = in_segments(
        rows,
        lambda w: [
            {"vx": F.when(F.col("drivingDirection") == 1, -F.col("value")).otherwise(F.col("value"))},
            {"ax": F.col("vx") - F.lag("vx").over(w), "vy": F.col("k") - F.lag("k").over(w)},
            {"ay": F.col("vy") - F.lag("vy").over(w)},
        ],
        before=2,
        longest=longest,
    )
    ids = {
        c: F.when(F.col("vehicle_id") + off > 0, F.col("vehicle_id") + off).otherwise(F.lit(0)).cast("bigint")
        for c, off in NEIGHBOR_OFFSETS.items()
    }
    return rows.select(
        *KEYS, "t", (F.col("t") + 1).alias("frame"), "event_id", "drivingDirection",
        F.col("value").alias("x"), F.col("k").alias("y"), F.lit(4.0).alias("width"), F.lit(2.0).alias("height"),
        "vx", "vy", "ax", "ay", "lane_id",
        (F.col("value") / 10).alias("thw"), (F.col("value") - 20).alias("ttc"), F.col("value").alias("dhw"),
        (F.col("event_id") % 6 - 1).cast("int").alias("lane_pos"),
        *[e.alias(c) for c, e in ids.items()],
    )


def lane_code(event_type):
    out = None
    for name, code in LANE_CODES.items():
        out = F.when(event_type == name, code) if out is None else out.when(event_type == name, code)
    return out.cast("int")


def tracks_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vehicle: class, direction, frame count, speed range, lane changes."""
    ev = table(spark, sf_dir, "events").select(
        "user_id", "value", F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("lc")
    )
    per = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("numFrames"),
        F.min("value").alias("minXVelocity"),
        F.max("value").alias("maxXVelocity"),
        (F.sum("lc") % 4).cast("bigint").alias("numLaneChanges"),
    )
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), vehicle_class(F.col("c_mktsegment")).alias("class")
    )
    return per.join(cust, "user_id", "left").select(
        (F.col("user_id") % 5).alias("recording_id"),
        F.col("user_id").alias("vehicle_id"),
        "class",
        (1 + F.expr("user_id div 5") % 2).cast("int").alias("drivingDirection"),
        "numFrames", "minXVelocity", "maxXVelocity", "numLaneChanges",
    )


def class_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle class and direction only; no pass over the events."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 5).alias("recording_id"),
        F.col("c_custkey").alias("vehicle_id"),
        vehicle_class(F.col("c_mktsegment")).alias("class"),
        (1 + F.expr("c_custkey div 5") % 2).cast("int").alias("drivingDirection"),
    )


def vehicle_class(segment):
    return F.when(segment.isin(TRUCK_SEGMENTS), "Truck").otherwise("Car")


def recording_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .select((F.col("user_id") % 5).alias("recording_id"))
        .distinct()
        .withColumn("upperLaneMarkings", F.lit(UPPER_MARKINGS))
        .withColumn("lowerLaneMarkings", F.lit(LOWER_MARKINGS))
    )
