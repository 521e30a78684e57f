"""User functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.numeric import rounded
from ..operators import windows as win
from ..plans import frames as plan
from ..schema import KEYS
from . import sql as S
from .registry import query

_SLOPE = S.windows(["vx_slope"]).replace(S.FRAMES, S.KIN).replace("FROM frames)", "FROM kin)")


@query("udf_masked_slope", S.with_(_SLOPE, f"SELECT recording_id, vehicle_id, window_idx, {S.r('vx_slope')} AS slope FROM windows"))
def udf_masked_slope(spark, d):
    m = win.window_members(plan.kinematic(spark, d).select(*KEYS, "t", "frame", "vx"), 50, 10)
    m = m.withColumn("i", F.col("i").cast("double"))
    full = m.groupBy(*KEYS, "window_idx").agg(F.count(F.lit(1)).alias("n")).where("n = 50").drop("n")
    df = m.join(full, [*KEYS, "window_idx"], "left_semi").groupBy(*KEYS, "window_idx").agg(udfs.udf_masked_slope("vx", "i").alias("slope"))
    return df.select(*KEYS, "window_idx", rounded(F.col("slope")).alias("slope"))


@query("udtf_windows", S.with_(S.TRACKS, """
, n AS (SELECT recording_id, vehicle_id, count(*) AS n FROM tracks GROUP BY 1, 2),
k AS (SELECT *, unnest(generate_series(0, (n - 50) // 10)) AS window_idx FROM n WHERE n >= 50)
SELECT recording_id, vehicle_id, window_idx, window_idx * 10 AS start, window_idx * 10 + 50 AS stop FROM k"""))
def udtf_windows(spark, d):
    """One call per slice of a trajectory's windows, so that a long one is spread over tasks."""
    per_call = 4096
    n = plan.kinematic(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("n"))
    last = F.greatest(F.floor((F.col("n") - 50) / 10 / per_call), F.lit(0)).cast("int")
    calls = n.withColumn("slice", F.explode(F.sequence(F.lit(0), last)))
    udtf = udfs.WindowsOf(F.col("n").outer(), F.lit(50), F.lit(10), (F.col("slice") * per_call).outer(), F.lit(per_call))
    return calls.lateralJoin(udtf).select(*KEYS, "window_idx", "start", "stop")
