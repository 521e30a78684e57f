"""Projections, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import kinematics as kin, selection as sel
from ..operators.scaling import zscore_masked, zscore_train
from ..plans import frames as plan
from ..schema import KEYS, LANE_POS_LABELS, NEIGHBOR_SLOTS
from ..sources import bundles, events_view as view
from . import sql as S
from .registry import query

K = "recording_id, vehicle_id, frame"
FK = [*KEYS, "frame"]


@query("prj_prune_columns", S.with_(S.KIN, f"SELECT {K}, lc, {S.r('vx')} AS vx, meta_class FROM kin"))
def prj_prune_columns(spark, d):
    df = kin.prune_columns(plan.kinematic(spark, d), FK, ["vx", "lc", "vx", "absent"], ["meta_class"])
    return df.withColumn("vx", num.rounded(F.col("vx")))


@query("prj_enforce_dtypes", S.with_(S.KIN, f"""
SELECT {K}, lane_id, {S.r('value')} AS x, CASE WHEN preceding_id > 0 THEN 1 ELSE 0 END AS front_exists, meta_class
FROM (SELECT *, x AS value FROM kin)"""))
def prj_enforce_dtypes(spark, d):
    raw = plan.kinematic(spark, d).select(
        F.col("recording_id").cast("double").cast("string").alias("recording_id"),
        F.col("vehicle_id").cast("double").alias("vehicle_id"),
        F.col("frame").cast("double").alias("frame"),
        F.col("lane_id").cast("string").alias("lane_id"),
        "x",
        F.when(F.col("preceding_id") > 0, "1.0").alias("front_exists"),
        F.upper("meta_class").alias("meta_class"),
    )
    return kin.enforce_dtypes(raw).withColumn("x", num.rounded(F.col("x")))


ZERO_COLS = ["vx", "vy", "ax", "ay", "jerk_x", "jerk_y", "lc", "front_exists", "right_rear_exists", "nothing"]


@query("chk_all_zero_columns", S.with_(S.FRAMES + ", f AS (SELECT *, 0.0::DOUBLE AS nothing FROM frames)", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {S.r(f'coalesce(sum(abs({c})), 0)', 3)} AS abs_sum, coalesce(sum(abs({c})), 0) < 1e-12 AS all_zero FROM f"
    for c in ZERO_COLS)))
def chk_all_zero_columns(spark, d):
    df = plan.frames(spark, d).withColumn("nothing", F.lit(0.0))
    return kin.all_zero_columns(df, ZERO_COLS).withColumn("abs_sum", num.rounded(F.col("abs_sum"), 3))


@query("prj_box_center", S.with_(S.KIN, f"SELECT {K}, {S.r('x_center')} AS x_center, {S.r('y_center')} AS y_center FROM kin"))
def prj_box_center(spark, d):
    df = kin.box_center(plan.base_tracks(spark, d))
    return df.select(*FK, *[num.rounded(F.col(c)).alias(c) for c in ("x_center", "y_center")])


@query("prj_direction_sign", S.with_(S.KIN, f"SELECT {K}, dir_sign FROM kin"))
def prj_direction_sign(spark, d):
    return kin.direction_sign(plan.base_tracks(spark, d)).select(*FK, "dir_sign")


@query("prj_vehicle_centric", S.with_(S.KIN, f"SELECT {K}, {S.rounded_list(['vx', 'vy', 'ax', 'ay'])} FROM kin"))
def prj_vehicle_centric(spark, d):
    df = kin.vehicle_centric(kin.direction_sign(plan.base_tracks(spark, d)))
    return df.select(*FK, *[num.rounded(F.col(c)).alias(c) for c in ("vx", "vy", "ax", "ay")])


@query("prj_speed", S.with_(S.KIN, f"SELECT {K}, {S.r('sqrt(vx * vx + vy * vy)')} AS speed FROM kin"))
def prj_speed(spark, d):
    return plan.kinematic(spark, d).select(*FK, num.rounded(kin.speed()).alias("speed"))


@query("prj_rename_risk", S.with_(S.TRACKS, f"""
SELECT {K}, {S.r('thw')} AS front_thw, {S.r('ttc')} AS front_ttc, {S.r('dhw')} AS front_dhw FROM tracks"""))
def prj_rename_risk(spark, d):
    df = kin.rename_risk(view.tracks(spark, d).select(*FK, "thw", "ttc", "dhw"))
    return df.select(*FK, *[num.rounded(F.col(c)).alias(c) for c in ("front_thw", "front_ttc", "front_dhw")])


@query("prj_neighbor_exists", S.with_(S.TRACKS, f"""
SELECT {K}, {", ".join(f"CAST({c} > 0 AS INTEGER) AS {s}_exists" for c, s in NEIGHBOR_SLOTS.items())} FROM tracks"""))
def prj_neighbor_exists(spark, d):
    df = kin.neighbor_exists_flags(view.tracks(spark, d).select(*FK, *NEIGHBOR_SLOTS))
    return df.select(*FK, *[f"{s}_exists" for s in NEIGHBOR_SLOTS.values()])


RAW_LABEL = """CASE event_id % 7 WHEN 0 THEN ' Car ' WHEN 1 THEN 'TRUCK' WHEN 2 THEN '1' WHEN 3 THEN '2.0'
  WHEN 4 THEN 'bus' WHEN 5 THEN 'Heavy truck' END"""


@query("prj_class_bucket", f"""
WITH l AS (SELECT event_id, {RAW_LABEL} AS label FROM events)
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'car' WHEN 1 THEN 'truck' WHEN 2 THEN 'car' WHEN 3 THEN 'truck'
  WHEN 5 THEN 'truck' END AS bucket FROM l""")
def prj_class_bucket(spark, d):
    df = view.table(spark, d, "events").select("event_id", F.expr(RAW_LABEL).alias("label"))
    return df.select("event_id", num.class_bucket(F.col("label")).alias("bucket"))


@query("prj_lc_int", """
SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN -1 WHEN 3 THEN 1 END AS INTEGER) AS lc FROM events""")
def prj_lc_int(spark, d):
    raw = F.expr("CASE event_id % 6 WHEN 0 THEN '0.5' WHEN 1 THEN '1.5' WHEN 2 THEN '-1.0' WHEN 3 THEN '1' WHEN 4 THEN 'x' END")
    return view.table(spark, d, "events").select("event_id", num.lc_int(raw).alias("lc"))


@query("prj_finite_numeric", """
SELECT event_id, CASE WHEN event_id % 5 < 2 THEN value END AS x FROM events""")
def prj_finite_numeric(spark, d):
    raw = F.expr("""CASE event_id % 5 WHEN 2 THEN 'NaN' WHEN 3 THEN 'Infinity' WHEN 4 THEN 'n/a' ELSE cast(value AS string) END""")
    return view.table(spark, d, "events").select("event_id", num.finite_number(raw).alias("x"))


@query("prj_lane_pos_label", S.with_(S.TRACKS, f"""
SELECT {K}, lane_pos, CASE lane_pos {" ".join(f"WHEN {k} THEN '{v}'" for k, v in LANE_POS_LABELS.items())} END AS label FROM tracks"""))
def prj_lane_pos_label(spark, d):
    other = F.concat(F.lit("lane_pos="), F.col("lane_pos").cast("string"))
    return view.tracks(spark, d).select(
        *FK, "lane_pos", num.literal_lookup(F.col("lane_pos"), LANE_POS_LABELS, other).alias("label")
    )


@query("prj_parse_vehicle_key", """
SELECT DISTINCT user_id % 5 AS recording_id, user_id AS vehicle_id,
  (user_id % 5) || ':' || user_id AS key, (user_id % 5) || '::' || user_id AS lane_key FROM events""")
def prj_parse_vehicle_key(spark, d):
    keys = view.table(spark, d, "events").select(
        F.concat_ws(":", (F.col("user_id") % 5).cast("double").cast("string"), F.col("user_id").cast("double").cast("string")).alias("k")
    ).distinct()
    ids = keys.select(*bundles.parse_vehicle_key(F.col("k")))
    text = [F.col(c).cast("string") for c in KEYS]
    return ids.select(*KEYS, F.concat_ws(":", *text).alias("key"), F.concat_ws("::", *text).alias("lane_key"))


@query("prj_joint_state_codec", """
WITH s AS (SELECT event_id, CAST(event_id % 9 - 1 AS INTEGER) AS z FROM events)
SELECT event_id, z, CAST(CASE WHEN z < 0 THEN -1 ELSE z // 4 END AS INTEGER) AS s,
  CAST(CASE WHEN z < 0 THEN -1 ELSE z % 4 END AS INTEGER) AS a, z AS back FROM s""")
def prj_joint_state_codec(spark, d):
    z = (F.col("event_id") % 9 - 1).cast("int")
    df = view.table(spark, d, "events").select("event_id", z.alias("z"))
    s, a = sel.z_to_sa(F.col("z"))
    df = df.select("*", s.alias("s"), a.alias("a"))
    return df.withColumn("back", sel.sa_to_z(F.col("s"), F.col("a")))


@query("prj_belief_prob", f"""
WITH l AS (SELECT event_id, [-value, -value / 2, -value / 3, -10.0::DOUBLE] AS b FROM events),
m AS (SELECT event_id, list_transform(b, lambda x: exp(x - list_max(b))) AS e FROM l)
SELECT event_id, {", ".join(f"{S.r(f'e[{i + 1}] / list_sum(e)')} AS p{i}" for i in range(4))} FROM m""")
def prj_belief_prob(spark, d):
    v = F.col("value")
    df = view.table(spark, d, "events").select("event_id", F.array(-v, -v / 2, -v / 3, F.lit(-10.0)).alias("b"))
    df = df.select("event_id", sel.belief_prob(F.col("b")).alias("p"))
    return df.select("event_id", *[num.rounded(F.col("p")[i]).alias(f"p{i}") for i in range(4)])


@query("prj_pedal_turn", S.with_(S.TRACKS, f"""
SELECT {K}, CASE WHEN ax * f > 0 THEN 'accelerate' WHEN ax * f < 0 THEN 'brake' ELSE 'idle' END AS pedal,
  CASE WHEN dy * f > 0 THEN 'right' WHEN dy * f < 0 THEN 'left' ELSE 'straight' END AS turn
FROM (SELECT *, CASE WHEN meta_drivingDirection = 1 THEN -1 ELSE 1 END AS f,
        y - coalesce(lag(y) OVER {S.W_TRACK}, y) AS dy FROM tracks)"""))
def prj_pedal_turn(spark, d):
    return kin.pedal_turn(plan.base_tracks(spark, d), view.longest_track(spark, d)).select(*FK, "pedal", "turn")


@query("flt_lane_pos", S.with_(S.TRACKS, f"""
SELECT {K}, lane_pos FROM tracks WHERE lane_pos IN (1, 2, 3) AND meta_class IS NOT NULL AND meta_drivingDirection IS NOT NULL"""))
def flt_lane_pos(spark, d):
    return sel.lane_pos_rows(plan.kinematic(spark, d), [1, 2, 3]).select(*FK, "lane_pos")


@query("flt_lane_violations", S.with_(S.TRACKS, f"""
SELECT {K}, {S.r('x')} AS x, {S.r('y')} AS y, CASE lane_pos WHEN 0 THEN 'left' WHEN 4 THEN 'right' ELSE 'unknown' END AS violation
FROM tracks WHERE lane_pos IN (0, 4, -1)"""))
def flt_lane_violations(spark, d):
    df = sel.lane_violations(plan.kinematic(spark, d))
    return df.select(*FK, num.rounded(F.col("x")).alias("x"), num.rounded(F.col("y")).alias("y"), "violation")


@query("flt_split_members", S.with_(S.TRACKS, f"""
SELECT {K} FROM tracks WHERE vehicle_id IN (
  SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY md5('123|' || (user_id % 5) || ':' || user_id)) - 1 AS rk,
    count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
  WHERE rk >= floor(0.8::DOUBLE * n))"""))
def flt_split_members(spark, d):
    from ..operators.sampling import split_assign

    frames = plan.kinematic(spark, d)
    split = split_assign(frames.select(*KEYS).distinct(), 0.7, 0.1, 123)
    return sel.split_members(frames, split.where("split = 'test'")).select(*FK)


@query("flt_interesting_vehicles", """
WITH m AS (SELECT user_id, count(*) AS n, max(value) - min(value) AS rng,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) % 4 AS lc FROM events GROUP BY 1)
SELECT user_id % 5 AS recording_id, user_id AS vehicle_id, n AS numFrames FROM m
WHERE n >= 60 AND (lc > 0 OR (lc = 0 AND rng > 200) OR (lc = 0 AND rng <= 200))""")
def flt_interesting_vehicles(spark, d):
    df = sel.interesting_vehicles(view.tracks_meta(spark, d), True, True, True, accel_threshold=200.0, min_frames=60)
    return df.select(*KEYS, "numFrames")


SCALER = "SELECT avg(vx) AS m, stddev_pop(vx) AS s FROM kin"


@query("scl_zscore_masked", S.with_(S.KIN, f"""
SELECT {K}, {S.r('(vx - m) / (s + 1e-12)')} AS vx, {S.r('ay')} AS ay FROM kin, ({SCALER})"""))
def scl_zscore_masked(spark, d):
    df = plan.kinematic(spark, d)
    stats = df.agg(F.avg("vx").alias("m"), F.stddev_pop("vx").alias("s")).first()
    df = zscore_masked(df, {"vx": (stats.m, stats.s)})
    return df.select(*FK, num.rounded(F.col("vx")).alias("vx"), num.rounded(F.col("ay")).alias("ay"))


@query("scl_zscore_train", S.with_(S.KIN, f"""
SELECT {K}, {S.r('(vx - m) / s')} AS vx, {S.r('ay')} AS ay FROM kin, ({SCALER})"""))
def scl_zscore_train(spark, d):
    df = plan.kinematic(spark, d)
    stats = df.agg(F.avg("vx").alias("m"), F.stddev_pop("vx").alias("s")).first()
    df = zscore_train(df, {"vx": (stats.m, stats.s), "ay": (0.0, 1.0)})
    return df.select(*FK, num.rounded(F.col("vx")).alias("vx"), num.rounded(F.col("ay")).alias("ay"))


@query("scl_zscore_classwise", S.with_(S.KIN, f"""
, c AS (SELECT meta_class, avg(vx) AS mx, stddev_pop(vx) AS sx, avg(ax) AS ma, stddev_pop(ax) AS sa FROM kin GROUP BY 1)
SELECT {K}, {S.r('(vx - mx) / sx')} AS vx, {S.r('(ax - ma) / sa')} AS ax FROM kin JOIN c USING (meta_class)"""))
def scl_zscore_classwise(spark, d):
    from ..operators.scaling import feature_scaler, zscore_classwise

    df = plan.kinematic(spark, d)
    scalers = feature_scaler(df, ["vx", "ax"], by=["meta_class"])
    out = zscore_classwise(df, scalers, ["vx", "ax"])
    return out.select(*FK, num.rounded(F.col("vx")).alias("vx"), num.rounded(F.col("ax")).alias("ax"))


