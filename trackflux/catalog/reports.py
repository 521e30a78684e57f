"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.quantiles import exact_quantiles
from ..operators import reports as rep, runs, sampling as smp, scaling
from ..operators.context import recording_meta_lists
from ..plans import frames as plan
from ..schema import CONTINUOUS_FEATURES, KEYS, LC_FEATURES, WINDOW_FEATURES
from ..sources import events_view as view
from . import sql as S
from .ordered import debounced
from .registry import query

SIGNALS = ["vx", "vy", "ax", "ay"]
QN = {"p01": 0.01, "p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}


def _rnd(df, cols, d=6):
    return df.withColumns({c: rounded(F.col(c), d) for c in cols})


def long_sql(signals, source="kin", keys="recording_id, meta_drivingDirection, meta_class"):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{s}' AS signal, CAST({s} AS DOUBLE) AS x FROM {source} WHERE {s} IS NOT NULL" for s in signals
    )


def q_sql(x, names=QN, d=6):
    return ", ".join(f"{S.r(f'quantile_cont({x}, {p})', d)} AS {n}" for n, p in names.items())


STAT_SQL = f"""count(x) AS count, {S.r('avg(x)', 5)} AS mean, {S.r('stddev_pop(x)', 5)} AS std, {S.r('min(x)', 5)} AS min,
  {S.r('max(x)', 5)} AS max"""
STAT_COLS = ["mean", "std", "min", "max"]


@query("agg_per_recording_stats", S.with_(S.KIN + f", long AS ({long_sql(SIGNALS)})", f"""
SELECT recording_id, signal, {STAT_SQL}, {q_sql('x', d=5)} FROM long GROUP BY 1, 2"""))
def agg_per_recording_stats(spark, d):
    long = rep.unpivot(plan.kinematic(spark, d), ["recording_id"], SIGNALS)
    return _rnd(rep.grouped_stats(long, ["recording_id", "signal"], QN), [*STAT_COLS, *QN], 5)


SUMMARY = {"p10": 0.1, "median": 0.5, "p90": 0.9}


@query("agg_summary_stats", S.with_(S.KIN + f", long AS ({long_sql(['vx'])})", f"SELECT {STAT_SQL}, {q_sql('x', SUMMARY, 5)} FROM long"))
def agg_summary_stats(spark, d):
    long = rep.unpivot(plan.kinematic(spark, d), [], ["vx"]).select("x")
    return _rnd(rep.grouped_stats(long, [], SUMMARY), [*STAT_COLS, *SUMMARY], 5)


@query("agg_vehicle_std", S.with_(S.KIN, f"""
SELECT recording_id, vehicle_id, count(ax) AS n, {S.r('stddev_pop(ax)', 5)} AS std FROM kin
GROUP BY 1, 2 HAVING count(*) >= 60 AND count(ax) >= 60"""))
def agg_vehicle_std(spark, d):
    return _rnd(rep.vehicle_std(plan.kinematic(spark, d), "ax", 60), ["std"], 5)


@query("agg_subset_grid", S.with_(S.KIN + f""", long AS ({long_sql(SIGNALS)}),
t AS (
  SELECT signal, x, 'global' AS subset, NULL AS direction, NULL AS class FROM long
  UNION ALL SELECT signal, x, 'direction', CAST(meta_drivingDirection AS VARCHAR), NULL FROM long
  UNION ALL SELECT signal, x, 'class', NULL, meta_class FROM long
  UNION ALL SELECT signal, x, 'direction_class', CAST(meta_drivingDirection AS VARCHAR), meta_class FROM long)""", f"""
SELECT subset, CAST(direction AS VARCHAR) AS direction, CAST(class AS VARCHAR) AS class, signal, {STAT_SQL}, {q_sql('x', SUMMARY, 5)}
FROM t GROUP BY subset, direction, class, signal"""))
def agg_subset_grid(spark, d):
    return _rnd(rep.subset_grid(plan.kinematic(spark, d), SIGNALS), [*STAT_COLS, *SUMMARY], 5)


@query("agg_motion_centric", S.with_(S.KIN + f""", long AS ({long_sql(SIGNALS)}),
t AS (
  SELECT signal, x, 'global' AS subset, NULL AS class FROM long
  UNION ALL SELECT signal, x, 'class', meta_class FROM long)""", f"""
SELECT subset, CAST(NULL AS VARCHAR) AS direction, CAST(class AS VARCHAR) AS class, signal, {STAT_SQL}, {q_sql('x', SUMMARY, 5)}
FROM t GROUP BY subset, class, signal"""))
def agg_motion_centric(spark, d):
    """All vehicles aligned forward, so no split by direction."""
    subsets = {"global": [], "class": ["meta_class"]}
    return _rnd(rep.subset_grid(plan.kinematic(spark, d), SIGNALS, subsets), [*STAT_COLS, *SUMMARY], 5)


@query("agg_histogram", S.with_(S.KIN + """,
g AS (SELECT min(vx) AS lo, max(vx) AS hi, count(vx) AS n, (max(vx) - min(vx)) / 200 AS w,
  quantile_cont(vx, 0.01) AS q1, quantile_cont(vx, 0.99) AS q2 FROM kin)""", f"""
SELECT bin, count(vx) AS count, {S.r('min(lo) + bin * min(w)', 5)} AS "left", {S.r('count(vx) / (min(n) * min(w))', 8)} AS density,
  {S.r('min(q1)', 5)} AS view_lo, {S.r('min(q2)', 5)} AS view_hi
FROM (SELECT CAST(i AS INTEGER) AS bin, g.* FROM range(200) r(i), g) b LEFT JOIN kin ON CAST(least(floor((vx - b.lo) / b.w), 199) AS INTEGER) = b.bin
GROUP BY bin"""))
def agg_histogram(spark, d):
    df = rep.histogram(plan.kinematic(spark, d), "vx")
    return _rnd(_rnd(df, ["left", "view_lo", "view_hi"], 5), ["density"], 8)


@query("agg_value_counts", S.with_(S.KIN + """,
g AS (SELECT quantile_cont(vx, 0.01) AS lo, quantile_cont(vx, 0.99) AS hi FROM kin),
c AS (SELECT vx AS value, count(*) AS count FROM kin, g WHERE vx BETWEEN lo AND hi GROUP BY 1),
w AS (SELECT 0.9::DOUBLE * quantile_cont(gap, 0.5) AS bar_width FROM (SELECT value - lag(value) OVER (ORDER BY value) AS gap FROM c) WHERE gap > 0)""",
f"SELECT {S.r('value')} AS value, count, {S.r('bar_width')} AS bar_width FROM c, w"))
def agg_value_counts(spark, d):
    return _rnd(rep.value_counts(plan.kinematic(spark, d), "vx"), ["value", "bar_width"])


@query("agg_lc_per_trajectory", S.with_(S.KIN + """,
per AS (SELECT recording_id, vehicle_id, sum(CAST(lc <> 0 AS INTEGER)) AS n_lc, sum(CAST(lc = -1 AS INTEGER)) AS n_left,
  sum(CAST(lc = 1 AS INTEGER)) AS n_right FROM kin GROUP BY 1, 2),
dist AS (SELECT n_lc, count(*) AS vehicle_count FROM per GROUP BY 1)""", f"""
SELECT recording_id, vehicle_id, CAST(n_lc AS BIGINT) AS n_lc, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right,
  vehicle_count, {S.r('100.0::DOUBLE * vehicle_count / (SELECT sum(vehicle_count) FROM dist)')} AS vehicle_pct FROM per JOIN dist USING (n_lc)"""))
def agg_lc_per_trajectory(spark, d):
    per, dist = rep.lc_per_trajectory(plan.kinematic(spark, d))
    return _rnd(per.join(dist, "n_lc"), ["vehicle_pct"])


@query("agg_lc_frame_distribution", S.with_(S.KIN, f"""
SELECT v AS lc, count(lc) AS frames, {S.r('100.0::DOUBLE * count(lc) / (SELECT count(*) FROM kin)')} AS pct
FROM (VALUES (-1), (0), (1)) q(v) LEFT JOIN kin ON lc = v GROUP BY 1"""))
def agg_lc_frame_distribution(spark, d):
    return _rnd(rep.lc_frame_distribution(plan.kinematic(spark, d)), ["pct"])


EV = S.KIN + """,
ev2 AS (SELECT *, CASE lc WHEN -1 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END AS lc_side FROM kin WHERE lc <> 0),
sides(side) AS (VALUES ('left'), ('right'), ('unknown'))"""


@query("agg_side_counts", S.with_(EV, f"""
SELECT 'all' AS split_value, side, count(lc_side) AS count, {S.r('100.0::DOUBLE * count(lc_side) / (SELECT count(*) FROM ev2)')} AS pct
FROM sides LEFT JOIN ev2 ON lc_side = side GROUP BY side"""))
def agg_side_counts(spark, d):
    return _rnd(rep.side_counts(runs.lc_events(plan.kinematic(spark, d))), ["pct"])


@query("agg_side_counts_split", S.with_(EV + """,
ev3 AS (SELECT *, CASE WHEN vehicle_id % 11 <> 0 THEN meta_class END AS cls FROM ev2),
t AS (SELECT 'direction' AS split, CAST(meta_drivingDirection AS VARCHAR) AS value, lc_side FROM ev3
  UNION ALL SELECT 'class', cls, lc_side FROM ev3
  UNION ALL SELECT 'direction_class', meta_drivingDirection || '__' || cls, lc_side FROM ev3),
k AS (SELECT split, value, count(*) AS n FROM t GROUP BY 1, 2)""", f"""
SELECT k.split, k.value, side, count(t.lc_side) AS count, {S.r('100.0::DOUBLE * count(t.lc_side) / min(n)')} AS pct
FROM k CROSS JOIN sides LEFT JOIN t ON t.split = k.split AND t.value IS NOT DISTINCT FROM k.value AND t.lc_side = side GROUP BY 1, 2, 3"""))
def agg_side_counts_split(spark, d):
    ev = runs.lc_events(plan.kinematic(spark, d))
    ev = ev.withColumn("meta_class", F.when(F.col("vehicle_id") % 11 != 0, F.col("meta_class")))
    return _rnd(rep.side_counts_split(ev), ["pct"])


_POSE = [(-1, "m1")] + [(k, str(k)) for k in range(5)]


@query("agg_lane_pose_pivot", S.with_(S.KIN, f"""
SELECT meta_drivingDirection, meta_class, {", ".join(f"count(*) FILTER (WHERE lane_pos = {k}) AS n_{n}" for k, n in _POSE)},
  count(*) AS total, {", ".join(f"{S.r(f'count(*) FILTER (WHERE lane_pos = {k}) / count(*)')} AS frac_{n}" for k, n in _POSE)}
FROM kin GROUP BY 1, 2"""))
def agg_lane_pose_pivot(spark, d):
    df = rep.lane_pose_table(plan.kinematic(spark, d), ["meta_drivingDirection", "meta_class"])
    return _rnd(df, [f"frac_{n}" for _, n in _POSE])


@query("agg_mode_per_vehicle", S.with_(S.KIN + """,
c AS (SELECT recording_id, vehicle_id, lane_pos, count(*) AS n FROM kin GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY n DESC, lane_pos) AS rk FROM c)""", """
SELECT k.recording_id, k.vehicle_id, k.lane_pos, f.meta_class, f.meta_drivingDirection FROM k
JOIN kin f ON f.vehicle_id = k.vehicle_id AND f.frame = 1 WHERE rk = 1"""))
def agg_mode_per_vehicle(spark, d):
    return rep.lane_pose_mode(plan.kinematic(spark, d))


@query("agg_lane_spans", """
WITH r AS (SELECT DISTINCT user_id % 5 AS recording_id FROM events),
s(carriageway, lane, y0, y1) AS (VALUES ('upper', 0, 0.0::DOUBLE, 20.0::DOUBLE), ('upper', 1, 20, 40), ('upper', 2, 40, 60), ('upper', 3, 60, 80),
  ('lower', 0, 10, 30), ('lower', 1, 30, 50), ('lower', 2, 50, 70), ('lower', 3, 70, 90))
SELECT * FROM r CROSS JOIN s""")
def agg_lane_spans(spark, d):
    return rep.lane_spans(recording_meta_lists(view.recording_meta(spark, d)))


@query("agg_accel_thresholds", S.with_(S.KIN, f"""
SELECT {S.r('quantile_cont(ax, 0.1)')} AS p10, {S.r('quantile_cont(ax, 0.9)')} AS p90, {S.r('abs(quantile_cont(ax, 0.1))')} AS a_brake,
  {S.r('quantile_cont(ax, 0.9)')} AS a_accel FROM kin"""))
def agg_accel_thresholds(spark, d):
    return _rnd(rep.accel_thresholds(plan.kinematic(spark, d)), ["p10", "p90", "a_brake", "a_accel"])


def summary_sql(src: str, W: int, p: str) -> str:
    ok = f"t - {W // 2} >= 0 AND t + {W - W // 2} <= n"
    return f"""SELECT count(*) AS {p}events_total, count(*) FILTER (WHERE {ok}) AS {p}events_valid_centered,
  count(*) - count(*) FILTER (WHERE {ok}) AS {p}events_dropped_boundary,
  {S.r(f'count(*) FILTER (WHERE {ok}) / count(*)')} AS {p}valid_centered_rate,
  {", ".join(f"{S.r(f'quantile_cont(t / n, {q}) FILTER (WHERE {ok})')} AS {p}pos_{m}" for m, q in SUMMARY.items())} FROM {src}"""


@query("rep_lc_feasibility", S.with_(S.KIN + """,
len AS (SELECT vehicle_id, count(*) AS n FROM kin GROUP BY 1),
e AS (SELECT recording_id, vehicle_id, t FROM kin WHERE lc <> 0),""" + debounced("e", 10) + """,
ke AS (SELECT kept.*, n FROM kept JOIN len USING (vehicle_id) WHERE n >= 50),
wins AS (SELECT vehicle_id, unnest(generate_series(0, (n - 50) // 10)) AS k FROM len WHERE n >= 50)""", f"""
SELECT a.*, b.*, lcw AS lc_windows, total_windows - lcw AS kl_windows, {S.r('lcw / total_windows')} AS lc_window_fraction FROM
 (SELECT count(*) AS num_total, count(*) FILTER (WHERE n >= 50) AS num_usable, count(*) FILTER (WHERE n < 50) AS num_short,
   min(n) AS len_min, max(n) AS len_max, {S.r('quantile_cont(n, 0.1)')} AS len_p10, {S.r('quantile_cont(n, 0.5)')} AS len_median,
   {S.r('quantile_cont(n, 0.9)')} AS len_p90, CAST(sum(CASE WHEN n >= 50 THEN 1 + (n - 50) // 10 ELSE 0 END) AS BIGINT) AS total_windows FROM len) a,
 ({summary_sql('ke', 50, 'lc_')}) b,
 (SELECT count(*) AS lcw FROM wins WHERE EXISTS (SELECT 1 FROM ke WHERE ke.vehicle_id = wins.vehicle_id AND t >= k * 10 AND t < k * 10 + 50)) c""",
                               recursive=True))
def rep_lc_feasibility(spark, d):
    df = rep.lc_feasibility(plan.kinematic(spark, d).select(*KEYS, "t", "frame", "lc"), 50, 10, 10, view.longest_track(spark, d))
    return _rnd(df, ["len_p10", "len_median", "len_p90", "lc_valid_centered_rate", "lc_pos_p10", "lc_pos_median", "lc_pos_p90", "lc_window_fraction"])


def _deb(events: str, out: str) -> str:
    return debounced(events, 10).replace("deb AS", f"deb_{out} AS").replace("FROM deb ", f"FROM deb_{out} ").replace(
        "kept AS", f"kept_{out} AS")


def _centers(mask: str) -> str:
    return f"""SELECT recording_id, vehicle_id, (min(t) + max(t)) // 2 AS t
FROM (SELECT recording_id, vehicle_id, t, t - row_number() OVER (PARTITION BY vehicle_id ORDER BY t) AS g FROM kin WHERE {mask})
GROUP BY recording_id, vehicle_id, g HAVING count(*) >= 2"""


@query("rep_longitudinal_feasibility", S.with_(S.KIN + f""",
len AS (SELECT vehicle_id, count(*) AS n FROM kin GROUP BY 1),
eb AS ({_centers('ax < -20')}), ea AS ({_centers('ax > 20')}),""" + _deb("eb", "b") + "," + _deb("ea", "a") + """,
kb AS (SELECT x.*, n FROM kept_b x JOIN len USING (vehicle_id) WHERE n >= 50),
ka AS (SELECT x.*, n FROM kept_a x JOIN len USING (vehicle_id) WHERE n >= 50),""" + S.members(50, 10, "kin") + """,
pw AS (SELECT vehicle_id, window_idx, count(*) FILTER (WHERE ax < -20) AS nb, count(*) FILTER (WHERE ax > 20) AS na
  FROM win_rows GROUP BY 1, 2 HAVING count(*) = 50)""", f"""
SELECT x.*, b.*, a.*, w.bw AS brake_windows, w.aw AS accel_windows, {S.r('bw / total_windows')} AS brake_window_fraction,
  {S.r('aw / total_windows')} AS accel_window_fraction FROM
 (SELECT count(*) AS num_total, count(*) FILTER (WHERE n < 50) AS num_short,
   CAST(sum(CASE WHEN n >= 50 THEN 1 + (n - 50) // 10 ELSE 0 END) AS BIGINT) AS total_windows FROM len) x,
 ({summary_sql('kb', 50, 'brake_')}) b, ({summary_sql('ka', 50, 'accel_')}) a,
 (SELECT count(*) FILTER (WHERE nb >= 8) AS bw, count(*) FILTER (WHERE na >= 8) AS aw FROM pw) w""", recursive=True))
def rep_longitudinal_feasibility(spark, d):
    df = rep.longitudinal_feasibility(
        plan.kinematic(spark, d).select(*KEYS, "t", "frame", "ax"), 20.0, 20.0, 50, 10, 2, 10, 8, view.longest_track(spark, d)
    )
    cols = [f"{p}_{c}" for p in ("brake", "accel") for c in ("valid_centered_rate", "pos_p10", "pos_median", "pos_p90", "window_fraction")]
    return _rnd(df, cols)


FQ = {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
_LONGW = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x FROM windows WHERE {f} IS NOT NULL" for f in WINDOW_FEATURES)
_BIN = "feature IN (" + ", ".join(f"'{f}'" for f in LC_FEATURES) + ")"


@query("rep_window_feature_stats", S.with_(S.windows() + f", long AS ({_LONGW})", f"""
SELECT feature, {q_sql('x', FQ, 4)}, {S.r('avg(x)', 4)} AS mean, {S.r('stddev_pop(x)', 4)} AS std, count(*) AS count,
  CASE WHEN {_BIN} THEN {S.r('avg(CAST(x > 0.5 AS DOUBLE))')} END AS rate_1,
  CASE WHEN {_BIN} THEN {S.r('1 - avg(CAST(x > 0.5 AS DOUBLE))')} WHEN feature LIKE '%frac' THEN {S.r('avg(CAST(x <= 1e-12 AS DOUBLE))')} END AS mass_at_0,
  CASE WHEN {_BIN} THEN {S.r('avg(CAST(x > 0.5 AS DOUBLE))')} WHEN feature LIKE '%frac' THEN {S.r('avg(CAST(x >= 1 - 1e-12 AS DOUBLE))')} END AS mass_at_1,
  CASE WHEN feature LIKE '%frac' THEN count(*) FILTER (WHERE x > 1e-12 AND x < 1 - 1e-12) ELSE 0 END AS mid_count
FROM long GROUP BY feature"""))
def rep_window_feature_stats(spark, d):
    df = rep.window_feature_stats(plan.windows(spark, d), WINDOW_FEATURES)
    return _rnd(_rnd(df, [*FQ, "mean", "std"], 4), ["rate_1", "mass_at_0", "mass_at_1"])


def _gated(f: str) -> str:
    base, _, stat = f.rpartition("_")
    return f" AND {base}_vfrac > 0" if stat in ("min", "mean", "std") and f"{base}_vfrac" in WINDOW_FEATURES else ""


def scaler_sql(keys: str = "", source: str = "windows") -> str:
    """Long scaler (keys, feature, mean, std) over the continuous features."""
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{f}' AS feature, coalesce(avg({f}) FILTER (WHERE {f} IS NOT NULL{_gated(f)}), 0) AS mean, "
        f"CASE WHEN stddev_pop({f}) FILTER (WHERE {f} IS NOT NULL{_gated(f)}) >= 1e-6 THEN "
        f"stddev_pop({f}) FILTER (WHERE {f} IS NOT NULL{_gated(f)}) ELSE 1 END AS std FROM {source}{g}"
        for f in CONTINUOUS_FEATURES
    )


@query("agg_feature_scaler", S.with_(S.windows(), f"""
SELECT feature, {S.r('mean', 4)} AS mean, {S.r('std', 4)} AS std FROM ({scaler_sql()})
UNION ALL SELECT f, 0.0, 1.0 FROM (VALUES {", ".join(f"('{f}')" for f in LC_FEATURES)}) q(f)"""))
def agg_feature_scaler(spark, d):
    return _rnd(scaling.feature_scaler(plan.windows(spark, d), CONTINUOUS_FEATURES, unscaled=LC_FEATURES), ["mean", "std"], 4)


@query("agg_feature_scaler_class", S.with_(S.windows(), f"""
SELECT meta_class, feature, {S.r('mean', 4)} AS mean, {S.r('std', 4)} AS std FROM ({scaler_sql('meta_class')})"""))
def agg_feature_scaler_class(spark, d):
    return _rnd(scaling.feature_scaler(plan.windows(spark, d), CONTINUOUS_FEATURES, by=["meta_class"]), ["mean", "std"], 4)


_CHECKED = ["vx_last", "ax_last", "front_ttc_min", "d_left_lane_min"]
_CHECK_SQL = S.windows(_CHECKED + ["front_ttc_vfrac"])
_PICK = """picked AS (SELECT vehicle_id FROM (SELECT vehicle_id, row_number() OVER (ORDER BY md5('7|' || recording_id || ':' || vehicle_id)) - 1 AS rk,
  count(*) OVER () AS n FROM (SELECT DISTINCT recording_id, vehicle_id FROM windows)) WHERE n <= 50
  OR rk IN (SELECT CAST(floor(i * (n - 1) / 49.0::DOUBLE) AS BIGINT) FROM range(50) q(i)))"""


@query("agg_post_scale_check", S.with_(_CHECK_SQL + f""", {_PICK},
long AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, vehicle_id, {f} AS x, avg({f}) FILTER (WHERE true{_gated(f)}) OVER () AS m, stddev_pop({f}) FILTER (WHERE true{_gated(f)}) OVER () AS s FROM windows" for f in _CHECKED)})""", f"""
SELECT feature, {S.r('avg((x - m) / s)', 5)} AS mean, {S.r('stddev_pop((x - m) / s)', 5)} AS std, count(x) AS n
FROM long WHERE vehicle_id IN (SELECT vehicle_id FROM picked) GROUP BY 1"""))
def agg_post_scale_check(spark, d):
    w = plan.windows(spark, d)
    scaler = scaling.scaler_dict(scaling.feature_scaler(w, _CHECKED))
    keys = smp.evenly_spaced(w.select(*KEYS).distinct(), 50, smp.hash_key(7, *[F.col(k) for k in KEYS]))
    scaled = scaling.zscore_train(w, scaler).join(keys, KEYS, "left_semi")
    return _rnd(rep.post_scale_check(scaled, _CHECKED), ["mean", "std"], 5)


@query("agg_inverse_freq_weight", S.with_(S.windows(LC_FEATURES), f"""
SELECT count(*) AS total, count(*) FILTER (WHERE lc_left_present > 0.5 OR lc_right_present > 0.5) AS active,
  {S.r('least(1 / greatest(avg(CAST(lc_left_present > 0.5 OR lc_right_present > 0.5 AS DOUBLE)), 1e-6), 25)')} AS weight FROM windows"""))
def agg_inverse_freq_weight(spark, d):
    return _rnd(rep.inverse_freq_weight(plan.windows(spark, d), LC_FEATURES), ["weight"])


@query("agg_latency_summary", f"""
SELECT {S.r('avg(value)')} AS mean, {S.r('quantile_cont(value, 0.5)')} AS p50, {S.r('quantile_cont(value, 0.9)')} AS p90,
  {S.r('quantile_cont(value, 0.99)')} AS p99 FROM events""")
def agg_latency_summary(spark, d):
    ev = view.table(spark, d, "events").select("value")
    q = exact_quantiles(ev, [], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return _rnd(rep.one_row(ev.agg(F.avg("value").alias("mean")), q), ["mean", "p50", "p90", "p99"])


