"""Evaluation, labels, prediction metrics and explanations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..latent import emission, evaluation as ev, recursion
from ..operators import labels as lab, selection as sel
from ..plans import frames as plan, model
from ..functions.ordering import spread
from ..functions.storage import scratch_path
from ..schema import ACTION_NAMES, CONTINUOUS_FEATURES, FEATURE_GROUPS, KEYS, SEMANTIC_FEATURES, STYLE_NAMES, WINDOW_FEATURES
from ..sources import events_view as view
from ..sources.bundles import load_semantics, save_semantics
from . import model_sql as Q, sql as S
from .registry import query
from .sets import SPLIT, split_table

P = Q.P
KT = [*KEYS, "t"]
KTS = ", ".join(KT)
H = 10
STEP_SEC = model.MODEL_STRIDE / 25.0


def _rnd(df, cols, d=6):
    return df.withColumns({c: rounded(F.col(c), d) for c in cols})


def _q(x, names, d=6):
    return ", ".join(f"{S.r(f'quantile_cont({x}, {p})', d)} AS {n}" for n, p in names.items())


# likelihood --------------------------------------------------------------------------

@query("evl_online_nll", S.with_(Q.emission() + Q.forward(P, "add") + """,
per AS (SELECT vehicle_id, count(*) AS n, -avg(ll) AS nll FROM fwd GROUP BY 1)""", f"""
SELECT count(*) AS n_traj, CAST(sum(n) AS BIGINT) AS n_windows, {S.r('sum(nll * n) / sum(n)')} AS nll, {S.r('avg(nll)')} AS nll_mean,
  {_q('nll', {'nll_p10': .1, 'nll_median': .5, 'nll_p90': .9})} FROM per""", recursive=True))
def evl_online_nll(spark, d):
    df = ev.online_nll(model.filtered(spark, d, "add"))
    return _rnd(df, ["nll", "nll_mean", "nll_p10", "nll_median", "nll_p90"])


@query("evl_online_nll_test", S.with_(Q.emission(P, Q.split_obs("test", SPLIT)) + Q.forward(P, "add") + """,
per AS (SELECT vehicle_id, count(*) AS n, -avg(ll) AS nll FROM fwd GROUP BY 1)""", f"""
SELECT count(*) AS n_traj, CAST(sum(n) AS BIGINT) AS n_windows, {S.r('sum(nll * n) / sum(n)', 5)} AS nll, {S.r('avg(nll)', 5)} AS nll_mean,
  {_q('nll', {'nll_p10': .1, 'nll_median': .5, 'nll_p90': .9}, 5)} FROM per""", recursive=True))
def evl_online_nll_test(spark, d):
    """The test split, scaled by what the training split gives."""
    w = plan.windows(spark, d, model.MODEL_W, model.MODEL_STRIDE)
    obs = model.split_observations(w, split_table(spark, d), ("test",))["test"]
    rows = obs.select(*KEYS, "t", emission.feature_array(P.continuous, P.binary).alias("x"))
    post = recursion.forward_filter(rows, P.start("add"), P.kernel("add"), emit=emission.emitter(P))
    return _rnd(ev.online_nll(post), ["nll", "nll_mean", "nll_p10", "nll_median", "nll_p90"], 5)


@query("evl_anticipatory_nll", S.with_(Q.emission() + Q.forward(P, "add") + f""",
m AS (SELECT vehicle_id, max(t) + 1 AS n FROM lb GROUP BY 1),
roll AS (
  SELECT f.vehicle_id, f.t, 0 AS h, f.po AS q FROM fwd f JOIN m USING (vehicle_id) WHERE f.t >= 5 AND f.t + {H} < n
  UNION ALL
  SELECT vehicle_id, t, h + 1, list_transform(w, lambda x: x / list_sum(w)) FROM (
    SELECT vehicle_id, t, h, list_transform({Q.mat(P.kernel('add').T)}, lambda c: list_dot_product(c, q)) AS w FROM roll WHERE h < {H})),
s AS (SELECT r.h, ln(list_sum(list_transform(list_zip(q, b), lambda u: u[1] * exp(u[2] - mb)))) + mb AS ll
  FROM roll r JOIN lb l ON l.vehicle_id = r.vehicle_id AND l.t = r.t + r.h WHERE r.h > 0),
g AS (SELECT h, count(*) AS n, -avg(ll) AS nll FROM s GROUP BY 1)""", f"""
SELECT CAST(h AS INTEGER) AS h, n, {S.r('nll')} AS nll FROM g UNION ALL SELECT 0, max(n), {S.r('avg(nll)')} FROM g""", recursive=True))
def evl_anticipatory_nll(spark, d):
    terms = ev.anticipatory(model.filtered(spark, d, "add", keep_logb=True), P, H, 5, longest_windows(spark, d))
    return _rnd(ev.anticipatory_nll(terms), ["nll"])


def longest_windows(spark, d) -> int:
    """Checked bound on windows per trajectory: one more than (rows - W) / stride."""
    n = view.longest_track(spark, d)
    return max(0, 1 + (n - model.MODEL_W) // model.MODEL_STRIDE)


@query("evl_checkpoint", S.with_(Q.emission() + Q.forward(P, "add", norm=False) + """,
per AS (SELECT vehicle_id, sum(ll) AS ll, count(*) AS n FROM fwd GROUP BY 1)""", f"""
SELECT {S.r('sum(ll)', 4)} AS loglik, CAST(sum(n) AS BIGINT) AS n_rows, {S.r('sum(ll) / sum(n)')} AS loglik_per_row,
  {_q('ll / n', {'p05': .05, 'p50': .5, 'p95': .95})}, 698 AS n_params, {S.r('698.0::DOUBLE * ln(sum(n)) - 2 * sum(ll)', 3)} AS bic FROM per""", recursive=True))
def evl_checkpoint(spark, d):
    df = ev.checkpoint_summary(model.posteriors(spark, d), P)
    df = _rnd(df, ["loglik_per_row", "p05", "p50", "p95"])
    return df.withColumns({"loglik": rounded(F.col("loglik"), 4), "bic": rounded(F.col("bic"), 3)})


@query("evl_occupancy_keff", S.with_(Q.smoothing_ctes() + """,
gl AS (SELECT unnest(range(8)) AS z, unnest(g) AS p FROM gam),
o AS (SELECT 'joint' AS level, z AS k, sum(p) AS m FROM gl GROUP BY z UNION ALL SELECT 'style', z // 4, sum(p) FROM gl GROUP BY z // 4
  UNION ALL SELECT 'action', z % 4, sum(p) FROM gl GROUP BY z % 4),
n AS (SELECT level, k, m / sum(m) OVER (PARTITION BY level) AS p FROM o)""", f"""
SELECT level, {S.r('max(p)')} AS max_occupancy, {S.r('exp(-sum(p * ln(p)))')} AS k_eff, {S.r('min(p) FILTER (WHERE k = 0)')} AS p0 FROM n GROUP BY 1""", recursive=True))
def evl_occupancy_keff(spark, d):
    df = ev.occupancy(model.posteriors(spark, d), P.S, P.A)
    return _rnd(df.select("level", "max_occupancy", "k_eff", F.col("p")[0].alias("p0")), ["max_occupancy", "k_eff", "p0"])


def _ent(expr: str, k: int) -> str:
    return f"-list_sum(list_transform({expr}, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / {math.log(k)!r}"


_ENT = Q.smoothing_ctes() + f""",
en AS (SELECT {KTS}, {_ent('g', 8)} AS h_joint, {_ent('[g[1] + g[2] + g[3] + g[4], g[5] + g[6] + g[7] + g[8]]', 2)} AS h_style,
  {_ent('[g[1] + g[5], g[2] + g[6], g[3] + g[7], g[4] + g[8]]', 4)} AS h_action FROM gam),
md AS (SELECT recording_id, vehicle_id, median(h_joint) AS h_joint, median(h_style) AS h_style, median(h_action) AS h_action, count(*) AS n FROM en GROUP BY 1, 2)"""
_ENTQ = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


@query("evl_entropy", S.with_(_ENT, " UNION ALL ".join(
    f"SELECT '{c}' AS level, count(*) AS n_traj, {_q(c, _ENTQ)} FROM md" for c in ("h_joint", "h_style", "h_action")), recursive=True))
def evl_entropy(spark, d):
    med = ev.trajectory_entropy(ev.row_entropies(model.posteriors(spark, d), P.S, P.A))
    return _rnd(ev.entropy_summary(med), list(_ENTQ))


@query("srt_by_median_entropy", S.with_(_ENT, f"SELECT recording_id, vehicle_id, {S.r('h_joint')} AS median, n AS n_windows FROM md ORDER BY h_joint", recursive=True))
def srt_by_median_entropy(spark, d):
    rows = ev.row_entropies(model.posteriors(spark, d), P.S, P.A)
    med = ev.trajectory_entropy(rows.select(*KEYS, "t", "h_joint", F.lit(None).cast("double").alias("h_style"),
                                            F.lit(None).cast("double").alias("h_action"))).where("level = 'h_joint'")
    n = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_windows"))
    return med.join(n, KEYS).orderBy("median", *KEYS).select(*KEYS, rounded(F.col("median")).alias("median"), "n_windows")


# semantics ------------------------------------------------------------------------------

FEATS = SEMANTIC_FEATURES


def posteriors_obs(spark, d):
    obs = model.observations(spark, d).select(*KT, *FEATS)
    return model.posteriors(spark, d).select(*KT, "gamma").join(obs, KT)


_RAW_LONG = f""",
rl AS (SELECT {KTS}, unnest({Q._names(FEATS)}) AS feature, unnest([{", ".join(FEATS)}]) AS x FROM obs),
gl AS (SELECT {KTS}, unnest(range(8)) AS z, unnest(g) AS p FROM gam)"""
_STD = "sqrt(greatest({x2} / {w} - ({x1} / {w}) * ({x1} / {w}), 0))"


def _std(w, x1="x1", x2="x2"):
    return _STD.format(w=w, x1=x1, x2=x2)


_JOINT = Q.smoothing_ctes() + _RAW_LONG + f""",
mass AS (SELECT z, sum(p) AS mass FROM gl GROUP BY 1),
js AS (SELECT z, feature, sum(p) AS w, sum(p * x) AS x1, sum(p * x * x) AS x2 FROM gl JOIN rl USING ({KTS}) WHERE x IS NOT NULL GROUP BY 1, 2),
stats AS (SELECT z, feature, mass, x1 / w AS mean, {_std('w')} AS std FROM js JOIN mass USING (z))"""


@query("evl_state_feature_stats", S.with_(_JOINT, f"""
SELECT CAST(z AS INTEGER) AS z, feature, {S.r('mass', 4)} AS mass, {S.r('mean', 4)} AS mean, {S.r('std', 3)} AS std FROM stats""", recursive=True))
def evl_state_feature_stats(spark, d):
    df = ev.joint_semantics(posteriors_obs(spark, d), FEATS, P.K)
    return _rnd(_rnd(df, ["mass", "mean"], 4), ["std"], 3)


@query("evl_marginal_semantics", S.with_(Q.smoothing_ctes() + _RAW_LONG + f""",
lv AS (SELECT {KTS}, 'style' AS level, z // 4 AS state, sum(p) AS p FROM gl GROUP BY ALL
  UNION ALL SELECT {KTS}, 'action', z % 4, sum(p) FROM gl GROUP BY ALL),
mass AS (SELECT level, state, sum(p) AS mass FROM lv GROUP BY 1, 2),
js AS (SELECT level, state, feature, sum(p * coalesce(x, 0)) AS x1, sum(p * coalesce(x, 0) * coalesce(x, 0)) AS x2 FROM lv JOIN rl USING ({KTS}) GROUP BY 1, 2, 3)""", f"""
SELECT level, CAST(state AS INTEGER) AS state, feature, {S.r('mass', 4)} AS mass, {S.r('x1 / mass', 4)} AS mean, {S.r(_std('mass'), 3)} AS std
FROM js JOIN mass USING (level, state)""", recursive=True))
def evl_marginal_semantics(spark, d):
    df = ev.marginal_semantics(posteriors_obs(spark, d), FEATS, P.S, P.A)
    return _rnd(_rnd(df, ["mass", "mean"], 4), ["std"], 3)


_WIDE = ["vx_last", "ax_last", "front_ttc_min"]


@query("evl_semantics_report", S.with_(_JOINT, f"""
SELECT CAST(z AS INTEGER) AS z, {S.r('max(mass)', 4)} AS mass, {S.r('max(mass) / (SELECT sum(mass) FROM mass)')} AS mass_frac,
  max(mass) / (SELECT sum(mass) FROM mass) < 0.01 AS low_mass,
  {", ".join(f"{S.r(f'max({c}) FILTER (WHERE feature = {chr(39)}{f}{chr(39)})', 3)} AS {f}_{c}" for f in _WIDE for c in ("mean", "std"))}
FROM stats GROUP BY z""", recursive=True))
def evl_semantics_report(spark, d):
    stats = ev.joint_semantics(posteriors_obs(spark, d), FEATS, P.K)
    df = ev.semantics_report(stats, _WIDE, ["z"])
    return _rnd(df, [f"{f}_{c}" for f in _WIDE for c in ("mean", "std")], 3).withColumns(
        {"mass": rounded(F.col("mass"), 4), "mass_frac": rounded(F.col("mass_frac"))})


@query("evl_style_consistency", S.with_(_JOINT + """,
spread AS (SELECT feature, greatest(sum(mass * coalesce(std, 0)) / sum(mass), 1e-6) AS scale FROM stats GROUP BY 1),
d AS (SELECT a.z AS a, a.feature, a.mean - b.mean AS dif, scale FROM stats a JOIN stats b ON b.z = a.z + 4 AND b.feature = a.feature
  JOIN spread ON spread.feature = a.feature WHERE a.z < 4)""", f"""
SELECT 'zscore' AS mode, CAST(a AS INTEGER) AS a, {S.r('sqrt(avg((dif / scale) * (dif / scale)))', 4)} AS rmse FROM d GROUP BY a
UNION ALL SELECT 'raw', CAST(a AS INTEGER), {S.r('sqrt(avg(dif * dif))', 4)} FROM d GROUP BY a""", recursive=True))
def evl_style_consistency(spark, d):
    stats = ev.joint_semantics(posteriors_obs(spark, d), FEATS, P.K)
    parts = [ev.style_consistency(stats, P.A, m).select(F.lit(m).alias("mode"), "a", rounded(F.col("rmse"), 4).alias("rmse")) for m in ("zscore", "raw")]
    return parts[0].unionByName(parts[1])


# labels -----------------------------------------------------------------------------------

def label_sql() -> str:
    tight = "(front_exists_frac >= 0.8 AND (coalesce(front_thw_last <= 2, false) OR coalesce(front_ttc_min <= 60, false)))"
    brake = "ax_neg_frac >= 0.9 AND ax_last <= -0.15 AND front_exists_frac >= 0.8"
    return f"""CASE
  WHEN lc_left_present > 0.5 OR lc_right_present > 0.5 THEN 5
  WHEN abs(vy_last) >= 0.1 AND abs(ay_last) >= 0.1 AND abs(vy_slope) >= 0.003 AND ay_zero_frac <= 0.5 THEN 5
  WHEN {brake} AND (ax_last <= -0.25 OR vx_slope <= -0.01 OR front_thw_last <= 2 OR front_ttc_min <= 70) THEN 7
  WHEN {brake} THEN 1
  WHEN ax_pos_frac >= 0.9 AND ax_last >= 0.15 AND (front_exists_frac >= 0.5 OR {tight}) THEN 4
  WHEN ax_pos_frac >= 0.65 AND ax_last >= 0.08 AND front_exists_frac >= 0.8 THEN 2
  WHEN front_exists_frac >= 0.8 AND ((vx_last <= 21 AND jerk_x_p95 >= 0.75) OR {tight}) THEN 6
  WHEN front_exists_frac >= 0.8 AND abs(vx_slope) <= 0.008 AND abs(ax_last) <= 0.2 AND NOT {tight} THEN 3
  WHEN front_exists_frac < 0.5 THEN 0 ELSE -1 END"""


# thresholds that let every rule fire on the test tables: without lane changes flagged or
# lateral drift the later rules decide
NO_LANE_RULE = {"lc_flag_thresh": 2.0, "lateral_velocity_threshold": 1e9}


def label_sql_no_lane() -> str:
    return label_sql().replace("> 0.5 OR lc_right_present > 0.5", "> 2 OR lc_right_present > 2").replace("abs(vy_last) >= 0.1", "abs(vy_last) >= 1e9")


_SA = "CAST(CASE WHEN z < 0 THEN -1 ELSE z // 4 END AS INTEGER) AS s, CAST(CASE WHEN z < 0 THEN -1 ELSE z % 4 END AS INTEGER) AS a"
_OBSW = S.windows(None, model.MODEL_W, model.MODEL_STRIDE)


def labelled(spark, d, overrides=None):
    return lab.with_labels(model.observations(spark, d), overrides)


@query("lbl_rule_labels", S.with_(_OBSW, f"""
SELECT recording_id, vehicle_id, window_idx, z, {_SA}, z2 FROM (SELECT *, CAST({label_sql()} AS INTEGER) AS z, CAST({label_sql_no_lane()} AS INTEGER) AS z2 FROM windows)"""))
def lbl_rule_labels(spark, d):
    df = labelled(spark, d)
    s, a = sel.z_to_sa(F.col("z"))
    z2 = lab.rule_label(df.columns, NO_LANE_RULE)
    return df.select(*KEYS, "window_idx", "z", s.alias("s"), a.alias("a"), z2.alias("z2"))


_NAME = "CASE z " + " ".join(f"WHEN {s * 4 + a} THEN '{STYLE_NAMES[s]}/{n}'" for (s, a), n in ACTION_NAMES.items()) + " ELSE 'unknown' END"


@query("lbl_debug_values", S.with_(_OBSW, f"""
SELECT recording_id, vehicle_id, window_idx, z, {_SA}, {_NAME} AS name, {S.rounded_list(lab.RULE_INPUTS, d=4)}
FROM (SELECT *, CAST({label_sql_no_lane()} AS INTEGER) AS z FROM windows)"""))
def lbl_debug_values(spark, d):
    df = labelled(spark, d, NO_LANE_RULE)
    s, a = sel.z_to_sa(F.col("z"))
    return df.select(*KEYS, "window_idx", "z", s.alias("s"), a.alias("a"), sel.state_name(F.col("z")).alias("name"),
                     *[rounded(F.col(c), 4).alias(c) for c in lab.RULE_INPUTS])


@query("flagship", S.with_(S.windows(lab.RULE_INPUTS), f"""
SELECT meta_class, z, count(*) AS n FROM (SELECT meta_class, CAST({label_sql_no_lane()} AS INTEGER) AS z FROM windows) GROUP BY 1, 2"""))
def flagship(spark, d):
    """Frames to windows to rule labels to counts per vehicle class, with thresholds at which several rules fire."""
    from ..operators.windows import windowize

    w = windowize(plan.frames(spark, d), lab.RULE_INPUTS)
    return lab.with_labels(w, NO_LANE_RULE).groupBy("meta_class", "z").agg(F.count(F.lit(1)).alias("n"))


# prediction -----------------------------------------------------------------------------------

_GROUP = "CASE {z} WHEN 1 THEN 'b' WHEN 7 THEN 'b' WHEN 2 THEN 'a' WHEN 4 THEN 'a' WHEN 3 THEN 'f' WHEN 6 THEN 'f' END"
_PRED = Q.emission() + Q.forward() + f""",
lbl AS (SELECT {KTS}, CAST({label_sql_no_lane()} AS INTEGER) AS z FROM obs),
hz AS (SELECT {KTS}, list(z) OVER (PARTITION BY vehicle_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) AS ah FROM lbl),
pj AS (SELECT f.recording_id, f.vehicle_id, f.t, list_transform({Q.mat(P.kernel('clamp').T)}, lambda c: list_dot_product(c, po)) AS nx, ah
  FROM fwd f JOIN hz USING ({KTS}) WHERE f.t >= 4 AND len(ah) = {H}),
pd AS (SELECT {KTS}, CAST(list_position(nx, list_max(nx)) - 1 AS INTEGER) AS pred, ah[1] AS truth, ah FROM pj),
pu AS (SELECT {KTS}, pred, truth, unnest(ah) AS zz, unnest(range(1, {H + 1})) AS h FROM pd),
pred AS MATERIALIZED (SELECT {KTS}, pred, truth, CAST(min(h) FILTER (WHERE zz = pred OR ({_GROUP.format(z='zz')}) = ({_GROUP.format(z='pred')})) AS INTEGER) AS tte_steps
  FROM pu GROUP BY ALL)"""


def predicted(spark, d):
    truth = labelled(spark, d, NO_LANE_RULE).select(*KT, "z")
    rows = model.filtered(spark, d).select(*KT, "post").join(truth, KT)
    return ev.predictions(rows, P, H, 5, longest=longest_windows(spark, d))


@query("prd_next_state", S.with_(_PRED, f"""
SELECT {KTS}, pred, CAST(pred // 4 AS INTEGER) AS pred_s, CAST(pred % 4 AS INTEGER) AS pred_a, truth FROM pred""", recursive=True))
def prd_next_state(spark, d):
    s, a = sel.z_to_sa(F.col("pred"))
    return predicted(spark, d).select(*KT, "pred", s.alias("pred_s"), a.alias("pred_a"), "truth")


@query("met_exact_accuracy", S.with_(_PRED, f"SELECT count(*) AS n, {S.r('avg(CAST(pred = truth AS DOUBLE))')} AS accuracy FROM pred WHERE truth >= 0", recursive=True))
def met_exact_accuracy(spark, d):
    return _rnd(ev.exact_accuracy(predicted(spark, d)), ["accuracy"])


_CM = _PRED + """,
cm AS (SELECT CAST(x.range AS INTEGER) AS truth, CAST(y.range AS INTEGER) AS pred, (SELECT count(*) FROM pred p WHERE p.truth = x.range AND p.pred = y.range) AS n
  FROM range(8) x, range(8) y)"""


@query("met_confusion", S.with_(_CM, "SELECT truth, pred, n FROM cm", recursive=True))
def met_confusion(spark, d):
    return ev.confusion(predicted(spark, d), P.K)


@query("met_precision_recall_f1", S.with_(_CM + """,
c AS (SELECT z, tp, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, CASE WHEN ap > 0 THEN tp / ap ELSE 0 END AS recall, pp, ap FROM (
  SELECT x.range AS z, (SELECT sum(n) FROM cm WHERE truth = x.range AND pred = x.range) AS tp, (SELECT sum(n) FROM cm WHERE pred = x.range) AS pp,
    (SELECT sum(n) FROM cm WHERE truth = x.range) AS ap FROM range(8) x)),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM c),
mi AS (SELECT sum(tp) / sum(pp) AS p, sum(tp) / sum(ap) AS r FROM c)""", f"""
SELECT 'class_' || z AS average, {S.rounded_list(['precision', 'recall', 'f1'])} FROM f
UNION ALL SELECT 'macro', {S.r('avg(precision)')}, {S.r('avg(recall)')}, {S.r('avg(f1)')} FROM f
UNION ALL SELECT 'micro', {S.r('p')}, {S.r('r')}, {S.r('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} FROM mi""", recursive=True))
def met_precision_recall_f1(spark, d):
    return _rnd(ev.precision_recall_f1(ev.confusion(predicted(spark, d), P.K)), ["precision", "recall", "f1"])


@query("met_hit_at_horizon", S.with_(_PRED, f"""
SELECT count(*) AS n, count(tte_steps) AS hits, {S.r('avg(CAST(tte_steps IS NOT NULL AS DOUBLE))')} AS hit_rate FROM pred WHERE truth >= 0""", recursive=True))
def met_hit_at_horizon(spark, d):
    return _rnd(ev.hit_rate(predicted(spark, d)), ["hit_rate"])


@query("met_time_to_event", S.with_(_PRED, f"""
SELECT count(*) AS num_total, count(tte_steps) AS num_hits, {S.r(f'avg(tte_steps * {STEP_SEC!r}::DOUBLE)')} AS mean_tte_sec,
  {_q(f'tte_steps * {STEP_SEC!r}::DOUBLE', {'p25_tte_sec': .25, 'median_tte_sec': .5, 'p75_tte_sec': .75})} FROM pred WHERE truth >= 0""", recursive=True))
def met_time_to_event(spark, d):
    df = ev.time_to_event(predicted(spark, d), model.MODEL_STRIDE)
    return _rnd(df, ["mean_tte_sec", "p25_tte_sec", "median_tte_sec", "p75_tte_sec"])


@query("met_cumulative_hits", S.with_(_PRED + """,
k AS (SELECT * FROM pred WHERE truth >= 0),
st AS (SELECT CAST(range AS INTEGER) AS step FROM range(1, 11)),
ph AS (SELECT step, (SELECT count(*) FROM k WHERE tte_steps = step) AS hits FROM st)""", f"""
SELECT step, {S.r(f'step * {STEP_SEC!r}::DOUBLE')} AS seconds, hits, CAST(sum(hits) OVER (ORDER BY step) AS BIGINT) AS cumulative_hits,
  {S.r('sum(hits) OVER (ORDER BY step) / (SELECT count(*) FROM k)')} AS cumulative_rate, (SELECT count(*) FROM k) AS num_total FROM ph""", recursive=True))
def met_cumulative_hits(spark, d):
    return _rnd(ev.cumulative_hits(predicted(spark, d), H, model.MODEL_STRIDE), ["seconds", "cumulative_rate"])


# explanation ---------------------------------------------------------------------------------

_SOFT = "list_transform(b, lambda x: exp(x - mb))"


@query("xpl_explain", S.with_(Q.emission() + Q.forward() + f""",
e AS (SELECT {KTS}, pr, po, b, mb, list_transform({Q.mat(P.kernel('clamp').T)}, lambda c: list_dot_product(c, po)) AS nx FROM fwd JOIN lb USING ({KTS})),
x AS (SELECT *, list_position(pr, list_max(pr)) - 1 AS prz, list_position(po, list_max(po)) - 1 AS poz, list_position(b, list_max(b)) - 1 AS ez,
  list_position(nx, list_max(nx)) - 1 AS nz FROM e)""", f"""
SELECT {KTS}, CAST(prz AS INTEGER) AS prior_z, CAST(ez AS INTEGER) AS emission_z, CAST(poz AS INTEGER) AS posterior_z, CAST(nz AS INTEGER) AS forecast_z,
  {S.r('pr[prz + 1]')} AS prior_p, {S.r(f'1 / list_sum({_SOFT})')} AS emission_p, {S.r('po[poz + 1]')} AS posterior_p, {S.r('nx[nz + 1]')} AS forecast_p,
  {S.r('0.5 * list_sum(list_transform(list_zip(pr, po), lambda u: abs(u[1] - u[2])))')} AS tv, prz <> poz AS map_changed FROM x""", recursive=True))
def xpl_explain(spark, d):
    df = ev.explain(model.filtered(spark, d, keep_logb=True), P)
    probs = {f"{c}_p": rounded(F.array_max(c)) for c in ("prior", "emission", "posterior", "forecast")}
    zs = [f"{c}_z" for c in ("prior", "emission", "posterior", "forecast")]
    return df.select(*KT, *zs, *[v.alias(k) for k, v in probs.items()], rounded(F.col("tv")).alias("tv"), "map_changed")


_NAMES = [f"{STYLE_NAMES[s]}/{ACTION_NAMES[s, a]}" for s in range(P.S) for a in range(P.A)]


def _top_sql(x: str, name: str) -> str:
    """Names and rounded probabilities of the three most likely states of a list."""
    best = f"list_sort(list_transform(range(8), lambda i: {{'p': -{x}[i + 1], 'z': i}}))[1:3]"
    return (f"list_aggregate(list_transform({best}, lambda u: ({_NAMES})[u.z + 1]), 'string_agg', ', ') AS {name}_names, "
            f"list_aggregate(list_transform({best}, lambda u: CAST(CAST(round(-u.p * 1000) AS BIGINT) AS VARCHAR)), 'string_agg', ', ') AS {name}_permille")


_SCALED = [emission.scaled(c) for c in CONTINUOUS_FEATURES]


@query("xpl_record", S.with_(Q.emission() + Q.forward() + f""",
e AS (SELECT {KTS}, pr, po, list_transform(b, lambda x: exp(x - mb)) AS ew, list_transform({Q.mat(P.kernel('clamp').T)}, lambda c: list_dot_product(c, po)) AS nx
  FROM fwd JOIN lb USING ({KTS})),
n AS (SELECT {KTS}, list_transform(pr, lambda x: x / list_sum(pr)) AS pr, po, list_transform(ew, lambda x: x / list_sum(ew)) AS ew,
  list_transform(nx, lambda x: x / list_sum(nx)) AS nx FROM e)""", f"""
SELECT {KTS}, start_frame AS frame, {_top_sql('pr', 'prior')}, {_top_sql('ew', 'emission')}, {_top_sql('po', 'posterior')}, {_top_sql('nx', 'forecast')},
  {S.rounded_list(WINDOW_FEATURES, d=4)}, {S.rounded_list(_SCALED, d=4)} FROM n JOIN obs USING ({KTS})""", recursive=True))
def xpl_record(spark, d):
    """Full explanation of every window: named top states, frame number, all raw and scaled features."""
    path = scratch_path(spark, "semantics")
    save_semantics(spark, path, STYLE_NAMES, ACTION_NAMES)
    names = load_semantics(spark, path, P.S, P.A)
    post = model.filtered(spark, d, keep_logb=True)
    df = ev.explanation_record(ev.explain(post, P), names)
    features = model.observations(spark, d).select(*KT, F.col("start_frame").alias("frame"), *WINDOW_FEATURES, *_SCALED)
    parts = ("prior", "emission", "posterior", "forecast")
    permille = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * 1000).cast("bigint").cast("string")), ", ")
    n = features.count()
    return spread(df, KT, n).join(spread(features, KT, n), KT).select(
        *KT, "frame", *[F.array_join(f"{c}_names", ", ").alias(f"{c}_names") for c in parts], *[permille(F.col(f"{c}_probs")).alias(f"{c}_permille") for c in parts],
        *[rounded(F.col(c), 4).alias(c) for c in [*WINDOW_FEATURES, *_SCALED]])


_GROUPS = ", ".join(f"('{f}', '{g}')" for g, names in FEATURE_GROUPS.items() for f in names)


def _contrib_sql() -> str:
    gp = ", ".join(f"({z}, '{f}', {Q.lit(P.mean[z, i])}, {Q.lit(max(P.var[z, i], 1e-6))})" for z in range(8) for i, f in enumerate(P.continuous))
    return Q.emission() + Q.forward() + f""",
win AS (SELECT {KTS}, list_position(po, list_max(po)) - 1 AS z FROM fwd),
fg(f, grp) AS (VALUES {_GROUPS}), gv(z, f, mu, va) AS (VALUES {gp}),
tt AS (
  SELECT {KTS}, f, -0.5 * ({Q.lit(Q.LOG_2PI)} + ln(va) + (x - mu) * (x - mu) / va) AS v FROM win JOIN gv USING (z) JOIN xlong USING ({KTS}, f) WHERE x IS NOT NULL
  UNION ALL SELECT {KTS}, f, CASE WHEN x > 0.5 THEN ln(q) ELSE ln(1 - q) END FROM win JOIN bp USING (z) JOIN blong USING ({KTS}, f) WHERE x IS NOT NULL),
cells AS (SELECT {KTS}, z, grp FROM win CROSS JOIN (SELECT DISTINCT grp FROM fg)),
sm AS (SELECT {KTS}, grp, sum(v) AS score FROM tt JOIN fg USING (f) GROUP BY ALL)"""


@query("xpl_group_contrib", S.with_(_contrib_sql(), f"""
SELECT {KTS}, CAST(z AS INTEGER) AS z, grp AS feature_group, {S.r('coalesce(score, 0)', 5)} AS score FROM cells LEFT JOIN sm USING ({KTS}, grp)""", recursive=True))
def xpl_group_contrib(spark, d):
    z = sel.argmax(F.col("post"))
    win = model.filtered(spark, d).select(*KT, z.alias("z"))
    rows = model.feature_rows(spark, d, P).join(win, KT)
    return ev.group_contributions(rows, P, FEATURE_GROUPS).withColumn("score", rounded(F.col("score"), 5))
