"""Latent-state model: scoring jobs and EM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.storage import materialise, scratch_path
from ..latent import em, emission, evaluation as ev, params as prm, recursion, starts
from ..latent.em import lane_change_weight
from ..operators import scaling, selection as sel
from ..plans import frames as plan, model
from ..schema import ACTION_NAMES, CONTINUOUS_FEATURES, EPS, KEYS, LC_FEATURES, STYLE_NAMES, WINDOW_FEATURES
from . import model_sql as Q, sql as S
from .registry import query
from .sets import SPLIT, split_table

P = Q.P
KT = [*KEYS, "t"]
KTS = ", ".join(KT)


def wide(df, col, keep, name="p", d=6):
    return df.select(*keep, *[rounded(F.col(col)[z], d).alias(f"{name}{z}") for z in range(P.K)])


# sources that concern the model ------------------------------------------------------

def _param_rows(p) -> str:
    rows = []
    for name, nd in prm._SHAPES.items():
        for idx, v in np.ndenumerate(getattr(p, name)):
            i, j, k = (list(idx) + [0, 0, 0])[:3]
            rows.append(f"('{name}', {i}, {j}, {k}, {v!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::"))
    return ", ".join(rows)


@query("sink_model_params", S.with_(Q.split_obs("train", SPLIT), f"""
SELECT param, i, j, k, {S.r('value', 5)} AS value FROM (VALUES {_param_rows(P)}) q(param, i, j, k, value)
UNION ALL SELECT 'scaler_mean/' || mc, CAST(i - 1 AS INTEGER), 0, 0, {S.r('m[i]', 5)} FROM (
  SELECT mc, [{", ".join(f"m_{f}" for f in CONTINUOUS_FEATURES)}] AS m, unnest(range(1, {len(CONTINUOUS_FEATURES) + 1})) AS i FROM sc)
UNION ALL SELECT 'scaler_std/' || mc, CAST(i - 1 AS INTEGER), 0, 0, {S.r('m[i]', 5)} FROM (
  SELECT mc, [{", ".join(f"d_{f}" for f in CONTINUOUS_FEATURES)}] AS m, unnest(range(1, {len(CONTINUOUS_FEATURES) + 1})) AS i FROM sc)"""))
def sink_model_params(spark, d):
    """Model and class-wise scalers of the training split, written and read again."""
    w = plan.windows(spark, d, model.MODEL_W, model.MODEL_STRIDE)
    train = sel.split_members(w, split_table(spark, d).where("split = 'train'"))
    by_class: dict = {}
    for r in model.class_scalers(train).collect():  # classes times features
        by_class.setdefault(r["meta_class"], {})[r["feature"]] = (r["mean"], r["std"])
    path = scratch_path(spark, "params")
    prm.save(spark, P, path, by_class)
    p, s = prm.load(spark, path)
    return prm.to_long(spark, p, s).withColumn("value", rounded(F.col("value"), 5))


@query("src_semantic_labels", """
WITH g AS (SELECT CAST(s AS INTEGER) AS s, CAST(a AS INTEGER) AS a FROM range(2) x(s), range(5) y(a)),
n AS (SELECT lane_id, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
  WHEN 'purchase' THEN 4 ELSE 5 END - 1 AS lane_id FROM events) GROUP BY 1)
SELECT s, a, n, CASE s WHEN 0 THEN 'low_interaction' ELSE 'high_interaction' END || '/' || CASE WHEN a > 3 THEN 'action_' || a
  ELSE [['free_flow', 'mild_brake', 'constrained_acceleration', 'stable_following'],
        ['strong_acceleration', 'lane_change', 'constrained_following', 'tactical_brake']][s + 1][a + 1] END AS label
FROM g JOIN n ON lane_id = a""")
def src_semantic_labels(spark, d):
    """Names joined to the states that occur; an unnamed state gets a numbered name."""
    named = spark.createDataFrame([(s, a, STYLE_NAMES[s], n) for (s, a), n in ACTION_NAMES.items()], "s int, a int, style string, action string")
    used = plan.kinematic(spark, d).groupBy((F.col("lane_id") - 1).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    used = used.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("s"), "a", "n").join(named, ["s", "a"], "left")
    style = sel.literal_name(F.col("s"), STYLE_NAMES)
    label = F.concat_ws("/", F.coalesce("style", style), F.coalesce("action", F.concat(F.lit("action_"), F.col("a").cast("string"))))
    return used.select("s", "a", "n", label.alias("label"))


_SCALED = [emission.scaled(c) for c in CONTINUOUS_FEATURES]


@query("src_split_windows", S.with_(Q.split_obs("test", SPLIT, " + 1e-12"), f"""
SELECT recording_id, vehicle_id, t AS window_idx, 'classwise' AS scaler_mode, {S.rounded_list(WINDOW_FEATURES, d=4)}, {S.rounded_list(_SCALED, d=4)}
FROM obs"""))
def src_split_windows(spark, d):
    """Test windows with all features raw and scaled by class; a member without windows is an error."""
    w = plan.windows(spark, d, model.MODEL_W, model.MODEL_STRIDE)
    out = model.split_observations(w, split_table(spark, d), ("test",), eps=1e-12)["test"]
    return out.select(*KEYS, "window_idx", F.lit("classwise").alias("scaler_mode"), *[rounded(F.col(c), 4).alias(c) for c in [*WINDOW_FEATURES, *_SCALED]])


# scoring -----------------------------------------------------------------------------

@query("hmm_emission_gauss_bern", S.with_(Q.emission(), f"SELECT {KTS}, {Q.explode('b', 'l', d=5)} FROM lb"))
def hmm_emission_gauss_bern(spark, d):
    return wide(model.emissions(spark, d), "logb", KT, "l", 5)


def experts():
    style = {"mean": P.mean[[0, 4]], "var": P.var[[1, 6]], "bern": P.bern[[2, 5]]}
    action = {"mean": P.mean[[1, 2, 3, 7]], "var": P.var[[0, 2, 4, 5]], "bern": P.bern[[0, 1, 6, 7]]}
    return style, action


def _poe_sql() -> str:
    style, action = experts()
    vs, va = emission.safe_var(style["var"]), emission.safe_var(action["var"])
    g, b, zc, zb = [], [], [], []
    for s in range(2):
        for a in range(4):
            z = s * 4 + a
            for i, f in enumerate(P.continuous):
                g += [f"({z}, '{f}', {Q.lit(e['mean'][k, i])}, {Q.lit(v[k, i])}, {Q.lit(-1)})" for e, v, k in ((style, vs, s), (action, va, a))]
                zc.append(f"({z}, '{f}', {Q.lit(style['mean'][s, i])}, {Q.lit(action['mean'][a, i])}, {Q.lit(vs[s, i] + va[a, i])})")
            for j, f in enumerate(P.binary):
                q1, q2 = (float(np.clip(e["bern"][k, j], EPS, 1 - EPS)) for e, k in ((style, s), (action, a)))
                b.append(f"({z}, '{f}', {Q.lit(q1)}, {Q.lit(q2)})")
    ln2pi = Q.lit(Q.LOG_2PI)
    return Q.OBS + Q.LONG + f""",
g(z, f, mu, va, k) AS (VALUES {", ".join(g)}), c(z, f, m1, m2, v) AS (VALUES {", ".join(zc)}), b(z, f, q1, q2) AS (VALUES {", ".join(b)}),
terms AS (
  SELECT {KTS}, z, -0.5 * ({ln2pi} + ln(va) + (x - mu) * (x - mu) / va) AS v FROM xlong JOIN g USING (f) WHERE x IS NOT NULL
  UNION ALL SELECT {KTS}, z, 0.5 * ({ln2pi} + ln(v) + (m1 - m2) * (m1 - m2) / v) FROM xlong JOIN c USING (f) WHERE x IS NOT NULL
  UNION ALL SELECT {KTS}, z, CASE WHEN x > 0.5 THEN ln(q1) + ln(q2) ELSE ln(1 - q1) + ln(1 - q2) END FROM blong JOIN b USING (f)
  UNION ALL SELECT {KTS}, z, -ln(q1 * q2 + (1 - q1) * (1 - q2)) FROM blong JOIN b USING (f) WHERE x IS NOT NULL),
lz AS (SELECT {KTS}, z, sum(v) AS l FROM terms GROUP BY ALL),
lb AS (SELECT {KTS}, list(l ORDER BY z) AS b FROM lz GROUP BY ALL)"""


@query("hmm_emission_poe", S.with_(_poe_sql(), f"SELECT {KTS}, {Q.explode('b', 'l', d=5)} FROM lb"))
def hmm_emission_poe(spark, d):
    obs = model.observations(spark, d)
    style, action = experts()
    lb = emission.log_emission_product(style, action, P.continuous, P.binary)
    return wide(obs.select(*KT, lb.alias("logb")), "logb", KT, "l", 5)


@query("hmm_forward_backward", S.with_(Q.smoothing_ctes(), f"""
SELECT recording_id, vehicle_id, count(*) AS n_windows, {S.r('sum(ll)', 5)} AS loglik, {S.r('sum(list_sum(g))')} AS gamma_sum,
  {S.r('sum(g[1] + g[2] + g[3] + g[4])')} AS style0 FROM gam GROUP BY 1, 2""", recursive=True))
def hmm_forward_backward(spark, d):
    post = recursion.smooth(model.feature_rows(spark, d, P), P.start("add"), P.kernel("add"), emit=emission.emitter(P))
    style, _ = ev.marginals(F.col("gamma"), P.S, P.A)
    return post.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_windows"), rounded(F.sum("ll"), 5).alias("loglik"),
        rounded(F.sum(sel.total(F.col("gamma")))).alias("gamma_sum"), rounded(F.sum(style[0])).alias("style0"),
    )


@query("hmm_posterior", S.with_(Q.smoothing_ctes(), f"""
SELECT {KTS}, {Q.explode('g', 'g')}, {S.r('g[1] + g[2] + g[3] + g[4]')} AS style0, {S.r('g[2] + g[6]')} AS action1 FROM gam""", recursive=True))
def hmm_posterior(spark, d):
    post = model.posteriors(spark, d)
    style, action = ev.marginals(F.col("gamma"), P.S, P.A)
    df = post.withColumns({"style0": rounded(style[0]), "action1": rounded(action[1])})
    return wide(df, "gamma", [*KT, "style0", "action1"], "g")


@query("hmm_forward_filter", S.with_(Q.emission() + Q.forward(), f"SELECT {KTS}, {S.r('ll', 5)} AS ll, {Q.explode('po')} FROM fwd", recursive=True))
def hmm_forward_filter(spark, d):
    df = model.filtered(spark, d).withColumns({"p": sel.belief_prob(F.col("post")), "ll": rounded(F.col("ll"), 5)})
    return wide(df, "p", [*KT, "ll"])


_LM = Q.mat(np.log(P.kernel("add")).T)  # by destination
_VSTEP = f"list_transform({_LM}, lambda c: list_max(list_transform(list_zip(c, v.d), lambda u: u[1] + u[2])))"


@query("hmm_viterbi", S.with_(Q.emission() + f""",
vit AS (
  SELECT {KTS}, list_transform(list_zip({Q.vec(np.log(P.start("add")))}, b), lambda u: u[1] + u[2]) AS d FROM lb WHERE t = 0
  UNION ALL
  SELECT l.recording_id, l.vehicle_id, l.t, list_transform(list_zip({_VSTEP}, l.b), lambda u: u[1] + u[2]) AS d
  FROM vit v JOIN lb l ON l.vehicle_id = v.vehicle_id AND l.t = v.t + 1),
back AS (
  SELECT v.recording_id, v.vehicle_id, v.t, list_position(d, list_max(d)) AS k FROM vit v
    JOIN (SELECT vehicle_id, max(t) AS t FROM lb GROUP BY 1) e ON e.vehicle_id = v.vehicle_id AND e.t = v.t
  UNION ALL
  SELECT recording_id, vehicle_id, t, list_position(s, list_max(s)) AS k FROM (
    SELECT v.recording_id, v.vehicle_id, v.t, list_transform(list_zip(({_LM})[b.k], v.d), lambda u: u[1] + u[2]) AS s
    FROM back b JOIN vit v ON v.vehicle_id = b.vehicle_id AND v.t = b.t - 1))""", f"""
SELECT {KTS}, CAST(k - 1 AS INTEGER) AS z, CAST((k - 1) // 4 AS INTEGER) AS s, CAST((k - 1) % 4 AS INTEGER) AS a FROM back""", recursive=True))
def hmm_viterbi(spark, d):
    path = recursion.best_path(model.feature_rows(spark, d, P), P.start("add"), P.kernel("add"), emit=emission.emitter(P))
    s, a = sel.z_to_sa(F.col("z"))
    return path.select(*KT, "z", s.alias("s"), a.alias("a"))


@query("hmm_dataset_loglik", S.with_(Q.emission() + Q.forward(P, "add", norm=False), f"""
SELECT {S.r('sum(ll)', 4)} AS loglik, count(*) AS n_rows, {S.r('sum(ll) / count(*)')} AS per_row FROM fwd""", recursive=True))
def hmm_dataset_loglik(spark, d):
    obs = model.observations(spark, d)
    ll, n = em.total_loglik(obs, P, recursion.longest_sequence(obs))
    return spark.createDataFrame([(ll, n)], "loglik double, n_rows bigint").select(
        rounded(F.col("loglik"), 4).alias("loglik"), "n_rows", rounded(F.col("loglik") / F.col("n_rows")).alias("per_row"))


def _powers(H: int) -> str:
    M, out, A = P.kernel("add"), [], np.eye(P.K)
    for h in range(1, H + 1):
        A = A @ M
        out += [f"({h}, {j}, {Q.vec(A[:, j])})" for j in range(P.K)]
    return ", ".join(out)


@query("hmm_predict_rollout", S.with_(Q.emission() + Q.forward(P, "add") + f""",
pw(h, j, c) AS (VALUES {_powers(3)}),
r AS (SELECT {KTS}, h, list(list_dot_product(c, po) ORDER BY j) AS w FROM fwd, pw GROUP BY ALL)""",
f"SELECT {KTS}, h, {', '.join(f'{S.r(f'w[{z + 1}] / list_sum(w)')} AS p{z}' for z in range(8))} FROM r", recursive=True))
def hmm_predict_rollout(spark, d):
    f = model.filtered(spark, d, "add")
    return wide(ev.rollout(f, P, 3), "belief", [*KT, "h"])


SEED = 123


@query("hmm_init_kmeans", S.with_(Q.OBS + Q.COMPLETE + Q.lloyd("km", P.K, SEED, max(P.S, P.A)), f"""
SELECT param, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 0 AS k, {S.r('value', 5)} AS value FROM km"""))
def hmm_init_kmeans(spark, d):
    start = starts.kmeans_start(model.observations(spark, d), P.continuous, P.binary, P.K, SEED, widest=max(P.S, P.A))
    p = P.with_(**start)
    return prm.to_long(spark, p).where(F.col("param").isin("mean", "var", "bern")).withColumn("value", rounded(F.col("value"), 5))


@query("hmm_init_product", S.with_(Q.OBS + Q.COMPLETE + Q.lloyd("ks", P.S, SEED, max(P.S, P.A)) + Q.lloyd("ka", P.A, SEED + 1, max(P.S, P.A)), f"""
SELECT expert, param, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {S.r('value', 5)} AS value
FROM (SELECT 'style' AS expert, * FROM ks UNION ALL SELECT 'action', * FROM ka)"""))
def hmm_init_product(spark, d):
    """Two runs of k-means: style experts with the seed, action experts with the next."""
    style, action = starts.product_start(model.observations(spark, d), P.continuous, P.binary, P.S, P.A, SEED)
    return expert_rows(spark, style, action).withColumn("value", rounded(F.col("value"), 5))


def expert_rows(spark, style, action):
    rows = [(n, part, int(i), int(j), float(v)) for n, e in (("style", style), ("action", action)) for part in prm.EXPERT_PARTS for (i, j), v in np.ndenumerate(e[part])]
    return spark.createDataFrame(rows, "expert string, param string, i int, j int, value double")


# EM ------------------------------------------------------------------------------------

def _stat_sql(weight_g: str = "", weight_x: str = "") -> str:
    g = f" * {weight_g}" if weight_g else ""
    x = f" * {weight_x}" if weight_x else ""
    return f""",
gl AS (SELECT {KTS}, unnest(range(8)) AS z, unnest(g) AS p FROM gam),
st AS (
  SELECT 'loglik' AS stat, 0 AS i, 0 AS j, 0 AS k, sum(ll) AS value FROM gam
  UNION ALL SELECT 'mass', z, 0, 0, sum(p{g}) FROM gl JOIN wt USING ({KTS}) GROUP BY z
  UNION ALL SELECT 'xi_s', i // 4, j // 4, 0, sum(x{x}) FROM xi JOIN wt USING (vehicle_id, t) GROUP BY 1, 2, 3
  UNION ALL SELECT 'xi_a', j // 4, i % 4, j % 4, sum(x{x}) FROM xi JOIN wt USING (vehicle_id, t) GROUP BY 1, 2, 3, 4)"""


_WT = f"""SELECT {KTS}, CASE WHEN lc_left_present > 0.5 OR lc_right_present > 0.5 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM obs"""
_WT_CTE = f""",
wt0 AS ({_WT}),
wt AS (SELECT *, (w + coalesce(lag(w) OVER (PARTITION BY vehicle_id ORDER BY t), w)) / 2 AS we FROM wt0)"""
_STAT_OUT = f"SELECT stat, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, {S.r('value', 4)} AS value FROM st"
_STATS = ["loglik", "mass", "xi_s", "xi_a"]


def _estep(spark, d, **kw):
    obs = model.observations(spark, d)
    return em.e_step_table(obs, P, recursion.longest_sequence(obs), **kw)


@query("em_expected_counts", S.with_(Q.smoothing_ctes() + Q.pairs() + _WT_CTE + _stat_sql(), _STAT_OUT, recursive=True))
def em_expected_counts(spark, d):
    return em.stats_long(_estep(spark, d), P, _STATS).withColumn("value", rounded(F.col("value"), 4))


@query("em_weighting_modes", S.with_(
    Q.smoothing_ctes() + Q.pairs() + _WT_CTE + _stat_sql("w", "we") + f""",
gA AS (SELECT * FROM st)""", _STAT_OUT.replace("FROM st", "FROM gA").replace("SELECT stat", "SELECT 'B' AS mode, stat"), recursive=True))
def em_weighting_modes(spark, d):
    weight = lane_change_weight(LC_FEATURES, 3.0)
    b = em.stats_long(_estep(spark, d, mode="B", weight=weight, edge="avg"), P, _STATS)
    return b.withColumn("value", rounded(F.col("value"), 4)).withColumn("mode", F.lit("B"))


@query("em_weighting_next", S.with_(
    Q.smoothing_ctes() + Q.pairs() + _WT_CTE + _stat_sql("w", "w"), _STAT_OUT.replace("SELECT stat", "SELECT 'B' AS mode, stat"), recursive=True))
def em_weighting_next(spark, d):
    """A step weighs as much as the window that it leads to."""
    b = em.stats_long(_estep(spark, d, mode="B", weight=lane_change_weight(LC_FEATURES, 3.0), edge="next"), P, _STATS)
    return b.withColumn("value", rounded(F.col("value"), 4)).withColumn("mode", F.lit("B"))


@query("em_weighting_tempered", S.with_(
    Q.smoothing_ctes(weight=_WT) + Q.pairs(src="lbw") + _WT_CTE + _stat_sql(), _STAT_OUT.replace("SELECT stat", "SELECT 'A' AS mode, stat"), recursive=True))
def em_weighting_tempered(spark, d):
    a = em.stats_long(_estep(spark, d, mode="A", weight=lane_change_weight(LC_FEATURES, 3.0)), P, _STATS)
    return a.withColumn("value", rounded(F.col("value"), 4)).withColumn("mode", F.lit("A"))


@query("em_update_transitions", S.with_(Q.smoothing_ctes() + Q.pairs() + _WT_CTE + _stat_sql() + """,
m AS (SELECT 'A_s' AS param, i, j, 0 AS k, value + 0.01 + CASE WHEN i = j THEN 5 ELSE 0 END AS v FROM st WHERE stat = 'xi_s'
  UNION ALL SELECT 'A_a', i, j, k, value + 0.01 + CASE WHEN j = k THEN 1 ELSE 0 END FROM st WHERE stat = 'xi_a'),
n AS (SELECT *, CASE param WHEN 'A_s' THEN sum(v) OVER (PARTITION BY param, i) ELSE sum(v) OVER (PARTITION BY param, i, j) END AS tot FROM m)""", f"""
SELECT param, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, {S.r('v / (tot + 1e-6)')} AS value FROM n""", recursive=True))
def em_update_transitions(spark, d):
    p, _ = em.update_transitions(P, em.read_stats(_estep(spark, d), P))
    return prm.to_long(spark, p).where(F.col("param").isin("A_s", "A_a")).withColumn("value", rounded(F.col("value")))


def _old(name: str) -> str:
    return ", ".join(f"({z}, '{f}', {Q.lit(getattr(P, name)[z, i])})" for z in range(8) for i, f in enumerate(P.continuous if name != "bern" else P.binary))


_FIDX = "list_position(" + Q._names(CONTINUOUS_FEATURES) + ", f) - 1"


@query("em_update_gaussian", S.with_(Q.smoothing_ctes() + f""",
gl AS (SELECT {KTS}, unnest(range(8)) AS z, unnest(g) AS p FROM gam),
ms AS (SELECT z, sum(p) AS mass FROM gl GROUP BY 1),
su AS (SELECT z, f, sum(p) AS w, sum(p * x) AS wx, sum(p * x * x) AS wxx FROM gl JOIN xlong USING ({KTS}) WHERE x IS NOT NULL GROUP BY 1, 2),
om(z, f, v) AS (VALUES {_old('mean')}), ov(z, f, v) AS (VALUES {_old('var')}),
u AS (SELECT om.z, om.f, om.v AS m0, ov.v AS v0, coalesce(mass >= 50 AND w > 1, false) AS ok, wx / (w + 1e-6) AS m1,
  greatest(wxx / (w + 1e-6) - (wx / (w + 1e-6)) * (wx / (w + 1e-6)), 1e-5) + 1e-6 AS v1
  FROM om JOIN ov USING (z, f) JOIN ms USING (z) LEFT JOIN su USING (z, f))""", f"""
SELECT 'mean' AS param, CAST(z AS INTEGER) AS i, CAST({_FIDX} AS INTEGER) AS j, {S.r('CASE WHEN ok THEN m1 ELSE m0 END', 5)} AS value FROM u
UNION ALL SELECT 'var', CAST(z AS INTEGER), CAST({_FIDX} AS INTEGER), {S.r('CASE WHEN ok THEN v1 ELSE v0 END', 5)} FROM u""", recursive=True))
def em_update_gaussian(spark, d):
    p = em.update_gaussian(P, em.read_stats(_estep(spark, d), P))
    return prm.to_long(spark, p).where(F.col("param").isin("mean", "var")).drop("k").withColumn("value", rounded(F.col("value"), 5))


@query("em_update_bernoulli", S.with_(Q.smoothing_ctes() + f""",
gl AS (SELECT {KTS}, unnest(range(8)) AS z, unnest(g) AS p FROM gam),
su AS (SELECT z, f, sum(p) AS w, sum(CASE WHEN x > 0.5 THEN p ELSE 0 END) AS o FROM gl JOIN blong USING ({KTS}) WHERE x IS NOT NULL GROUP BY 1, 2)""", f"""
SELECT 'bern' AS param, CAST(z AS INTEGER) AS i, CAST(CASE f WHEN 'lc_left_present' THEN 0 ELSE 1 END AS INTEGER) AS j,
  {S.r('least(greatest(o / (w + 1e-6), 1e-6), 1 - 1e-6)')} AS value FROM su""", recursive=True))
def em_update_bernoulli(spark, d):
    p = em.update_bernoulli(P, em.read_stats(_estep(spark, d), P))
    return prm.to_long(spark, p).where("param = 'bern'").drop("k").withColumn("value", rounded(F.col("value")))


@query("em_state_mass", S.with_(Q.smoothing_ctes() + """,
gl AS (SELECT unnest(range(8)) AS z, unnest(g) AS p FROM gam),
mz AS (SELECT 'joint' AS level, z AS state, sum(p) AS mass FROM gl GROUP BY z
  UNION ALL SELECT 'style', z // 4, sum(p) FROM gl GROUP BY z // 4 UNION ALL SELECT 'action', z % 4, sum(p) FROM gl GROUP BY z % 4)""", f"""
SELECT level, CAST(state AS INTEGER) AS state, {S.r('mass', 4)} AS mass, {S.r('mass / (sum(mass) OVER (PARTITION BY level))')} AS frac FROM mz""", recursive=True))
def em_state_mass(spark, d):
    post = model.posteriors(spark, d)
    return ev.state_mass(post, P.S, P.A).withColumns({"mass": rounded(F.col("mass"), 4), "frac": rounded(F.col("frac"))})


@query("em_update_poe")
def em_update_poe(spark, d):
    style, action = experts()
    obs = model.observations(spark, d)
    st = em.read_stats(em.e_step_table(obs, P, recursion.longest_sequence(obs), emit=emission.product_emitter(style, action)), P)
    s, a, history = em.update_product(style, action, st)
    losses = [("loss", name, 0, 0, float(v)) for name, v in (("first", history[0]), ("best", min(history)))]
    return expert_rows(spark, s, a).unionByName(spark.createDataFrame(losses, "expert string, param string, i int, j int, value double"))


#: What starts and EM read of a window.
READ = [*KT, *[emission.scaled(c) for c in P.continuous], *P.binary]


@query("em_fit")
def em_fit(spark, d):
    """Scalers, starts and EM on the training split, stopping by the validation split."""
    w = plan.windows(spark, d, model.MODEL_W, model.MODEL_STRIDE)
    parts = {n: materialise(df.select(*READ)) for n, df in model.split_observations(w, split_table(spark, d), ("train", "val")).items()}
    start = P.with_(**prm.sticky_start(), **starts.kmeans_start(parts["train"], P.continuous, P.binary, P.K, widest=max(P.S, P.A)))
    longest = max(recursion.longest_sequence(df) for df in parts.values())
    done = em.fit(parts["train"], parts["val"], start, longest, checkpoint_path=em.default_checkpoint(spark))
    cols = ["iteration", "train_loglik", "train_rows", "val_loglik", "val_rows", "switch_style", "switch_action", "delta_A_s", "delta_A_a"]
    rows = [tuple(float(h[c]) if "rows" not in c and c != "iteration" else int(h[c]) for c in cols) for h in done.history]
    types = ["int" if c == "iteration" else "bigint" if "rows" in c else "double" for c in cols]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(cols, types)))


@query("em_fit_product")
def em_fit_product(spark, d):
    """The product model from its k-means starts, fitted to convergence, stored with its experts, read again."""
    w = plan.windows(spark, d, model.MODEL_W, model.MODEL_STRIDE)
    train = materialise(model.split_observations(w, split_table(spark, d), ("train",))["train"].select(*READ))
    style, action = starts.product_start(train, P.continuous, P.binary, P.S, P.A, SEED)
    path = scratch_path(spark, "product")
    done = em.fit_product(train, style, action, P, recursion.longest_sequence(train), checkpoint_path=f"{path}-fit")
    prm.save(spark, done.params, path, experts=(done.style, done.action))
    return expert_rows(spark, *prm.load_experts(spark, path))
