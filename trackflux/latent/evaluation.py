"""Likelihood, occupancy, entropy, semantics, prediction metrics and explanations."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordering import in_segments
from ..functions.quantiles import exact_quantiles
from ..operators.reports import one_row
from ..operators.selection import argmax, belief_prob, let, normalised, top_k, total
from ..schema import FPS, KEYS, LEGACY_MANEUVER_GROUPS, MANEUVER_GROUPS
from .emission import group_scores
from .params import Params

PCT = {"p10": 0.1, "median": 0.5, "p90": 0.9}


# likelihood -----------------------------------------------------------------------

def trajectory_nll(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_windows"), (-F.avg("ll")).alias("nll"))


def online_nll(filtered: DataFrame) -> DataFrame:
    """Weighted NLL per window and its spread over trajectories."""
    per = trajectory_nll(filtered)
    w = F.sum(F.col("nll") * F.col("n_windows")) / F.sum("n_windows")
    basic = per.agg(F.count(F.lit(1)).alias("n_traj"), F.sum("n_windows").alias("n_windows"), w.alias("nll"), F.avg("nll").alias("nll_mean"))
    return one_row(basic, exact_quantiles(per, [], "nll", {f"nll_{k}": q for k, q in PCT.items()}))


def step_columns(belief: Column, kernel: np.ndarray) -> Column:
    """One kernel step of a probability array, normalised; the kernel is a literal."""
    K = len(kernel)

    def step(b: Column) -> Column:
        cell = lambda j: reduce(lambda x, y: x + y, [b[i] * F.lit(float(kernel[i, j])) for i in range(K)])
        return F.array(*[cell(j) for j in range(K)])

    return normalised(let(belief, step))


def rollout(beliefs: DataFrame, p: Params, H: int, smoothing: str = "add", post: str = "post") -> DataFrame:
    """Belief h = 1..H steps ahead without observations, one row per (window, h)."""
    M = p.kernel(smoothing)
    powers, P = [], np.eye(p.K)
    for _ in range(H):
        P = P @ M
        P = P / P.sum(axis=1).max()  # a common factor drops out below
        powers.append(P)
    table = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in Q[:, j]]) for j in range(p.K)]) for Q in powers])
    prob = belief_prob(F.col(post))
    rows = beliefs.select(*KEYS, "t", prob.alias("_b"), F.posexplode(table).alias("_h", "_cols"))
    dot = lambda c: F.aggregate(F.zip_with("_b", c, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    raw = rows.select(*KEYS, "t", (F.col("_h") + 1).alias("h"), F.transform("_cols", dot).alias("_r"))
    return raw.select(*KEYS, "t", "h", normalised(F.col("_r")).alias("belief"))


def anticipatory(filtered_logb: DataFrame, p: Params, H: int, warmup: int, longest: int | None = None) -> DataFrame:
    """log p(o_{t+h} | o_{<=t}) per (window, h) for t >= warmup and t + H inside the trajectory.

    ``filtered_logb`` has ``post`` (log belief) and ``logb`` per window.
    """
    ahead = in_segments(
        filtered_logb.select(*KEYS, "t", "post", "logb"),
        lambda w: [{"_next": F.collect_list("logb").over(w.rowsBetween(1, H))}],
        after=H, longest=longest,
    ).where((F.col("t") >= warmup) & (F.size("_next") == H))
    M = p.kernel("add")
    K = p.K
    schema = ", ".join(f"{k} bigint" for k in KEYS) + ", t bigint, h int, ll double"

    def score(it):
        for pdf in it:
            if not len(pdf):
                continue
            b = np.stack(pdf["post"].to_list()).astype(float)
            nxt = np.array([np.concatenate([np.asarray(v, dtype=float) for v in r]) for r in pdf["_next"]]).reshape(len(pdf), H, K)
            b = np.exp(b - b.max(axis=1, keepdims=True))
            out = []
            for h in range(H):
                b = b @ M
                b /= b.sum(axis=1, keepdims=True)
                top = nxt[:, h].max(axis=1, keepdims=True)
                out.append(top[:, 0] + np.log((b * np.exp(nxt[:, h] - top)).sum(axis=1)))
            res = pdf[[*KEYS, "t"]]
            yield pd.concat([res.assign(h=np.int32(h + 1), ll=v) for h, v in enumerate(out)], ignore_index=True)

    return ahead.select(*KEYS, "t", "post", "_next").mapInPandas(score, schema)


def anticipatory_nll(terms: DataFrame) -> DataFrame:
    """Mean NLL per step ahead; ``h`` 0 is the mean over all steps."""
    by_h = terms.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (-F.avg("ll")).alias("nll"))
    overall = by_h.agg(F.lit(0).alias("h"), F.max("n").alias("n"), F.avg("nll").alias("nll"))
    return by_h.unionByName(overall)


def checkpoint_summary(posteriors: DataFrame, p: Params) -> DataFrame:
    """Total and per-row log-likelihood, spread over trajectories, parameter count and BIC."""
    per = posteriors.groupBy(*KEYS).agg(F.sum("ll").alias("ll"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("per_row", F.col("ll") / F.col("n"))
    tot = per.agg(F.sum("ll").alias("loglik"), F.sum("n").alias("n_rows"))
    q = exact_quantiles(per, [], "per_row", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    k = p.count()
    return one_row(tot, q).select(
        "loglik", "n_rows", (F.col("loglik") / F.col("n_rows")).alias("loglik_per_row"), "p05", "p50", "p95",
        F.lit(k).alias("n_params"), (F.lit(float(k)) * F.log("n_rows") - 2 * F.col("loglik")).alias("bic"),
    )


# occupancy and entropy --------------------------------------------------------------

def marginals(gamma: Column, S: int, A: int) -> tuple[Column, Column]:
    """Style and action marginals of a joint array."""
    add = lambda cols: sum(cols[1:], cols[0])
    style = F.array(*[add([gamma[s * A + a] for a in range(A)]) for s in range(S)])
    action = F.array(*[add([gamma[s * A + a] for s in range(S)]) for a in range(A)])
    return style, action


def mean_belief(posteriors: DataFrame, K: int) -> Column:
    return F.array(*[F.avg(F.col("gamma")[z]) for z in range(K)])


def entropy(prob: Column) -> Column:
    """Shannon entropy in nats; zero cells add nothing."""
    return -F.aggregate(prob, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x * F.log(x)).otherwise(0.0))


def occupancy(posteriors: DataFrame, S: int, A: int) -> DataFrame:
    """Mean occupancy, its maximum and the effective number of states, per level."""
    mean = posteriors.agg(mean_belief(posteriors, S * A).alias("joint"))
    style, action = marginals(F.col("joint"), S, A)
    rows = mean.select(F.explode(F.array(
        F.struct(F.lit("joint").alias("level"), F.col("joint").alias("p")),
        F.struct(F.lit("style").alias("level"), style.alias("p")),
        F.struct(F.lit("action").alias("level"), action.alias("p")),
    )).alias("r")).select("r.level", normalised(F.col("r.p")).alias("p"))
    return rows.select("level", "p", F.array_max("p").alias("max_occupancy"), F.exp(entropy(F.col("p"))).alias("k_eff"))


def row_entropies(posteriors: DataFrame, S: int, A: int) -> DataFrame:
    """Entropy of joint, style and action per window, divided by its maximum."""
    g = F.transform("gamma", lambda x: x / F.greatest(total(F.col("gamma")), F.lit(1e-15)))
    base = posteriors.select(*KEYS, "t", g.alias("_g"))
    style, action = marginals(F.col("_g"), S, A)
    return base.select(
        *KEYS, "t", (entropy(F.col("_g")) / math.log(max(S * A, 2))).alias("h_joint"),
        (entropy(style) / math.log(max(S, 2))).alias("h_style"), (entropy(action) / math.log(max(A, 2))).alias("h_action"),
    )


def trajectory_entropy(rows: DataFrame) -> DataFrame:
    """Median entropies per trajectory."""
    levels = ["h_joint", "h_style", "h_action"]
    long = rows.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("h")) for c in levels])).alias("r"))
    med = exact_quantiles(long.select(*KEYS, "r.level", "r.h"), [*KEYS, "level"], "h", {"median": 0.5})
    return med


def entropy_summary(medians: DataFrame) -> DataFrame:
    q = exact_quantiles(medians, ["level"], "median", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.join(medians.groupBy("level").agg(F.count("median").alias("n_traj")), "level")


# semantics ----------------------------------------------------------------------------

def weighted_moments(rows: DataFrame, features: list[str], K: int, weights: str = "gamma", renormalise: bool = True) -> DataFrame:
    """Per (z, feature): summed weight, weighted sum and sum of squares over finite rows, and total mass.

    Every task adds up its own batches; only K x F partial sums are shuffled.
    """
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    Fn = len(features)

    def part(it):
        acc = np.zeros((4, K, Fn))
        for pdf in it:
            if not len(pdf):
                continue
            g = np.stack(pdf["g"].to_list()).astype(float)
            if renormalise:
                g = g / np.maximum(g.sum(axis=1, keepdims=True), 1e-15)
            v = np.stack(pdf["x"].to_list()).astype(float)
            m = np.isfinite(v)
            v0 = np.where(m, v, 0.0)
            acc[0] += g.T @ m
            acc[1] += g.T @ v0
            acc[2] += g.T @ (v0 * v0)
            acc[3] += g.sum(axis=0)[:, None]
        zi, fi = np.meshgrid(np.arange(K, dtype="int32"), np.arange(Fn, dtype="int32"), indexing="ij")
        yield pd.DataFrame({"z": zi.ravel(), "f": fi.ravel(), "w": acc[0].ravel(), "wx": acc[1].ravel(),
                            "wx2": acc[2].ravel(), "mass": acc[3].ravel()})

    sums = rows.select(F.col(weights).alias("g"), x.alias("x")).mapInPandas(
        part, "z int, f int, w double, wx double, wx2 double, mass double"
    ).groupBy("z", "f").agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wx2", "mass")])
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1)
    return sums.withColumn("feature", name).drop("f")


def moments_to_stats(sums: DataFrame, denominator: str = "w", floor: float = 0.0) -> DataFrame:
    """Mean and std; ``w`` divides by finite mass, ``mass`` by all mass."""
    d = F.when(F.col(denominator) > floor, F.col(denominator))
    mean = F.col("wx") / d
    return sums.select("z", "feature", "mass", mean.alias("mean"), F.sqrt(F.greatest(F.col("wx2") / d - mean * mean, F.lit(0.0))).alias("std"))


def joint_semantics(posteriors_obs: DataFrame, features: list[str], K: int) -> DataFrame:
    return moments_to_stats(weighted_moments(posteriors_obs, features, K))


def marginal_semantics(posteriors_obs: DataFrame, features: list[str], S: int, A: int) -> DataFrame:
    """Per style and per action, divided by total mass including rows without a value."""
    style, action = marginals(F.col("gamma"), S, A)
    rows = posteriors_obs.withColumn("_sa", F.concat(style, action))
    sums = weighted_moments(rows, features, S + A, "_sa", renormalise=False)
    stats = moments_to_stats(sums, "mass", 1e-12)
    level = F.when(F.col("z") < S, "style").otherwise("action")
    return stats.select(level.alias("level"), F.when(F.col("z") < S, F.col("z")).otherwise(F.col("z") - S).alias("state"),
                        "feature", "mass", "mean", "std")


def semantics_report(stats: DataFrame, features: list[str], by: list[str], low: float = 0.01) -> DataFrame:
    """Wide table per state: mass, mass fraction, mean and std of every feature; thin cells flagged."""
    aggs = []
    for f in features:
        hit = F.col("feature") == f
        aggs += [F.max(F.when(hit, F.col("mean"))).alias(f"{f}_mean"), F.max(F.when(hit, F.col("std"))).alias(f"{f}_std")]
    wide = stats.groupBy(*by).agg(F.max("mass").alias("mass"), *aggs)
    tot = F.sum("mass").over(Window.partitionBy(F.lit(0)))  # one row per state
    wide = wide.withColumn("mass_frac", F.when(tot > 0, F.col("mass") / tot).otherwise(0.0))
    return wide.withColumn("low_mass", F.col("mass_frac") < low)


def style_consistency(stats: DataFrame, A: int, mode: str = "zscore") -> DataFrame:
    """Per action, RMSE over features between the two styles; std-scaled in ``zscore`` mode."""
    if mode not in ("raw", "zscore"):
        raise ValueError(f"unknown mode {mode!r}")
    masses = stats.groupBy("z").agg(F.max("mass").alias("_m"))
    frac = masses.select("z", (F.col("_m") / F.sum("_m").over(Window.partitionBy(F.lit(0)))).alias("frac"))  # one row per state
    s = stats.join(frac, "z").where(F.col("frac") > 0)
    scale = s.groupBy("feature").agg(
        F.greatest(F.sum(F.col("frac") * F.coalesce("std", F.lit(0.0))) / F.greatest(F.sum("frac"), F.lit(1e-6)), F.lit(1e-6)).alias("scale")
    )
    a = (F.col("z") % A).cast("int")
    side = lambda k: F.max(F.when(F.floor(F.col("z") / A) == k, F.col("mean")))
    pairs = stats.groupBy(a.alias("a"), "feature").agg(side(0).alias("m0"), side(1).alias("m1")).join(scale, "feature")
    div = F.col("scale") if mode == "zscore" else F.lit(1.0)
    dist = (F.col("m0") - F.col("m1")) / div
    return pairs.groupBy("a").agg(F.sqrt(F.avg(dist * dist)).alias("rmse"))


# prediction -----------------------------------------------------------------------------

def maneuver_group(z: Column, A: int, legacy: bool = False) -> Column:
    out = None
    for (s, a), g in (LEGACY_MANEUVER_GROUPS if legacy else MANEUVER_GROUPS).items():
        if a >= A:
            continue  # cannot be reached with A actions
        out = F.when(z == s * A + a, g) if out is None else out.when(z == s * A + a, g)
    return out


def predictions(filtered_labels: DataFrame, p: Params, H: int = 10, warmup: int = 5, legacy: bool = False,
                longest: int | None = None) -> DataFrame:
    """One-step predictions with truth, horizon hit and steps to the hit.

    Input: ``post`` and truth ``z`` per window. A prediction is made after
    ``warmup`` updates and only where all H later windows exist.
    """
    A = p.A
    ahead = in_segments(
        filtered_labels.select(*KEYS, "t", "post", "z"),
        lambda w: [{"_ahead": F.collect_list("z").over(w.rowsBetween(1, H))}], after=H, longest=longest,
    ).where((F.col("t") >= warmup - 1) & (F.size("_ahead") == H))
    pred = argmax(step_columns(belief_prob(F.col("post")), p.kernel("clamp")))
    df = ahead.withColumn("pred", pred).withColumn("truth", F.element_at("_ahead", 1))
    g = maneuver_group(F.col("pred"), A, legacy)
    hit = lambda z: (z == F.col("pred")) | F.coalesce(maneuver_group(z, A, legacy) == g, F.lit(False))
    steps = F.array_min(F.filter(F.transform("_ahead", lambda z, i: F.when(hit(z), i + 1)), lambda i: i.isNotNull()))
    return df.select(*KEYS, "t", "pred", "truth", steps.alias("tte_steps")).withColumn("hit", F.col("tte_steps").isNotNull())


def scored(pred: DataFrame) -> DataFrame:
    """Predictions with a known truth."""
    return pred.where(F.col("truth") >= 0)


def exact_accuracy(pred: DataFrame) -> DataFrame:
    return scored(pred).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"))


def confusion(pred: DataFrame, K: int) -> DataFrame:
    """All K x K cells, zero-filled."""
    n = scored(pred).groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("_n"))
    spark = pred.sparkSession
    states = spark.range(K * K).select((F.col("id") / K).cast("int").alias("truth"), (F.col("id") % K).cast("int").alias("pred"))
    return states.join(n, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("_n", F.lit(0)).alias("n"))


def precision_recall_f1(cm: DataFrame) -> DataFrame:
    """Per class, macro and micro scores; classes without rows count as zero."""
    zero = F.lit(0).cast("bigint")
    n = F.col("n")
    both = F.array(
        F.struct(F.col("truth").alias("z"), n.alias("actual"), zero.alias("predicted"),
                 F.when(F.col("truth") == F.col("pred"), n).otherwise(zero).alias("tp")),
        F.struct(F.col("pred").alias("z"), zero.alias("actual"), n.alias("predicted"), zero.alias("tp")),
    )
    c = cm.select(F.explode(both).alias("r")).groupBy("r.z").agg(
        *[F.sum(f"r.{k}").alias(k) for k in ("actual", "predicted", "tp")])
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = lambda p, r: safe(2 * p * r, p + r)
    c = c.withColumns({"precision": safe(F.col("tp"), F.col("predicted")), "recall": safe(F.col("tp"), F.col("actual"))})
    c = c.withColumn("f1", f1(F.col("precision"), F.col("recall")))

    def line(name: Column, p: Column, r: Column, f: Column) -> Column:
        return F.struct(name.alias("average"), p.alias("precision"), r.alias("recall"), f.alias("f1"))

    # one row per class, so the list is as long as the number of states
    one = c.agg(
        F.collect_list(line(F.concat(F.lit("class_"), F.col("z").cast("string")), F.col("precision"), F.col("recall"), F.col("f1"))).alias("per"),
        line(F.lit("macro"), F.avg("precision"), F.avg("recall"), F.avg("f1")).alias("macro"),
        safe(F.sum("tp"), F.sum("predicted")).alias("_p"), safe(F.sum("tp"), F.sum("actual")).alias("_r"),
    )
    micro = line(F.lit("micro"), F.col("_p"), F.col("_r"), f1(F.col("_p"), F.col("_r")))
    return one.select(F.explode(F.concat("per", F.array("macro"), F.array(micro))).alias("o")).select("o.*")


def hit_rate(pred: DataFrame) -> DataFrame:
    return scored(pred).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def time_to_event(pred: DataFrame, stride: int, fps: float = FPS) -> DataFrame:
    """Seconds to the first match over hits; a handful of distinct steps, so ``percentile`` is bounded."""
    tte = F.col("tte_steps") * F.lit(stride / fps)
    df = scored(pred).withColumn("tte", tte)
    q = F.percentile("tte", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(
        F.count(F.lit(1)).alias("num_total"), F.count("tte").alias("num_hits"), F.avg("tte").alias("mean_tte_sec"), q.alias("_q")
    ).select("num_total", "num_hits", "mean_tte_sec", F.col("_q")[0].alias("p25_tte_sec"),
             F.col("_q")[1].alias("median_tte_sec"), F.col("_q")[2].alias("p75_tte_sec"))


def cumulative_hits(pred: DataFrame, H: int, stride: int, fps: float = FPS) -> DataFrame:
    """Hits per horizon step, cumulative hit rate by time, and totals."""
    one = scored(pred).agg(
        F.count(F.lit(1)).alias("num_total"), F.array(*[F.count_if(F.col("tte_steps") == h) for h in range(1, H + 1)]).alias("_n")
    )
    # H cells of one row: the running sum is a slice of the array
    out = one.select("num_total", "_n", F.posexplode("_n").alias("_i", "hits"))
    cum = F.aggregate(F.slice("_n", 1, F.col("_i") + 1), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    step = (F.col("_i") + 1).alias("step")
    return out.select(step, ((F.col("_i") + 1) * F.lit(stride / fps)).alias("seconds"), "hits", cum.alias("cumulative_hits"),
                      F.try_divide(cum, F.col("num_total")).alias("cumulative_rate"), "num_total")


# explanation ------------------------------------------------------------------------------

def explain(filtered_logb: DataFrame, p: Params) -> DataFrame:
    """Prior, emission, posterior and forecast of every window, their best states and the shift."""
    df = filtered_logb.select(
        *[c for c in filtered_logb.columns if c not in ("prior", "post", "logb")],
        belief_prob(F.col("prior")).alias("prior"), belief_prob(F.col("logb")).alias("emission"),
        belief_prob(F.col("post")).alias("posterior"),
    )
    df = df.withColumn("forecast", step_columns(F.col("posterior"), p.kernel("clamp")))
    tv = 0.5 * F.aggregate(F.zip_with("prior", "posterior", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x)
    df = df.withColumns({f"{c}_z": argmax(F.col(c)) for c in ("prior", "emission", "posterior", "forecast")})
    return df.withColumns({"tv": tv, "map_changed": F.col("prior_z") != F.col("posterior_z")})


def explanation_record(explained: DataFrame, names: list[str], k: int = 3) -> DataFrame:
    """``explain`` with the ``k`` most likely states of each distribution by name and probability."""
    table = F.array(*[F.lit(n) for n in names])
    cols = {}
    for c in ("prior", "emission", "posterior", "forecast"):
        top = top_k(F.col(c), k)
        cols[f"{c}_names"] = F.transform(top, lambda w: F.element_at(table, w["z"] + 1))
        cols[f"{c}_probs"] = F.transform(top, lambda w: w["prob"])
    return explained.withColumns(cols)


def state_mass(posteriors: DataFrame, S: int, A: int) -> DataFrame:
    """Responsibility mass per joint state, style and action with its share."""
    sums = posteriors.agg(*[F.sum(F.col("gamma")[z]).alias(f"g{z}") for z in range(S * A)])
    joint = F.array(*[F.col(f"g{z}") for z in range(S * A)])
    style, action = marginals(joint, S, A)
    parts = [("joint", joint), ("style", style), ("action", action)]
    levels = F.array(*[F.struct(F.lit(n).alias("level"), arr.alias("m"), total(arr).alias("n")) for n, arr in parts])
    rows = sums.select(F.explode(levels).alias("r")).select("r.level", "r.n", F.posexplode("r.m").alias("state", "mass"))
    return rows.select("level", "state", "mass", (F.col("mass") / F.col("n")).alias("frac"))


def group_contributions(rows: DataFrame, p: Params, groups: dict[str, list[str]]) -> DataFrame:
    """Long (keys, t, z, feature_group, score) for rows with ``z`` and a feature array ``x``."""
    schema = ", ".join(f"{k} bigint" for k in KEYS) + ", t bigint, z int, feature_group string, score double"

    def score(it):
        for pdf in it:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_list()).astype(float)
            parts = group_scores(p, groups, x, pdf["z"].to_numpy())
            base = pdf[[*KEYS, "t", "z"]]
            yield pd.concat([base.assign(feature_group=g, score=v) for g, v in parts.items()], ignore_index=True)

    return rows.select(*KEYS, "t", "z", "x").mapInPandas(score, schema)
