"""Emission log-likelihoods per window and state."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from ..schema import EPS, MIN_VAR, VAR_JITTER
from .params import Params

LOG_2PI = math.log(2.0 * math.pi)


def safe_var(var: np.ndarray) -> np.ndarray:
    return np.maximum(var, MIN_VAR) + VAR_JITTER


def _num(v: float) -> str:
    return f"({float(v)!r}D)"


def _gauss(x: str, mu: float, var: float) -> str:
    """log N(x; mu, var) as SQL text; a missing value adds nothing.

    Text, because hundreds of terms are parsed in one go instead of being built
    call by call. The polynomial works on values that are never NULL, so the
    generated code has no null branches and shares them between states.
    """
    c0 = -0.5 * (LOG_2PI + math.log(var) + mu * mu / var)
    x0 = f"coalesce({x}, 0D)"
    return f"{_num(c0)} * cast({x} is not null as double) + {x0} * ({_num(mu / var)} - {_num(0.5 / var)} * {x0})"


def _bern(x: str, p: float, weight: float, missing_is_zero: bool = False) -> str:
    p = min(max(float(p), EPS), 1 - EPS)
    on, off = weight * math.log(p), weight * math.log(1 - p)
    return (f"CASE WHEN {x} > 0.5D THEN {_num(on)} WHEN {x} IS NOT NULL THEN {_num(off)} "
            f"ELSE {_num(off if missing_is_zero else 0.0)} END")


def _array(states: list[list[str]]) -> Column:
    return F.expr("array(" + ", ".join(" + ".join(terms) for terms in states) + ")")


def scaled(name: str) -> str:
    return f"s_{name}"


def log_emission(p: Params) -> Column:
    """Array of K log-likelihoods as one generated expression, parameters as literals."""
    var = safe_var(p.var)
    return _array([
        [_gauss(scaled(f), p.mean[z, d], var[z, d]) for d, f in enumerate(p.continuous)]
        + [_bern(f, p.bern[z, b], p.bern_weight) for b, f in enumerate(p.binary)]
        for z in range(p.K)
    ])


def log_emission_matrix(p: Params, x: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The same for a block of rows (n, D) and (n, B), NaN as missing."""
    var = safe_var(p.var)
    m = np.isfinite(x)
    x0 = np.where(m, x, 0.0)
    mf = m.astype(float)
    iv = 1.0 / var
    out = -0.5 * (
        mf @ (LOG_2PI + np.log(var) + p.mean**2 * iv).T + (x0 * x0) @ iv.T - 2.0 * x0 @ (p.mean * iv).T
    )
    fb = np.isfinite(flags)
    on = (np.where(fb, flags, 0.0) > 0.5).astype(float)
    q = np.clip(p.bern, EPS, 1 - EPS)
    out += p.bern_weight * (on @ np.log(q).T + (fb.astype(float) - on) @ np.log(1 - q).T)
    return out


def feature_array(continuous: list[str], binary: list[str], *more: Column) -> Column:
    """One array per row: scaled features, flags and any further numbers; NaN as missing."""
    nan = F.lit(float("nan"))
    cols = [F.col(scaled(c)) for c in continuous] + [F.col(c).cast("double") for c in binary] + list(more)
    return F.array(*[F.coalesce(c, nan) for c in cols])


def emitter(p: Params):
    """``log_emission_matrix`` over rows made by ``feature_array``."""
    D, B = len(p.continuous), len(p.binary)
    return lambda x: log_emission_matrix(p, x[:, :D], x[:, D : D + B])


def product_emitter(style: dict, action: dict, bern_weight: float = 1.0):
    """Product-of-experts log-likelihoods over rows made by ``feature_array``."""
    vs, va = safe_var(style["var"]), safe_var(action["var"])
    D, B = style["mean"].shape[1], style["bern"].shape[1]
    v = vs[:, None, :] + va[None, :, :]
    dm = style["mean"][:, None, :] - action["mean"][None, :, :]
    log_zc = -0.5 * (LOG_2PI + np.log(v) + dm * dm / v)
    ps, pa = (np.clip(e["bern"], EPS, 1 - EPS) for e in (style, action))
    log_zb = np.log(np.clip(ps[:, None] * pa[None] + (1 - ps[:, None]) * (1 - pa[None]), EPS, 1.0))

    def expert(x0, m, on, e, var):
        iv = 1.0 / var
        g = -0.5 * (m @ (LOG_2PI + np.log(var) + e["mean"] ** 2 * iv).T + (x0 * x0) @ iv.T - 2.0 * x0 @ (e["mean"] * iv).T)
        q = np.clip(e["bern"], EPS, 1 - EPS)
        return g + bern_weight * (on @ np.log(q).T + (1 - on) @ np.log(1 - q).T)

    def emit(x):
        c, f = x[:, :D], x[:, D : D + B]
        m = np.isfinite(c).astype(float)
        x0 = np.where(m > 0, c, 0.0)
        fb = np.isfinite(f).astype(float)
        on = (np.where(fb > 0, f, 0.0) > 0.5).astype(float)
        ls, la = expert(x0, m, on, style, vs), expert(x0, m, on, action, va)
        norm = (m @ log_zc.reshape(-1, D).T + fb @ log_zb.reshape(-1, B).T).reshape(-1, *log_zc.shape[:2])
        return (ls[:, :, None] + la[:, None, :] - norm).reshape(len(x), -1)

    return emit


def log_emission_product(style: dict, action: dict, continuous: list[str], binary: list[str],
                         bern_weight: float = 1.0) -> Column:
    """Normalised product of a style expert and an action expert.

    Each expert is a dict of ``mean``, ``var``, ``bern``. A missing flag counts
    as zero in the experts but is left out of the normaliser.
    """
    vs, va = safe_var(style["var"]), safe_var(action["var"])
    S, A = len(vs), len(va)

    def expert(e: dict, var: np.ndarray, k: int) -> list[str]:
        g = [_gauss(scaled(f), e["mean"][k, d], var[k, d]) for d, f in enumerate(continuous)]
        return g + [_bern(f, e["bern"][k, j], bern_weight, True) for j, f in enumerate(binary)]

    def log_norm(s: int, a: int) -> list[str]:
        terms = []
        for d, f in enumerate(continuous):
            v = vs[s, d] + va[a, d]
            dm = style["mean"][s, d] - action["mean"][a, d]
            c = -0.5 * (LOG_2PI + math.log(v) + dm * dm / v)
            terms.append(f"{_num(-c)} * cast({scaled(f)} is not null as double)")
        for j, f in enumerate(binary):
            ps, pa = (min(max(float(e["bern"][k, j]), EPS), 1 - EPS) for e, k in ((style, s), (action, a)))
            zj = min(max(ps * pa + (1 - ps) * (1 - pa), EPS), 1.0)
            terms.append(f"{_num(-math.log(zj))} * cast({f} is not null as double)")
        return terms

    return _array([expert(style, vs, s) + expert(action, va, a) + log_norm(s, a) for s in range(S) for a in range(A)])


def group_scores(p: Params, groups: dict[str, list[str]], x: np.ndarray, z: np.ndarray) -> dict[str, np.ndarray]:
    """Log-likelihood of each row's state ``z`` summed per feature group, over ``feature_array`` rows.

    Here the variance is only floored at 1e-6.
    """
    D = len(p.continuous)
    var = np.maximum(p.var, EPS)[z]
    c, f = x[:, :D], x[:, D : D + len(p.binary)]
    g = -0.5 * (LOG_2PI + np.log(var) + (c - p.mean[z]) ** 2 / var)
    q = np.clip(p.bern, EPS, 1 - EPS)[z]
    b = p.bern_weight * np.where(f > 0.5, np.log(q), np.log(1 - q))
    terms = np.concatenate([np.where(np.isfinite(c), g, 0.0), np.where(np.isfinite(f), b, 0.0)], axis=1)
    at = {n: i for i, n in enumerate([*p.continuous, *p.binary])}
    return {name: terms[:, [at[n] for n in names if n in at]].sum(axis=1) for name, names in groups.items()}
