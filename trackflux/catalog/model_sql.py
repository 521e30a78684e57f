"""SQL for the latent-state model: emissions and recursions as recursive CTEs."""

from __future__ import annotations

import math

import numpy as np

from ..latent.emission import safe_var
from ..latent.params import Params, patterned
from ..latent.starts import FLAG_EDGE, STEPS, VAR_ADD
from ..plans.model import MODEL_STRIDE, MODEL_W
from ..schema import CONTINUOUS_FEATURES, EPS, WINDOW_FEATURES
from . import sql as S
from .reports import _gated

P = patterned()
KT = "recording_id, vehicle_id, t"
LOG_2PI = math.log(2 * math.pi)


def lit(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


def vec(a) -> str:
    return "[" + ", ".join(lit(v) for v in a) + "]"


def mat(m) -> str:
    return "[" + ", ".join(vec(r) for r in m) + "]"


def _sc(f: str) -> str:
    cond = f"FILTER (WHERE {f} IS NOT NULL{_gated(f)})"
    return (f"coalesce(avg({f}) {cond}, 0) AS m_{f}, "
            f"CASE WHEN stddev_pop({f}) {cond} >= 1e-6 THEN stddev_pop({f}) {cond} ELSE 1 END AS d_{f}")


OBS = S.windows(None, MODEL_W, MODEL_STRIDE) + f""",
sc AS (SELECT {", ".join(_sc(f) for f in CONTINUOUS_FEATURES)} FROM windows),
obs AS MATERIALIZED (SELECT recording_id, vehicle_id, window_idx AS t, start_frame, meta_class, {", ".join(WINDOW_FEATURES)},
  {", ".join(f"({f} - m_{f}) / d_{f} AS s_{f}" for f in CONTINUOUS_FEATURES)} FROM windows, sc)"""


def split_obs(which: str | None, split: str, eps: str = "") -> str:
    """Like OBS for one split (None: all windows), scaled by class with what the training windows give."""
    return S.windows(None, MODEL_W, MODEL_STRIDE) + f""",{split},
tr AS (SELECT w.* FROM windows w JOIN split s USING (recording_id, vehicle_id) WHERE s.split = 'train'),
sc AS (SELECT meta_class AS mc, {", ".join(_sc(f) for f in CONTINUOUS_FEATURES)} FROM tr GROUP BY meta_class),
obs AS MATERIALIZED (SELECT w.recording_id, w.vehicle_id, window_idx AS t, start_frame, meta_class, {", ".join(WINDOW_FEATURES)},
  {", ".join(f"({f} - m_{f}) / (d_{f}{eps}) AS s_{f}" for f in CONTINUOUS_FEATURES)}
  FROM windows w JOIN sc ON mc = meta_class JOIN split s ON s.vehicle_id = w.vehicle_id{f" WHERE s.split = '{which}'" if which else ""})"""


def _names(cols) -> str:
    return "[" + ", ".join(f"'{c}'" for c in cols) + "]"


LONG = f""",
xlong AS (SELECT {KT}, unnest({_names(P.continuous)}) AS f, unnest([{", ".join(f"s_{c}" for c in P.continuous)}]) AS x FROM obs),
blong AS (SELECT {KT}, unnest({_names(P.binary)}) AS f, unnest([{", ".join(P.binary)}]) AS x FROM obs)"""


def emission(p: Params = P, obs: str = OBS) -> str:
    """CTE ``lb``: per window the list ``b`` of log-likelihoods and its maximum ``mb``."""
    var = safe_var(p.var)
    gp = ", ".join(f"({z}, '{f}', {lit(p.mean[z, d])}, {lit(var[z, d])})" for z in range(p.K) for d, f in enumerate(p.continuous))
    bp = ", ".join(
        f"({z}, '{f}', {lit(np.clip(p.bern[z, b], EPS, 1 - EPS))})" for z in range(p.K) for b, f in enumerate(p.binary))
    return obs + LONG + f""",
gp(z, f, mu, va) AS (VALUES {gp}),
bp(z, f, q) AS (VALUES {bp}),
terms AS (
  SELECT {KT}, z, -0.5 * ({lit(LOG_2PI)} + ln(va) + (x - mu) * (x - mu) / va) AS v FROM xlong JOIN gp USING (f) WHERE x IS NOT NULL
  UNION ALL
  SELECT {KT}, z, CASE WHEN x > 0.5 THEN ln(q) ELSE ln(1 - q) END FROM blong JOIN bp USING (f) WHERE x IS NOT NULL),
lz AS (SELECT {KT}, z, sum(v) AS l FROM terms GROUP BY ALL),
lb AS MATERIALIZED (SELECT {KT}, list(l ORDER BY z) AS b, max(l) AS mb FROM lz GROUP BY ALL)"""


def forward(p: Params = P, smoothing: str = "clamp", norm: bool = True, weight: str = "") -> str:
    """CTE ``fwd``: prior ``pr``, posterior ``po`` and increment ``ll`` per window."""
    cols = p.kernel(smoothing).T
    prior = f"list_transform({mat(cols)}, lambda c: list_dot_product(c, f.po))"
    if norm:
        prior = f"list_transform({prior}, lambda x: x / list_dot_product({vec(p.kernel(smoothing).sum(axis=1))}, f.po))"
    src = "lb"
    pre = ""
    if weight:
        src = "lbw"
        pre = f""",
lbw AS MATERIALIZED (SELECT {KT}, list_transform(b, lambda x: x * w) AS b, mb * w AS mb FROM lb JOIN ({weight}) USING ({KT}))"""
    step = lambda inner: f"""
  SELECT recording_id, vehicle_id, t, pr, list_transform(w, lambda x: x / list_sum(w)) AS po, ln(list_sum(w)) + mb AS ll FROM (
    SELECT recording_id, vehicle_id, t, pr, mb, list_transform(list_zip(pr, b), lambda u: u[1] * exp(u[2] - mb)) AS w FROM ({inner}))"""  # noqa: E731
    return pre + f""",
fwd AS (
  {step(f"SELECT {KT}, {vec(p.start(smoothing))} AS pr, b, mb FROM {src} WHERE t = 0")}
  UNION ALL
  {step(f"SELECT l.recording_id, l.vehicle_id, l.t, {prior} AS pr, l.b, l.mb FROM fwd f JOIN {src} l ON l.vehicle_id = f.vehicle_id AND l.t = f.t + 1")})"""


def backward(p: Params = P, smoothing: str = "add", src: str = "lb") -> str:
    """CTEs ``bwd`` (scaled beta) and ``gam`` (posterior per window)."""
    rows = p.kernel(smoothing)
    nb = "list_transform(list_zip(l.b, g.be), lambda u: exp(u[1] - l.mb) * u[2])"
    raw = f"list_transform({mat(rows)}, lambda r: list_dot_product(r, {nb}))"
    return f""",
ends AS (SELECT vehicle_id, max(t) AS tl FROM {src} GROUP BY 1),
bwd AS (
  SELECT x.vehicle_id, tl AS t, {vec(np.ones(p.K))} AS be FROM ends x
  UNION ALL
  SELECT vehicle_id, t, list_transform(w, lambda v: v / list_sum(w)) AS be FROM (
    SELECT g.vehicle_id, g.t - 1 AS t, {raw} AS w FROM bwd g JOIN {src} l ON l.vehicle_id = g.vehicle_id AND l.t = g.t WHERE g.t > 0)),
gam AS MATERIALIZED (
  SELECT recording_id, vehicle_id, t, ll, po, be, list_transform(w, lambda x: x / list_sum(w)) AS g FROM (
    SELECT f.recording_id, f.vehicle_id, f.t, f.ll, f.po, b.be, list_transform(list_zip(f.po, b.be), lambda u: u[1] * u[2]) AS w
    FROM fwd f JOIN bwd b ON b.vehicle_id = f.vehicle_id AND b.t = f.t))"""


def pairs(p: Params = P, smoothing: str = "add", src: str = "lb") -> str:
    """CTE ``xi``: (vehicle, t, i, j, x) transition posteriors into row t."""
    cells = f"[{', '.join(f'[{i}, {j}]' for i in range(p.K) for j in range(p.K))}]"
    M = vec(p.kernel(smoothing).reshape(-1))
    K = p.K
    return f""",
xi0 AS (
  SELECT n.vehicle_id, n.t, list_transform(range({K * K}), lambda c:
      prev.po[c // {K} + 1] * ({M})[c + 1] * exp(l.b[c % {K} + 1] - l.mb) * n.be[c % {K} + 1]) AS w
  FROM gam n JOIN gam prev ON prev.vehicle_id = n.vehicle_id AND prev.t = n.t - 1
  JOIN {src} l ON l.vehicle_id = n.vehicle_id AND l.t = n.t),
xi AS MATERIALIZED (
  SELECT vehicle_id, t, unnest(range({K * K})) // {K} AS i, unnest(range({K * K})) % {K} AS j, unnest(w) / list_sum(w) AS x FROM xi0)"""


def smoothing_ctes(p: Params = P, weight: str = "") -> str:
    return emission(p) + forward(p, "add", norm=False, weight=weight) + backward(p, "add", "lbw" if weight else "lb")


def explode(lst: str, name: str = "p", K: int = P.K, d: int = 6) -> str:
    return ", ".join(f"{S.r(f'{lst}[{z + 1}]', d)} AS {name}{z}" for z in range(K))


#: Complete rows as lists, and number by number.
COMPLETE = f""",
krows AS MATERIALIZED (
  SELECT {KT}, row_number() OVER (ORDER BY recording_id, vehicle_id, t) AS rid, [{", ".join(f"s_{c}" for c in P.continuous)}] AS x, [{", ".join(P.binary)}] AS flags
  FROM obs WHERE {" AND ".join(f"s_{c} IS NOT NULL" for c in P.continuous)}),
kx AS MATERIALIZED (SELECT rid, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM krows),
kb AS MATERIALIZED (SELECT rid, unnest(flags) AS v, generate_subscripts(flags, 1) - 1 AS j FROM krows),
kall AS MATERIALIZED (SELECT j, count(*) AS n, avg(v) AS m, greatest(var_pop(v) + {VAR_ADD}::DOUBLE, {VAR_ADD}::DOUBLE) AS s FROM kx GROUP BY j)"""


def lloyd(tag: str, K: int, seed: int, widest: int) -> str:
    """CTE ``<tag>`` (param, i, j, value): means, variances and flag rates of K clusters, by Lloyd steps one after another."""
    near = lambda i: f"SELECT rid, first(k ORDER BY d, k) AS k FROM (SELECT rid, k, list_distance(x, c) AS d FROM krows, {tag}c{i}) GROUP BY rid"
    out = f""",
{tag}c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, recording_id, vehicle_id, t) - 1 AS INTEGER) AS k, x AS c
  FROM (SELECT *, md5('{seed}|:' || recording_id || ':' || vehicle_id || ':' || t) AS h FROM krows) ORDER BY k LIMIT {K})"""
    for i in range(STEPS):
        out += f""",
{tag}m{i} AS (SELECT k, j, avg(v) AS v FROM ({near(i)}) JOIN kx USING (rid) GROUP BY k, j),
{tag}c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM {tag}c{i} o LEFT JOIN (SELECT k, list(v ORDER BY j) AS c FROM {tag}m{i} GROUP BY k) m ON m.k = o.k)"""
    D, B = len(P.continuous), len(P.binary)
    few = f"(SELECT count(*) FROM krows) < {max(10 * widest, D + 1)}"
    return out + f""",
{tag}a AS MATERIALIZED ({near(STEPS)}),
{tag}s AS (SELECT k, j, count(*) AS n, avg(v) AS m, greatest(var_pop(v) + {VAR_ADD}::DOUBLE, {VAR_ADD}::DOUBLE) AS s FROM {tag}a JOIN kx USING (rid) GROUP BY k, j),
{tag}f AS (SELECT k, j, coalesce(avg(CASE WHEN v > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE v IS NOT NULL), 0) AS r FROM {tag}a JOIN kb USING (rid) GROUP BY k, j),
{tag} AS (
  SELECT 'mean' AS param, q.k AS i, q.j, CASE WHEN {few} THEN g.m WHEN s.n >= {D + 1} THEN s.m ELSE c[q.j + 1] END AS value
  FROM (SELECT unnest(range({K})) AS k, d.j FROM range({D}) d(j)) q JOIN kall g ON g.j = q.j JOIN {tag}c{STEPS} o ON o.k = q.k LEFT JOIN {tag}s s ON s.k = q.k AND s.j = q.j
  UNION ALL SELECT 'var', q.k, q.j, CASE WHEN NOT {few} AND s.n >= {D + 1} THEN s.s ELSE g.s END
  FROM (SELECT unnest(range({K})) AS k, d.j FROM range({D}) d(j)) q JOIN kall g ON g.j = q.j LEFT JOIN {tag}s s ON s.k = q.k AND s.j = q.j
  UNION ALL SELECT 'bern', q.k, q.j, least(greatest(CASE WHEN {few} THEN 0.5 ELSE coalesce(f.r, 0.5) END, {FLAG_EDGE}::DOUBLE), 1 - {FLAG_EDGE}::DOUBLE)
  FROM (SELECT unnest(range({K})) AS k, d.j FROM range({B}) d(j)) q LEFT JOIN {tag}f f ON f.k = q.k AND f.j = q.j)"""
