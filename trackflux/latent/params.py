"""Model parameters: a few hundred numbers, kept as arrays on the driver and
stored as a long table (param, i, j, k, value)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import BINARY_FEATURES, CONTINUOUS_FEATURES, EPS, N_ACTIONS, N_STYLES

LONG_SCHEMA = "param string, i int, j int, k int, value double"


@dataclass(frozen=True)
class Params:
    """Two chains: style ``s`` and action ``a`` given style; joint ``z = s * A + a``."""

    pi_s: np.ndarray  # (S,)
    pi_a: np.ndarray  # (S, A)
    A_s: np.ndarray  # (S, S)
    A_a: np.ndarray  # (S, A, A), by the style moved to
    mean: np.ndarray  # (S * A, D)
    var: np.ndarray  # (S * A, D)
    bern: np.ndarray  # (S * A, B)
    continuous: list[str] = field(default_factory=lambda: list(CONTINUOUS_FEATURES))
    binary: list[str] = field(default_factory=lambda: list(BINARY_FEATURES))
    bern_weight: float = 1.0

    @property
    def S(self) -> int:
        return len(self.pi_s)

    @property
    def A(self) -> int:
        return self.pi_a.shape[1]

    @property
    def K(self) -> int:
        return self.S * self.A

    def start(self, smoothing: str = "add") -> np.ndarray:
        """Joint start weights (K,)."""
        e = EPS if smoothing == "add" else 0.0
        return ((self.pi_s + e)[:, None] * (self.pi_a + e)).reshape(-1)

    def kernel(self, smoothing: str = "add") -> np.ndarray:
        """Joint transition weights (K, K): style step times action step.

        ``add`` puts 1e-6 on every factor (batch likelihoods), ``clamp`` uses
        the plain probabilities (online filter).
        """
        e = EPS if smoothing == "add" else 0.0
        joint = (self.A_s + e)[:, None, :, None] * np.transpose(self.A_a + e, (1, 0, 2))[None, :, :, :]
        return joint.reshape(self.K, self.K)

    def count(self) -> int:
        """Free parameters: transition rows, means, variances, flags; start tables are fixed."""
        S, A = self.S, self.A
        chains = S * (S - 1) + S * A * (A - 1)
        return chains + self.mean.size + self.var.size + self.bern.size

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


_SHAPES = {"pi_s": 1, "pi_a": 2, "A_s": 2, "A_a": 3, "mean": 2, "var": 2, "bern": 2}


Scaler = dict[str, tuple[float, float]]
EXPERT_PARTS = ("mean", "var", "bern")


def to_long(spark: SparkSession, p: Params, scaler: Scaler | dict[str, Scaler] | None = None,
            experts: tuple[dict, dict] | None = None) -> DataFrame:
    """All numbers of a model as rows. ``scaler`` is global or by class; ``experts`` are those of the product model."""
    rows = []
    for name in _SHAPES:
        for idx, v in np.ndenumerate(getattr(p, name)):
            rows.append((name, *(list(idx) + [0] * (3 - len(idx))), float(v)))
    by_class = scaler and all(isinstance(v, dict) for v in scaler.values())
    for tag, one in ((f"/{c}", s) for c, s in scaler.items()) if by_class else (("", scaler or {}),):
        for f, (m, s) in one.items():
            i = p.continuous.index(f)
            rows += [(f"scaler_mean{tag}", i, 0, 0, float(m)), (f"scaler_std{tag}", i, 0, 0, float(s))]
    for name, expert in zip(("style", "action"), experts or ()):
        for part in EXPERT_PARTS:
            rows += [(f"{name}_{part}", i, j, 0, float(v)) for (i, j), v in np.ndenumerate(expert[part])]
    return spark.createDataFrame([(n, int(i), int(j), int(k), v) for n, i, j, k, v in rows], LONG_SCHEMA)


def save(spark: SparkSession, p: Params, path: str, scaler=None, experts=None) -> None:
    to_long(spark, p, scaler, experts).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Params, Scaler | dict[str, Scaler]]:
    return from_long(spark.read.parquet(path))


def load_experts(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """Style and action experts of a stored product model."""
    cells = {}
    for r in spark.read.parquet(path).where(F.col("param").rlike("^(style|action)_")).collect():
        cells.setdefault(r["param"], {})[(r["i"], r["j"])] = r["value"]
    out = []
    for name in ("style", "action"):
        expert = {}
        for part in EXPERT_PARTS:
            got = cells.get(f"{name}_{part}")
            if not got:
                raise ValueError(f"no {name} experts stored")
            arr = np.empty(tuple(1 + max(c[d] for c in got) for d in (0, 1)))
            for c, v in got.items():
                arr[c] = v
            expert[part] = arr
        out.append(expert)
    return out[0], out[1]


def from_long(df: DataFrame) -> tuple[Params, Scaler | dict[str, Scaler]]:
    """Rebuild arrays; incomplete or misshapen tables are an error."""
    rows = df.where(F.col("value").isNotNull()).collect()  # parameters only, bounded by the model size
    by: dict[str, dict] = {}
    for r in rows:
        by.setdefault(r["param"], {})[(r["i"], r["j"], r["k"])] = r["value"]
    arrays = {}
    for name, nd in _SHAPES.items():
        cells = by.get(name)
        if not cells:
            raise ValueError(f"parameter {name} missing")
        shape = tuple(1 + max(c[d] for c in cells) for d in range(nd))
        if len(cells) != int(np.prod(shape)):
            raise ValueError(f"parameter {name} has {len(cells)} values for shape {shape}")
        arr = np.empty(shape)
        for c, v in cells.items():
            arr[c[:nd]] = v
        arrays[name] = arr
    S, A = arrays["pi_a"].shape
    expected = {"pi_s": (S,), "A_s": (S, S), "A_a": (S, A, A)}
    for name, shape in expected.items():
        if arrays[name].shape != shape:
            raise ValueError(f"parameter {name} has shape {arrays[name].shape}, expected {shape}")
    for name in ("mean", "var", "bern"):
        if arrays[name].shape[0] != S * A:
            raise ValueError(f"parameter {name} has {arrays[name].shape[0]} states, expected {S * A}")
    p = Params(**arrays)
    def scaler_of(tag: str) -> Scaler:
        stds = by[f"scaler_std{tag}"]
        return {p.continuous[i]: (v, stds[(i, 0, 0)]) for (i, _, _), v in sorted(by.get(f"scaler_mean{tag}", {}).items())}

    classes = sorted(n.partition("/")[2] for n in by if n.startswith("scaler_mean/"))
    if classes:
        return p, {c: scaler_of(f"/{c}") for c in classes}
    return p, scaler_of("") if "scaler_mean" in by else {}


def sticky_start(S: int = N_STYLES, A: int = N_ACTIONS, stay: float = 0.8) -> dict[str, np.ndarray]:
    """Uniform start, sticky transitions."""
    def sticky(n: int) -> np.ndarray:
        return np.full((n, n), (1 - stay) / max(n - 1, 1)) + np.eye(n) * (stay - (1 - stay) / max(n - 1, 1))

    return {
        "pi_s": np.full(S, 1 / S), "pi_a": np.full((S, A), 1 / A),
        "A_s": sticky(S), "A_a": np.stack([sticky(A)] * S),
    }


def patterned(S: int = N_STYLES, A: int = N_ACTIONS) -> Params:
    """A made-up model used to score the test tables."""
    D, B, K = len(CONTINUOUS_FEATURES), len(BINARY_FEATURES), S * A
    z, d, b = np.arange(K)[:, None], np.arange(D)[None, :], np.arange(B)[None, :]
    keep = np.array([0.7, 0.6])
    A_a = np.stack([np.full((A, A), (1 - keep[s % 2]) / (A - 1)) for s in range(S)])
    for s in range(S):
        A_a[s][np.arange(A), np.arange(A)] = keep[s % 2]
    return Params(
        pi_s=np.array([0.6, 0.4]), pi_a=np.array([[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]]),
        A_s=np.array([[0.8, 0.2], [0.3, 0.7]]), A_a=A_a,
        mean=((z * 7 + d * 3) % 11 - 5) / 5.0, var=0.75 + ((z * 5 + d) % 7) / 4.0,
        bern=0.05 + 0.1 * ((z + 3 * b) % 8),
    )
