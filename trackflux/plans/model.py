"""Scaled window sequences and model jobs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.storage import cached_table
from ..latent import emission, recursion
from ..latent.params import Params, patterned
from ..operators.scaling import feature_scaler, scaler_dict, zscore_classwise
from ..operators.selection import missing_members, split_members
from ..schema import CONTINUOUS_FEATURES, KEYS
from . import frames as plan

MODEL_W, MODEL_STRIDE = 10, 2


def scale_columns(windows: DataFrame, scaler: dict[str, tuple[float, float]], eps: float = 0.0) -> DataFrame:
    """Add ``s_<feature>`` beside the raw features."""
    return windows.withColumns({
        emission.scaled(n): (F.col(n) - F.lit(m)) / F.lit(s + eps) for n, (m, s) in scaler.items()
    })


def build_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = plan.windows(spark, sf_dir, MODEL_W, MODEL_STRIDE)
    scaled = scale_columns(w, scaler_dict(feature_scaler(w, CONTINUOUS_FEATURES)))
    return scaled.withColumn("t", F.col("window_idx"))


def observations(spark: SparkSession, sf_dir: str, force: bool = False) -> DataFrame:
    """Windows with raw and scaled features, ``t`` counting windows."""
    return cached_table(
        spark, "observations", plan._inputs(sf_dir), lambda: build_observations(spark, sf_dir),
        (MODEL_W, MODEL_STRIDE), force=force,
    )


def class_scalers(train: DataFrame) -> DataFrame:
    """(meta_class, feature, mean, std) of all continuous features, from training windows only."""
    return feature_scaler(train, CONTINUOUS_FEATURES, by=["meta_class"])


def scale_by_class(windows: DataFrame, scalers: DataFrame, eps: float = 0.0) -> DataFrame:
    """Add ``s_<feature>`` by the scaler of the row's class; a class without scaler is an error."""
    raw = windows.withColumns({emission.scaled(c): F.col(c) for c in CONTINUOUS_FEATURES})
    named = scalers.withColumn("feature", F.concat(F.lit("s_"), F.col("feature")))
    return zscore_classwise(raw, named, [emission.scaled(c) for c in CONTINUOUS_FEATURES], eps=eps)


def split_observations(windows: DataFrame, split: DataFrame, names: tuple[str, ...] = ("train", "val", "test"), eps: float = 0.0) -> dict[str, DataFrame]:
    """Scaled windows of each split; scalers come from the training split alone.

    A member of a split that has no window is an error.
    """
    parts = {n: split.where(F.col("split") == n) for n in ("train", *names)}
    for n, members in parts.items():
        lost = missing_members(members, windows).limit(5).collect()
        if lost:
            raise ValueError(f"split {n} lacks windows of {[tuple(r) for r in lost]}")
    scalers = class_scalers(split_members(windows, parts["train"]))
    return {n: scale_by_class(split_members(windows, parts[n]), scalers, eps).withColumn("t", F.col("window_idx")) for n in names}


def emissions(spark: SparkSession, sf_dir: str, p: Params | None = None) -> DataFrame:
    obs = observations(spark, sf_dir)
    return obs.select(*KEYS, "t", emission.log_emission(p or patterned()).alias("logb"))


def feature_rows(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    return observations(spark, sf_dir).select(*KEYS, "t", emission.feature_array(p.continuous, p.binary).alias("x"))


def filtered(spark: SparkSession, sf_dir: str, smoothing: str = "clamp", p: Params | None = None,
             keep_logb: bool = False) -> DataFrame:
    """Online beliefs: prior, posterior and log-likelihood term per window."""
    p = p or patterned()
    rows = feature_rows(spark, sf_dir, p)
    return recursion.forward_filter(rows, p.start(smoothing), p.kernel(smoothing), emit=emission.emitter(p),
                                    keep_logb=keep_logb)


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed posteriors of the patterned model as a table."""
    p = patterned()
    return cached_table(
        spark, "posteriors", plan._inputs(sf_dir),
        lambda: recursion.smooth(
            feature_rows(spark, sf_dir, p), p.start("add"), p.kernel("add"), emit=emission.emitter(p)),
    )


