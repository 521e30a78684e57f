"""Feature scalers and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.storage import checked_broadcast

STD_FLOOR = 1e-6


def _gate(name: str, columns: list[str]) -> Column | None:
    """``*_mean/_min/_std`` count only where the sibling ``*_vfrac`` is positive."""
    base, _, stat = name.rpartition("_")
    sibling = f"{base}_vfrac"
    if stat in ("mean", "min", "std") and sibling in columns:
        return F.col(sibling) > 0
    return None


def feature_scaler(df: DataFrame, names: list[str], by: list[str] | None = None,
                   unscaled: list[str] | None = None) -> DataFrame:
    """Long scaler table (group columns, feature, mean, std).

    Population standard deviation; below 1e-6 it is 1. A feature without data,
    or listed in ``unscaled``, gets mean 0 and standard deviation 1.
    """
    by = by or []
    aggs = []
    for n in names:
        gate = _gate(n, df.columns)
        x = F.col(n) if gate is None else F.when(gate, F.col(n))
        aggs.append(F.struct(F.lit(n).alias("feature"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(n))
    wide = df.groupBy(*by).agg(*aggs)
    long = wide.select(*by, F.explode(F.array(*[F.col(n) for n in names])).alias("r"))
    std = F.when(F.col("r.s") >= STD_FLOOR, F.col("r.s")).otherwise(F.lit(1.0))
    out = long.select(*by, F.col("r.feature").alias("feature"),
                      F.coalesce("r.m", F.lit(0.0)).alias("mean"), std.alias("std"))
    if unscaled:
        fixed = wide.select(*by).withColumn("feature", F.explode(F.array(*[F.lit(n) for n in unscaled])))
        out = out.unionByName(fixed.withColumns({"mean": F.lit(0.0), "std": F.lit(1.0)}))
    return out


def scaler_dict(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """A global scaler (one row per feature) on the driver."""
    return {r["feature"]: (r["mean"], r["std"]) for r in scaler.select("feature", "mean", "std").collect()}


def zscore_masked(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Scoring form: divisor ``std + 1e-12``; missing stays missing."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s + 1e-12) for c, (m, s) in scaler.items()})


def zscore_train(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Training form: divisor exactly ``std``."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def zscore_classwise(df: DataFrame, scalers: DataFrame, names: list[str], class_col: str = "meta_class",
                     eps: float = 0.0) -> DataFrame:
    """Scale every row with the scaler of its class; an unknown class is an error."""
    wide = scalers.groupBy(class_col).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_m")
    )
    flat = wide.select(
        class_col, F.lit(True).alias("_known"),
        *[F.col("_m")[n]["mean"].alias(f"_mean_{n}") for n in names],
        *[F.col("_m")[n]["std"].alias(f"_std_{n}") for n in names],
    )
    joined = df.join(checked_broadcast(flat, 1000), class_col, "left")
    unknown = F.raise_error(F.concat(F.lit("no scaler for class "), F.coalesce(F.col(class_col), F.lit("NULL"))))
    ok = F.col("_known").isNotNull()
    cols = {
        n: F.when(ok, (F.col(n) - F.col(f"_mean_{n}")) / (F.col(f"_std_{n}") + F.lit(eps))).otherwise(unknown.cast("double"))
        for n in names
    }
    return joined.withColumns(cols).select(*df.columns)
