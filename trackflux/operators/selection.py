"""Row filters and small state/label codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import ACTION_NAMES, KEYS, N_ACTIONS, STYLE_NAMES


def sa_to_z(s: Column, a: Column, A: int = N_ACTIONS) -> Column:
    return F.when((s < 0) | (a < 0), -1).otherwise(s * A + a).cast("int")


def z_to_sa(z: Column, A: int = N_ACTIONS) -> tuple[Column, Column]:
    known = z >= 0
    return (
        F.when(known, F.floor(z / A)).otherwise(-1).cast("int"),
        F.when(known, z % A).otherwise(-1).cast("int"),
    )


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once, however often ``v`` occurs."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)


def normalised(weights: Column) -> Column:
    """Array divided by its sum."""
    return let(weights, lambda w: let(total(w), lambda n: F.transform(w, lambda x: x / n)))


def belief_prob(logp: Column) -> Column:
    """Log-belief array to probabilities, shifted by its maximum."""
    return normalised(let(F.array_max(logp), lambda m: F.transform(logp, lambda x: F.exp(x - m))))


def argmax(p: Column) -> Column:
    """0-based position of the first maximum."""
    return let(p, lambda v: F.array_position(v, F.array_max(v)) - 1).cast("int")


def state_name(z: Column, names: dict | None = None, styles: dict | None = None, A: int = N_ACTIONS) -> Column:
    """``style/action`` for a joint state, a numbered default when unnamed."""
    names, styles = names or ACTION_NAMES, styles or STYLE_NAMES
    out = None
    for (s, a), action in names.items():
        label = F.lit(f"{styles.get(s, f'style_{s}')}/{action}")
        out = F.when(z == s * A + a, label) if out is None else out.when(z == s * A + a, label)
    s, a = z_to_sa(z, A)
    default = F.concat(F.lit("style_"), s.cast("string"), F.lit("/action_"), a.cast("string"))
    return out.when(z < 0, F.lit("unknown")).otherwise(default)


def lane_pos_rows(df: DataFrame, allowed: list[int]) -> DataFrame:
    return df.where(
        F.col("lane_pos").isin(allowed) & F.col("meta_class").isNotNull() & F.col("meta_drivingDirection").isNotNull()
    )


def lane_violations(df: DataFrame, unknown: bool = True) -> DataFrame:
    """Points left (0) or right (4) of the drivable lanes, optionally unknown (-1)."""
    codes = [0, 4] + ([-1] if unknown else [])
    label = F.when(F.col("lane_pos") == 0, "left").when(F.col("lane_pos") == 4, "right").otherwise("unknown")
    return df.where(F.col("lane_pos").isin(codes)).withColumn("violation", label)


def split_members(df: DataFrame, split: DataFrame) -> DataFrame:
    """Rows of the trajectories listed in ``split``."""
    return df.join(split.select(*KEYS).distinct(), KEYS, "left_semi")


def missing_members(expected: DataFrame, df: DataFrame) -> DataFrame:
    """Expected trajectories with no row left."""
    return expected.select(*KEYS).distinct().join(df.select(*KEYS).distinct(), KEYS, "left_anti")


def interesting_vehicles(
    meta: DataFrame, lane_change: bool = True, accel_brake: bool = True, following: bool = False,
    accel_threshold: float = 2.0, min_frames: int = 150,
) -> DataFrame:
    """Vehicles worth showing, as one predicate over the metadata."""
    changed = F.col("numLaneChanges") > 0
    steady = F.col("numLaneChanges") == 0
    spread = F.abs(F.col("maxXVelocity") - F.col("minXVelocity"))
    want = F.lit(False)
    if lane_change:
        want = want | changed
    if accel_brake:
        want = want | (steady & (spread > accel_threshold))
    if following:
        want = want | (steady & (spread <= accel_threshold))
    return meta.where(want & (F.col("numFrames") >= min_frames)).dropDuplicates(KEYS)


def top_k(p: Column, k: int) -> Column:
    """The ``k`` largest entries as (prob, z) structs, ties to the lower index."""
    pairs = F.transform(p, lambda v, i: F.struct(v.alias("prob"), (-i).alias("neg")))
    ranked = F.slice(F.sort_array(pairs, asc=False), 1, max(1, k))
    return F.transform(ranked, lambda r: F.struct(r["prob"].alias("prob"), (-r["neg"]).cast("int").alias("z")))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Label counts per trajectory with their descending rank."""
    n = df.groupBy(*KEYS, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("n"), label)  # one row per distinct label
    return n.withColumn("rank", F.row_number().over(w).cast("bigint"))


def literal_name(s: Column, names: dict) -> Column:
    """Style name, numbered when unnamed."""
    out = None
    for k, v in names.items():
        out = F.when(s == k, v) if out is None else out.when(s == k, v)
    return out.otherwise(F.concat(F.lit("style_"), s.cast("string")))
