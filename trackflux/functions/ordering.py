"""Order-dependent work that does not need a whole trajectory in one task.

A trajectory may hold a large share of all rows, so nothing here sorts or
windows over a bare trajectory key. ``dense_index`` numbers rows by cutting
long trajectories into slices of the ordering column; ``in_segments`` runs
lag/lead style expressions over bounded runs of the dense index, with the few
neighbouring rows each run needs copied in as a halo.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import KEYS
from .storage import materialise

SEGMENT_ROWS = 65_536
#: Rows that one task takes where it holds many times what it reads from the shuffle.
TASK_ROWS = 65_536


def parts_for(rows: int, least: int, rows_per_task: int = TASK_ROWS) -> int | None:
    """Partitions for so many rows, or None if ``least`` tasks suffice."""
    parts = math.ceil(rows / rows_per_task)
    return parts if parts > least else None


def spread(df: DataFrame, keys: list[str], rows: int | None, rows_per_task: int = TASK_ROWS) -> DataFrame:
    """Shuffle by ``keys`` into partitions whose number follows ``rows``; a later grouping or window by these keys shuffles no more.

    Partitions that the planner sizes hold so many bytes of the shuffle, whatever a row becomes in memory. Few rows, or an unknown
    number, are left to it.
    """
    parts = rows and parts_for(rows, df.sparkSession.sparkContext.defaultParallelism, rows_per_task)
    return df.repartition(parts, *keys) if parts else df


def longest_key(df: DataFrame, keys: list[str] = KEYS) -> int:
    """Rows of the largest key: one narrow, map-side combined count."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return int(top or 0)


def dense_index(
    df: DataFrame,
    order: Column,
    tie: list[str] | None = None,
    keys: list[str] = KEYS,
    out: str = "t",
    longest: int | None = None,
    rows_per_slice: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add the 0-based position of every row inside its key; rows without ``order`` come first.

    ``order`` must be numeric. If the largest key is checked to fit one slice a
    plain window numbers it. Otherwise keys are cut over the range of ``order``; a
    slice that a count shows to hold too many rows (values crowd, or one lies far out) is cut
    again over its own range, until each fits or holds one value only. Slices are numbered on their own
    and shifted by the rows in earlier slices of the key.
    """
    tie = tie or []
    if longest is None:
        longest = longest_key(df, keys)
    base = df.withColumn("_o", order)
    if longest <= rows_per_slice:
        w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_o"), *tie)
        return base.withColumn(out, (F.row_number().over(w) - 1).cast("bigint")).drop("_o")

    pos = F.col("_o").cast("double")
    # a slice's name orders it: one fixed-width number per cut, rows without ``order`` before all others
    sliced = base.withColumn("_slice", F.when(pos.isNull(), F.lit("0")).otherwise(F.lit("1")))
    for _ in range(64):
        stats = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
        crowded = materialise(stats.where((F.col("_n") > rows_per_slice) & (F.col("_lo") < F.col("_hi"))))
        if crowded.isEmpty():
            break
        parts = F.least(F.ceil(F.col("_n") / rows_per_slice), F.lit(99_999))
        part = F.least(F.floor((pos - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / parts)), parts - 1).cast("bigint")
        sliced = sliced.join(crowded, [*keys, "_slice"], "left").withColumn(
            "_slice", F.when(F.col("_n").isNull(), F.col("_slice")).otherwise(F.concat("_slice", F.lit("."), F.lpad(part.cast("string"), 5, "0")))
        ).drop("_n", "_lo", "_hi")

    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, "_slice").orderBy(F.asc_nulls_first("_o"), *tie)
    return (
        sliced.join(offsets, [*keys, "_slice"], "left")
        .withColumn(out, (F.coalesce("_off", F.lit(0)) + F.row_number().over(local) - 1).cast("bigint"))
        .drop("_o", "_slice", "_off")
    )


def in_segments(
    df: DataFrame,
    steps,
    before: int = 0,
    after: int = 0,
    keys: list[str] = KEYS,
    t: str = "t",
    longest: int | None = None,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Evaluate ordered expressions over bounded runs of the dense index.

    ``steps(window)`` returns a list of column dicts applied in turn.
    ``before`` / ``after`` say how many rows back and ahead they look in total.
    ``longest`` is the checked row count of the largest key (``None`` counts).
    """
    if longest is None:
        longest = int(df.agg(F.max(t)).first()[0] or 0) + 1
    if longest <= rows:
        out = df
        for cols in steps(Window.partitionBy(*keys).orderBy(t)):
            out = out.withColumns(cols)
        return out
    seg = F.floor(F.col(t) / rows).cast("bigint")
    pos = F.col(t) % rows
    none = F.array().cast("array<bigint>")
    homes = [F.array(seg)]
    if before:
        homes.append(F.when(pos >= rows - before, F.array(seg + 1)).otherwise(none))
    if after:
        homes.append(F.when((pos < after) & (seg > 0), F.array(seg - 1)).otherwise(none))
    out = df.withColumn("_seg", F.explode(F.concat(*homes)) if len(homes) > 1 else seg)
    for cols in steps(Window.partitionBy(*keys, "_seg").orderBy(t)):
        out = out.withColumns(cols)
    if len(homes) > 1:
        out = out.where(F.col("_seg") == F.floor(F.col(t) / rows))
    return out.drop("_seg")


def running_sum(df: DataFrame, value: Column, out: str, keys: list[str] = KEYS, t: str = "t",
                longest: int | None = None, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Inclusive running sum of ``value`` along ``t``.

    For long keys, sums per segment are accumulated first (one row per
    segment) and rows add the running sum inside their segment.
    """
    if longest is None:
        longest = int(df.agg(F.max(t)).first()[0] or 0) + 1
    base = df.withColumn("_x", value)
    if longest <= rows:
        w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
        return base.withColumn(out, F.sum("_x").over(w)).drop("_x")
    base = base.withColumn("_seg", F.floor(F.col(t) / rows).cast("bigint"))
    sums = base.groupBy(*keys, "_seg").agg(F.sum("_x").alias("_s"))
    prior = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.withColumn("_off", F.sum("_s").over(prior)).where(F.col("_off").isNotNull()).drop("_s")
    w = Window.partitionBy(*keys, "_seg").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return (
        base.join(offs, [*keys, "_seg"], "left")
        .withColumn(out, F.sum("_x").over(w) + F.coalesce("_off", F.lit(0)))
        .drop("_x", "_seg", "_off")
    )
