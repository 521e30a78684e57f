"""Splits and samples by hash rank: repeatable, distributed, no global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import KEYS


def hash_key(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.concat_ws(":", *[c.cast("string") for c in cols])))


def global_rank(df: DataFrame, order: Column, out: str = "rk", prefix_chars: int = 3) -> DataFrame:
    """0-based rank by a uniformly distributed hex ``order`` and the total ``n``.

    The first hex digits give at most 16**prefix_chars equal buckets, which are
    ranked on their own; only one count per bucket is accumulated in one place.
    """
    base = df.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, prefix_chars))
    counts = base.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    # bounded: one row per bucket
    one = Window.partitionBy(F.lit(0)).orderBy("_b")
    offs = counts.select(
        "_b",
        F.coalesce(F.sum("_c").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("n"),
    )
    w = Window.partitionBy("_b").orderBy("_h")
    return (
        base.join(offs, "_b")
        .withColumn(out, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint"))
        .drop("_h", "_b", "_off")
    )


def split_assign(keys: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """Random train / val / test at trajectory level with exact sizes ``int(frac * n)``."""
    if not 0.0 < train < 1.0:
        raise ValueError("train fraction must be between 0 and 1")
    if not 0.0 <= val < 1.0 or train + val > 1.0:
        raise ValueError("fractions must sum to at most 1")
    ranked = global_rank(keys, hash_key(seed, *[F.col(k) for k in KEYS]))
    n_train = F.floor(F.lit(train) * F.col("n"))
    n_val = F.floor(F.lit(val) * F.col("n"))
    split = (
        F.when(F.col("rk") < n_train, "train").when(F.col("rk") < n_train + n_val, "val").otherwise("test")
    )
    return ranked.withColumn("split", split).drop("rk", "n")


def split_overlap(split: DataFrame) -> DataFrame:
    """Keys in more than one split, listed twice, or NULL; empty when the split is clean."""
    bad = split.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("split").alias("n_splits"))
    null_key = F.col("recording_id").isNull() | F.col("vehicle_id").isNull()
    return bad.where((F.col("n_rows") > 1) | null_key)


def hash_sample(df: DataFrame, n: int, seed: int, *cols: str) -> DataFrame:
    """Uniform sample of at most ``n`` rows: the ``n`` smallest hashes.

    Counts by the first digits of the hash find a bound below which all rows are taken; digits are
    added until few rows are left to choose among, so only those are ever sorted in one place.
    """
    base = df.withColumn("_h", hash_key(seed, *[F.col(c) for c in cols]))
    bound, left = "", n
    while left > 0 and len(bound) < 30:
        step = F.substring("_h", len(bound) + 1, 3)
        counts = base.where(F.col("_h").startswith(bound)).groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("c"))
        for r in sorted(counts.collect(), key=lambda r: r["b"]):  # at most 4,096 rows
            if r["c"] > left:
                bound, size = bound + r["b"], r["c"]
                break
            left -= r["c"]
        else:
            return df  # no more rows than asked for
        if size <= 1000:
            break
    whole = base.where(F.substring("_h", 1, len(bound)) < bound)
    rest = base.where(F.col("_h").startswith(bound)).orderBy("_h", *cols).limit(left)
    return whole.unionByName(rest).drop("_h")


def evenly_spaced(keys: DataFrame, n: int, order: Column) -> DataFrame:
    """At most ``n`` rows at evenly spaced ranks of a uniform hex ``order``."""
    ranked = global_rank(keys, order)
    N = F.col("n")
    if n == 1:
        keep = F.col("rk") == 0
    else:
        # rank is floor(i * (N - 1) / (n - 1)) for some i in [0, n)
        i = F.ceil(F.col("rk") * F.lit(n - 1) / F.greatest(N - 1, F.lit(1)))
        keep = (N <= n) | (F.floor(i * (N - 1) / F.lit(float(n - 1))) == F.col("rk"))
    return ranked.where(keep).drop("rk", "n")


def finite_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with every column present; if there is none at all, every row with its gaps as zero.

    A single complete row is enough for the first form: that is the rule of the start values, not a fallback for speed.
    """
    whole = df.dropna(subset=cols)
    return whole if not whole.isEmpty() else df.fillna(0.0, subset=cols)
