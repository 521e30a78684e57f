"""Exact, linearly interpolated quantiles of arbitrarily large groups.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
That is right for small groups and wrong for a group holding a third of the
data, so groups above a row limit are narrowed first: equal-width bins are
counted (map-side combined), the bins holding the wanted ranks are kept, and
this repeats until each wanted rank lies among few rows or in one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .storage import materialise

ROW_LIMIT = 2_000_000
BINS = 4096


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    row_limit: int = ROW_LIMIT, known_small: bool = False, times: str | None = None) -> DataFrame:
    """One row per group with a column per entry of ``probs``. With ``times`` a row stands for so many equal ones.

    ``known_small`` skips the size check when the caller has a proven bound on
    the rows (or distinct values) per group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), (F.lit(1).cast("bigint") if times is None else F.col(times)).alias("_c"))
    if not known_small:
        largest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if largest is not None and largest > row_limit:
            # a struct key groups NULL labels like any other value, also in joins
            packed = rows.select((F.struct(*by) if by else F.lit(0)).alias("_g"), "_v", "_c")
            found = _narrowed(packed, ["_g"], probs, row_limit)
            return found.select(*[F.col("_g")[c].alias(c) for c in by], *probs)
    return _direct(rows, by, probs)


def _direct(rows: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    agg = rows.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(p) for p in probs.values()]), F.col("_c")).alias("_q"))
    return agg.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def _narrowed(rows: DataFrame, by: list[str], probs: dict[str, float], row_limit: int) -> DataFrame:
    # ties collapse here, before anything is shuffled
    counts = materialise(rows.groupBy(*by, "_v").agg(F.sum("_c").alias("_c")))
    totals = counts.groupBy(*by).agg(
        F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    # the two ranks each quantile interpolates between
    wanted = totals.select(
        *by, "_lo", "_hi", F.col("_n"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("q"), F.lit(p).alias("p")) for n, p in probs.items()])).alias("_w"),
    ).select(
        *by, "_lo", "_hi", F.col("_w.q").alias("_q"),
        ((F.col("_n") - 1) * F.col("_w.p")).alias("_h"),
    ).select(
        "*", F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_rank")
    ).select(*by, "_q", "_h", "_rank", "_lo", "_hi", F.lit(0).cast("bigint").alias("_below")).dropDuplicates(
        [*by, "_q", "_rank"]
    )
    open_ranks = materialise(wanted)
    done = None
    while True:
        # several wanted ranks share an interval; bin every interval once
        spans = open_ranks.select(*by, "_lo", "_hi", "_below").distinct()
        width = (F.col("_hi") - F.col("_lo")) / BINS
        inside = counts.join(spans, by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        binned = (
            inside.withColumn(
                "_bin", F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BINS - 1))).otherwise(0)
            )
            .groupBy(*by, "_lo", "_hi", "_below", "_bin")
            .agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_vlo"), F.max("_v").alias("_vhi"))
        )
        # at most BINS rows per window partition
        w = Window.partitionBy(*by, "_lo", "_hi", "_below").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        binned = binned.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
        hit = (
            open_ranks.join(binned, [*by, "_lo", "_hi", "_below"])
            .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c")))
            .select(*by, "_q", "_h", "_rank", F.col("_vlo").alias("_lo"), F.col("_vhi").alias("_hi"),
                    F.col("_start").alias("_below"), "_d")
        )
        hit = materialise(hit)
        found = hit.where(F.col("_lo") == F.col("_hi")).select(*by, "_q", "_h", "_rank", F.col("_lo").alias("_x"))
        done = found if done is None else done.unionByName(found)
        open_ranks = hit.where(F.col("_lo") < F.col("_hi")).drop("_d")
        biggest = hit.where(F.col("_lo") < F.col("_hi")).agg(F.max("_d")).first()[0]
        if biggest is None:
            break
        if biggest <= row_limit // 4:
            w = Window.partitionBy(*by, "_lo", "_hi", "_below").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
            spans = open_ranks.select(*by, "_lo", "_hi", "_below").distinct()
            inside = (
                counts.join(spans, by)
                .where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                .withColumn("_start", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
            )
            found = (
                open_ranks.join(inside, [*by, "_lo", "_hi", "_below"])
                .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c")))
                .select(*by, "_q", "_h", "_rank", F.col("_v").alias("_x"))
            )
            done = done.unionByName(found)
            break
    frac = F.col("_h") - F.floor("_h")
    per_q = done.groupBy(*by, "_q").agg(
        (F.min("_x") + (F.max("_x") - F.min("_x")) * F.max(frac)).alias("_x")
    )
    return per_q.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == n, F.col("_x"))).alias(n) for n in probs])
