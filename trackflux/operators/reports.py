"""Aggregations behind the dataset reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import all_of
from ..functions.quantiles import exact_quantiles
from ..functions.storage import materialise
from ..schema import BINARY_FEATURES, KEYS
from . import runs
from .windows import window_counts


def unpivot(df: DataFrame, by: list[str], signals: list[str]) -> DataFrame:
    """Long form (by..., signal, x) without missing values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in signals]))
    return df.select(*by, pairs.alias("_p")).select(*by, "_p.signal", "_p.x").where(F.col("x").isNotNull())


def grouped_stats(long: DataFrame, by: list[str], probs: dict[str, float], x: str = "x",
                  row_limit: int | None = None) -> DataFrame:
    """count, mean, population std, min, max and exact quantiles per group."""
    basic = long.groupBy(*by).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    kw = {} if row_limit is None else {"row_limit": row_limit}
    q = exact_quantiles(long, by, x, probs, **kw)
    if not by:
        return one_row(basic, q)
    cond = all_of(*[basic[c].eqNullSafe(q[c]) for c in by])  # stays an equi-join
    return basic.join(q, cond, "left").select(*[basic[c] for c in basic.columns], *[q[p] for p in probs])


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row, without a cross join."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def vehicle_std(df: DataFrame, signal: str, min_rows: int) -> DataFrame:
    """Population std per trajectory with enough rows and enough values."""
    agg = df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(signal).alias("n"), F.stddev_pop(signal).alias("std")
    )
    return agg.where((F.col("n_rows") >= min_rows) & (F.col("n") >= min_rows)).drop("n_rows")


SUBSETS = {"global": [], "direction": ["meta_drivingDirection"], "class": ["meta_class"],
           "direction_class": ["meta_drivingDirection", "meta_class"]}


def subset_grid(df: DataFrame, signals: list[str], subsets: dict[str, list[str]] | None = None) -> DataFrame:
    """The same statistics for all rows and every direction / class subset.

    Frame rows are read once and reduced to counted values by (direction, class, signal). Moments of those groups are put together
    by subset; quantiles are taken of the counted values, tagged with their subsets.
    """
    subsets = subsets or SUBSETS
    fine, by = ["meta_drivingDirection", "meta_class", "signal"], ["subset", "direction", "class", "signal"]
    tags = []
    for name, cols in subsets.items():
        keep = lambda c: F.col(c).cast("string") if c in cols else F.lit(None).cast("string")  # noqa: B023,E731
        tags.append(F.struct(
            F.lit(name).alias("subset"), keep("meta_drivingDirection").alias("direction"), keep("meta_class").alias("class"),
        ))

    def tagged(rows: DataFrame, *cols: str) -> DataFrame:
        return rows.select("signal", *cols, F.explode(F.array(*tags)).alias("_t")).select("signal", *cols, "_t.subset", "_t.direction", "_t.class")

    counted = materialise(unpivot(df, fine[:2], signals).groupBy(*fine, "x").agg(F.count(F.lit(1)).alias("times")))
    parts = _moments(counted.withColumns({"n": F.col("times"), "mean": F.col("x"), "m2": F.lit(0.0), "min": F.col("x"), "max": F.col("x")}), fine)
    basic = _moments(tagged(parts, "n", "mean", "m2", "min", "max"), by).select(
        *by, F.col("n").alias("count"), "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"), "min", "max")
    probs = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    q = exact_quantiles(tagged(counted, "x", "times"), by, "x", probs, times="times")
    cond = all_of(*[basic[c].eqNullSafe(q[c]) for c in by])
    return basic.join(q, cond, "left").select(*[basic[c] for c in basic.columns], *[q[p] for p in probs])


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Parts with n, mean and squared distances ``m2`` about it, put together by group: distances are taken about the group's own mean."""
    mean = rows.groupBy(*by).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    named = mean.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_mean")
    same = all_of(*[F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    about = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    return rows.join(named, same).groupBy(*by).agg(
        F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(about).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))


def histogram(df: DataFrame, x: str, bins: int = 200, lo_q: float = 0.01, hi_q: float = 0.99) -> DataFrame:
    """Equal-width counts and densities with the robust display range.

    All ``bins`` rows come back, empty ones with zero; without any value there is no row.
    """
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    shape = "bin int, count bigint, `left` double, density double, view_lo double, view_hi double"
    if not rng.n:
        return df.sparkSession.createDataFrame([], shape)
    q = exact_quantiles(df, [], x, {"q_lo": lo_q, "q_hi": hi_q}).first()
    width = (rng.hi - rng.lo) / bins
    b = F.least(F.floor((F.col(x) - rng.lo) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
    counts = df.where(F.col(x).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = every.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return counts.select(
        "bin", "count", (F.lit(rng.lo) + F.col("bin") * F.lit(width)).alias("left"),
        (F.col("count") / (F.lit(float(rng.n)) * F.lit(width or 1.0))).alias("density"),
        F.lit(q.q_lo).alias("view_lo"), F.lit(q.q_hi).alias("view_hi"),
    )


def value_counts(df: DataFrame, x: str, lo_q: float = 0.01, hi_q: float = 0.99) -> DataFrame:
    """Exact counts of each value inside the robust range, and the bar width.

    The width is 0.9 times the median gap between neighbouring values; values
    are numbered per bucket of the range so no single task sorts all of them.
    """
    q = exact_quantiles(df, [], x, {"lo": lo_q, "hi": hi_q}).first()
    if q is None or q.lo is None:
        return df.select(F.col(x).alias("value")).limit(0).withColumns({"count": F.lit(0), "bar_width": F.lit(0.02)})
    inside = df.where(F.col(x).isNotNull())
    if q.lo < q.hi:
        inside = inside.where(F.col(x).between(q.lo, q.hi))
    counts = inside.groupBy(F.col(x).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    gaps = neighbour_gaps(counts, "value")
    med = exact_quantiles(gaps, [], "gap", {"m": 0.5}).first()
    width = 0.9 * (med.m if med is not None and med.m is not None else 0.02 / 0.9)
    return counts.withColumn("bar_width", F.lit(width))


def neighbour_gaps(values: DataFrame, x: str) -> DataFrame:
    """Positive differences between consecutive distinct values.

    Values are dealt out by ranges of equal row counts; a range's first value meets the last one of the range before it.
    """
    base = materialise(values.select(F.col(x).alias("_v")).repartitionByRange("_v").withColumn("_b", F.spark_partition_id()))
    w = Window.partitionBy("_b").orderBy("_v")
    inner = base.select((F.col("_v") - F.lag("_v").over(w)).alias("gap"))
    ends = base.groupBy("_b").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    one = Window.partitionBy(F.lit(0)).orderBy("_b")  # one row per partition
    outer = ends.select((F.col("lo") - F.lag("hi").over(one)).alias("gap"))
    return inner.unionAll(outer).where(F.col("gap") > 0)


def with_percent(df: DataFrame, count: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Percent of the (small, already aggregated) group total."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    total = F.sum(count).over(w)
    return df.withColumn(out, F.when(total > 0, 100.0 * F.col(count) / total).otherwise(0.0))


def lc_per_trajectory(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lane changes per vehicle, and vehicles per lane-change count."""
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    lc = F.col("lc")
    per = df.groupBy(*KEYS).agg(hit(lc != 0).alias("n_lc"), hit(lc == -1).alias("n_left"), hit(lc == 1).alias("n_right"))
    dist = per.groupBy("n_lc").agg(F.count(F.lit(1)).alias("vehicle_count"))
    return per, with_percent(dist, "vehicle_count", "vehicle_pct")


def lc_frame_distribution(df: DataFrame) -> DataFrame:
    """Frames with lc -1, 0, +1; empty classes stay as zero."""
    one = df.agg(*[F.count_if(F.col("lc") == v).alias(f"c{i}") for i, v in enumerate((-1, 0, 1))])
    long = one.selectExpr("stack(3, -1, c0, 0, c1, 1, c2) as (lc, frames)")
    return with_percent(long, "frames", "pct")


SIDES = ["left", "right", "unknown"]


def side_counts(events: DataFrame, by: Column | None = None, name: str = "split_value") -> DataFrame:
    """Events per side, zero-filled, with percent inside each split value (NULL is a value).

    Without a split there are three rows even if there is no event.
    """
    counts = [F.count_if(F.col("lc_side") == s).alias(s) for s in SIDES]
    if by is None:
        wide = events.agg(*counts).withColumn(name, F.lit("all"))
    else:
        wide = events.groupBy(by.cast("string").alias(name)).agg(*counts)
    pairs = ", ".join(f"'{s}', `{s}`" for s in SIDES)
    long = wide.selectExpr(f"`{name}`", f"stack({len(SIDES)}, {pairs}) as (side, count)")
    return with_percent(long, "count", "pct", [name])


def side_counts_split(events: DataFrame) -> DataFrame:
    """Side counts by direction, class and direction x class in one frame."""
    d, c = F.col("meta_drivingDirection").cast("string"), F.col("meta_class")
    tags = F.array(
        F.struct(F.lit("direction").alias("split"), d.alias("value")),
        F.struct(F.lit("class").alias("split"), c.alias("value")),
        F.struct(F.lit("direction_class").alias("split"), F.concat(d, F.lit("__"), c).alias("value")),
    )
    tagged = events.select("lc_side", F.explode(tags).alias("_t")).select("lc_side", "_t.split", "_t.value")
    wide = tagged.groupBy("split", "value").agg(*[F.count_if(F.col("lc_side") == s).alias(s) for s in SIDES])
    pairs = ", ".join(f"'{s}', `{s}`" for s in SIDES)
    long = wide.selectExpr("split", "value", f"stack({len(SIDES)}, {pairs}) as (side, count)")
    return with_percent(long, "count", "pct", ["split", "value"])


def lane_pose_table(df: DataFrame, by: list[str], codes: list[int] | None = None) -> DataFrame:
    """Lane position counts as columns, their total and fractions."""
    codes = codes or [-1, 0, 1, 2, 3, 4]
    name = lambda k: f"n_{k}" if k >= 0 else f"n_m{-k}"
    wide = df.groupBy(*by).agg(*[F.count_if(F.col("lane_pos") == k).alias(name(k)) for k in codes])
    total = sum((F.col(name(k)) for k in codes[1:]), F.col(name(codes[0])))
    wide = wide.withColumn("total", total)
    return wide.withColumns({f"frac_{name(k)[2:]}": F.try_divide(F.col(name(k)), F.col("total")) for k in codes})


def lane_pose_mode(df: DataFrame) -> DataFrame:
    """One row per vehicle: most frequent lane position (lowest on ties), first class and direction."""
    counts = df.where(F.col("lane_pos").isNotNull()).groupBy(*KEYS, "lane_pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("frame", "meta_class", "meta_drivingDirection")).alias("first"),
    )
    return counts.groupBy(*KEYS).agg(
        F.max(F.struct("n", (-F.col("lane_pos")).alias("neg"))).alias("best"), F.min("first").alias("first")
    ).select(*KEYS, (-F.col("best.neg")).alias("lane_pos"), "first.meta_class", "first.meta_drivingDirection")


def lane_spans(meta: DataFrame) -> DataFrame:
    """Lane spans per carriageway and the median strip, from ``upper`` / ``lower`` lists."""
    out = None
    for side in ("lower", "upper"):
        m = F.array_distinct(F.col(side))  # a marking given twice makes no lane of width zero
        pairs = F.transform(
            F.sequence(F.lit(1), F.size(m) - 1), lambda i: F.struct(F.element_at(m, i).alias("y0"), F.element_at(m, i + 1).alias("y1"))
        )
        spans = meta.where(F.size(m) >= 2).select("recording_id", F.posexplode(pairs).alias("lane", "s")).select(
            "recording_id", F.lit(side).alias("carriageway"), "lane", "s.y0", "s.y1"
        )
        out = spans if out is None else out.unionByName(spans)
    median = meta.select(
        "recording_id", F.lit("median").alias("carriageway"), F.lit(0).alias("lane"),
        F.array_max("lower").alias("y0"), F.array_min("upper").alias("y1"),
    ).where(F.col("y1") > F.col("y0"))
    return out.unionByName(median)


def accel_thresholds(df: DataFrame, ax: str = "ax") -> DataFrame:
    q = exact_quantiles(df, [], ax, {"p10": 0.1, "p90": 0.9})
    return q.select("p10", "p90", F.abs("p10").alias("a_brake"), F.col("p90").alias("a_accel"))


def _event_summary(events: DataFrame, W: int, prefix: str) -> DataFrame:
    """Totals and position quantiles of events carrying ``t`` and ``n_rows``."""
    ok = runs.centered_feasible(F.col("t"), F.col("n_rows"), W)
    e = events.withColumn("ok", ok).withColumn("pos", F.when(ok, F.col("t") / F.col("n_rows")))
    tot = e.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("valid"))
    q = exact_quantiles(e, [], "pos", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return one_row(tot, q).select(
        F.col("total").alias(f"{prefix}events_total"),
        F.col("valid").alias(f"{prefix}events_valid_centered"),
        (F.col("total") - F.col("valid")).alias(f"{prefix}events_dropped_boundary"),
        F.try_divide(F.col("valid"), F.col("total")).alias(f"{prefix}valid_centered_rate"),
        *[F.col(p).alias(f"{prefix}pos_{p}") for p in ("p10", "median", "p90")],
    )


def lc_feasibility(df: DataFrame, W: int = 150, stride: int = 10, min_gap: int = 10, longest: int | None = None) -> DataFrame:
    """One summary row: trajectories, lane-change events and windows."""
    counts = window_counts(df, W, stride)
    trajs = counts.agg(
        F.count(F.lit(1)).alias("num_total"), F.count_if(~F.col("skipped")).alias("num_usable"),
        F.count_if("skipped").alias("num_short"), F.min("n_rows").alias("len_min"), F.max("n_rows").alias("len_max"),
        F.sum("n_windows").alias("total_windows"),
    )
    lens = exact_quantiles(counts, [], "n_rows", {"len_p10": 0.1, "len_median": 0.5, "len_p90": 0.9})
    usable = counts.where(~F.col("skipped")).select(*KEYS, "n_rows")
    events = runs.debounce(runs.lc_events(df).select(*KEYS, "t"), min_gap, longest).join(usable, KEYS)
    lc_windows = _windows_hit(events, W, stride).agg(F.count(F.lit(1)).alias("lc_windows"))
    out = one_row(trajs, lens, _event_summary(events, W, "lc_"), lc_windows)
    return out.withColumn("kl_windows", F.col("total_windows") - F.col("lc_windows")).withColumn(
        "lc_window_fraction", F.try_divide(F.col("lc_windows"), F.col("total_windows"))
    )


def _windows_hit(events: DataFrame, W: int, stride: int) -> DataFrame:
    """Distinct complete windows holding an event, straight from event positions."""
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (W - 1)) / F.lit(stride))).cast("bigint")
    last = F.least(F.floor(F.col("t") / F.lit(stride)), F.floor((F.col("n_rows") - W) / F.lit(stride))).cast("bigint")
    return events.select(*KEYS, first.alias("a"), last.alias("b")).where("a <= b").select(
        *KEYS, F.explode(F.sequence("a", "b")).alias("window_idx")
    ).distinct()


def longitudinal_feasibility(
    df: DataFrame, a_brake: float, a_accel: float, W: int = 150, stride: int = 10, min_event: int = 5,
    min_gap: int = 10, min_frames: int | None = None, longest: int | None = None,
) -> DataFrame:
    """One summary row for brake and accel events and windows."""
    min_frames = min_frames if min_frames is not None else -(-W * 5 // 100)
    counts = window_counts(df, W, stride)
    parts = [counts.agg(
        F.count(F.lit(1)).alias("num_total"), F.count_if("skipped").alias("num_short"), F.sum("n_windows").alias("total_windows")
    )]
    usable = counts.where(~F.col("skipped")).select(*KEYS, "n_rows")
    masks = {"brake": F.col("ax") < -a_brake, "accel": F.col("ax") > a_accel}
    present = runs.presence(df.join(usable, KEYS, "left_semi"), masks, W, stride)
    for name, mask in masks.items():
        centers = runs.mask_runs(df, mask, min_event, longest).select(*KEYS, F.col("center").alias("t"))
        events = runs.debounce(centers, min_gap, longest).join(usable, KEYS)
        parts.append(_event_summary(events, W, f"{name}_"))
    wins = present.agg(*[F.count_if(F.col(n) >= min_frames).alias(f"{n}_windows") for n in masks])
    return one_row(*parts, wins).withColumns({f"{n}_window_fraction": F.try_divide(F.col(f"{n}_windows"), F.col("total_windows")) for n in masks})


def window_feature_stats(windows: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: quantiles, moments, and masses at 0 / 1 for flags and fractions."""
    long = unpivot(windows, [], features).withColumnRenamed("signal", "feature")
    stats = grouped_stats(long, ["feature"], {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})
    eps = 1e-12
    binary = F.col("feature").isin(BINARY_FEATURES)
    frac = F.col("feature").rlike("(_vfrac|_frac)$")
    c = F.least(F.greatest(F.col("x"), F.lit(0.0)), F.lit(1.0))
    on = F.col("x") > 0.5
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    mass = long.groupBy("feature").agg(
        share(on).alias("_on"), share(c <= eps).alias("_f0"), share(c >= 1 - eps).alias("_f1"),
        F.count_if((c > eps) & (c < 1 - eps)).alias("_mid"),
    )
    return stats.join(mass, "feature").select(
        "feature", "p01", "p10", "p50", "p90", "p99", "mean", "std", "count",
        F.when(binary, F.col("_on")).alias("rate_1"),
        F.when(binary, 1 - F.col("_on")).when(frac, F.col("_f0")).alias("mass_at_0"),
        F.when(binary, F.col("_on")).when(frac, F.col("_f1")).alias("mass_at_1"),
        F.when(frac & ~binary, F.col("_mid")).otherwise(F.lit(0)).alias("mid_count"),
    )


def inverse_freq_weight(windows: DataFrame, flags: list[str], clip: float = 25.0) -> DataFrame:
    """Weight of rows with any flag: 1 / share, clipped; 1 without rows."""
    active = F.lit(False)
    for f in flags:
        active = active | F.coalesce(F.col(f) > 0.5, F.lit(False))
    p = F.avg(F.when(active, 1.0).otherwise(0.0))
    return windows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"),
        F.coalesce(F.least(1.0 / F.greatest(p, F.lit(1e-6)), F.lit(clip)), F.lit(1.0)).alias("weight"),
    )


def post_scale_check(scaled: DataFrame, features: list[str]) -> DataFrame:
    """Mean, std and count of scaled features by first and second moments."""
    long = unpivot(scaled, [], features).withColumnRenamed("signal", "feature")
    agg = long.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("m2"))
    var = F.greatest(F.col("m2") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return agg.select("feature", "mean", F.sqrt(var).alias("std"), "n")
