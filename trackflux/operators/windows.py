"""Count-based sliding windows.

A window holds ``W`` consecutive rows starting every ``stride`` rows. Rows are
shuffled once, by bounded runs of their trajectory with the few rows of the next
run that windows reach into; there each row meets the windows that contain it and
every statistic of every window is a built-in aggregate of one
``groupBy(trajectory, run, window)``, which needs no further shuffle. Groups hold at
most ``W`` rows no matter how long a trajectory is, and a window is complete
exactly when it holds ``W`` rows, so no trajectory length is needed.

Quantiles, which cannot be added up, are read off the values that follow a window's
first row in its run. For long windows rows are reduced to panes of gcd(W, stride) rows
instead, and panes are sent to the windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.ordering import TASK_ROWS, spread
from ..schema import KEYS, NEIGHBOR_SLOTS, REL_SUFFIXES, WINDOW_FEATURES, WINDOW_LEN, WINDOW_STRIDE
from .kinematics import with_index

#: Rows of a run at least, and the longest window whose quantiles are read off lists of its values.
RUN_ROWS, LIST_ROWS = 2048, 256

RISK = ("front_thw", "front_ttc", "front_dhw")
REL_COLS = {f"{s}_{r}": f"{s}_exists" for s in NEIGHBOR_SLOTS.values() for r in REL_SUFFIXES}


def window_members(frames: DataFrame, W: int = WINDOW_LEN, stride: int = WINDOW_STRIDE) -> DataFrame:
    """Rows with ``window_idx`` and the in-window position ``i``, one per containing window."""
    if W < 1 or stride < 1:
        raise ValueError("window length and stride must be positive")
    df = with_index(frames)
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (W - 1)) / F.lit(stride))).cast("bigint")
    last = F.floor(F.col("t") / F.lit(stride)).cast("bigint")
    if stride > W:  # rows between windows belong to none
        df = df.where(F.col("t") % stride < W)
    return df.withColumn("window_idx", F.explode(F.sequence(first, last))).withColumn(
        "i", (F.col("t") - F.col("window_idx") * stride).cast("int")
    )


def window_aggregate(
    frames: DataFrame, aggs: dict[str, Column], W: int = WINDOW_LEN, stride: int = WINDOW_STRIDE,
    carry: list[str] | None = None, exact: dict[str, Column] | None = None, top: list[str] | None = None,
) -> DataFrame:
    """Complete windows with the given aggregates; ``carry`` columns come from the first row.

    Numbers alone are aggregated by hash. What would forbid that is handed on by the windows' first rows: carried columns,
    and the quantiles of the features in ``top``. ``exact`` aggregates (which keep all values) see only the columns they need
    and are joined by window.
    """
    carry, top = [c for c in (carry or []) if c in frames.columns], top or []
    df = with_index(frames)
    # a row is held once for each of its windows, and four windows weigh as much as another job's row
    runs = spread(_in_runs(df, W, stride), [*KEYS, "_run"], df.count(), max(1, 4 * TASK_ROWS // -(-W // stride)))
    first = [F.floor(F.col("t") / F.lit(stride)).cast("bigint").alias("window_idx"), F.col("frame").alias("start_frame"), *carry]
    if top:
        ahead = _run_rows().rangeBetween(0, W - 1)
        runs = runs.withColumns({f"_{n}": F.collect_list(_masked(read_name(n))).over(ahead) for n in top})
        first += [_from_top(F.sort_array(f"_{n}", asc=False), F.size(f"_{n}"), 0.95).alias(n) for n in top]
    begins = F.when((F.col("t") % stride == 0) & (_run(W, stride) == F.col("_run")), F.struct(*first))
    runs = runs.withColumn("_first", F.collect_list(begins).over(_run_rows().rangeBetween(-(W - 1), 0))).drop(*[f"_{n}" for n in top])
    members = runs.withColumn("_first", F.explode(F.array_distinct("_first"))).withColumn(
        "i", (F.col("t") - F.col("_first.window_idx") * stride).cast("int"))
    by = ["window_idx", "start_frame", *carry, *top]
    # a first row that comes twice gives its window twice
    own = (F.col("i") == 0) & F.col("frame").eqNullSafe(F.col("_first.start_frame"))
    for c in carry:
        own = own & F.col(c).eqNullSafe(F.col("_first")[c])
    out = members.groupBy(*KEYS, "_run", *[F.col("_first")[c].alias(f"_f_{c}") for c in by]).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(own.cast("int")).alias("_times"), *[a.alias(n) for n, a in aggs.items()])
    out = out.where(F.col("_n") == W).withColumn("_times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    out = out.select(*KEYS, *[F.col(f"_f_{c}").alias(c) for c in by], *aggs)
    if exact:
        keys = [*KEYS, "window_idx"]
        out = out.join(window_members(df, W, stride).groupBy(*keys).agg(*[a.alias(n) for n, a in exact.items()]), keys)
    return out


def _run(W: int, stride: int, back: int = 0) -> Column:
    """Number of the run that a row, or the row ``back`` rows before it, lies in. A run is some strides long, and longer than a window."""
    rows = stride * -(-max(RUN_ROWS, 4 * W) // stride)
    return F.floor((F.col("t") - back) / F.lit(rows)).cast("bigint")


def _run_rows() -> WindowSpec:
    return Window.partitionBy(*KEYS, "_run").orderBy("t")


def _in_runs(df: DataFrame, W: int, stride: int) -> DataFrame:
    """Rows with ``_run``; those that windows of the run before reach into are there too. Rows without a key or ``t`` are in no window."""
    if W < 1 or stride < 1:
        raise ValueError("window length and stride must be positive")
    if stride > W:  # rows between windows belong to none
        df = df.where(F.col("t") % stride < W)
    known = F.col("t").isNotNull()
    for k in KEYS:
        known = known & F.col(k).isNotNull()
    here = _run(W, stride)
    reached = (_run(W, stride, W - 1) < here) & (here > 0)
    return df.where(known).withColumn("_run", F.explode(F.when(reached, F.array(here, here - 1)).otherwise(F.array(here))))


# statistics over finite rows ------------------------------------------------

def last(x: Column, valid: Column | None = None) -> Column:
    ok = x.isNotNull() if valid is None else valid & x.isNotNull()
    return F.max_by(x, F.when(ok, F.col("i")))


def slope(x: Column, valid: Column | None = None) -> Column:
    y = x if valid is None else F.when(valid, x)
    return F.regr_slope(y, F.when(y.isNotNull(), F.col("i")))


def minimum(x: Column, valid: Column | None = None) -> Column:
    return F.min(x if valid is None else F.when(valid, x))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def p95(x: Column) -> Column:
    return F.percentile(x, F.lit(0.95))


def fraction(cond: Column, x: Column) -> Column:
    """Share of finite rows where ``cond`` holds; NULL without finite rows."""
    return F.avg(F.when(x.isNotNull(), F.when(cond, 1.0).otherwise(0.0)))


def share(cond: Column) -> Column:
    """Share of all rows where ``cond`` holds."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


@dataclass(frozen=True)
class FeatureName:
    """What a window feature's name says: a statistic of a frame column, over the rows that its guards let through."""

    column: str
    stat: str
    value: int | None = None  # what ``equals`` looks for, or the sign that ``sign_frac`` counts
    guard: str | None = None  # existence flag of the vehicle that the column is about
    positive: bool = False  # only values above zero count


STATS = ("last", "slope", "min", "max", "mean", "std", "rms", "p95")


def read_name(name: str) -> FeatureName:
    """The one place where feature names are read, for windows in batch and in the stream."""
    if name in ("lc_left_present", "lc_right_present"):
        return FeatureName("lc", "equals", -1 if "left" in name else 1)
    if name.endswith("_exists_frac"):
        return FeatureName(name.removesuffix("_frac"), "exists_frac")
    for sign, value in (("neg", -1), ("pos", 1), ("zero", 0)):
        if name.endswith(f"_{sign}_frac"):
            return FeatureName(name.removesuffix(f"_{sign}_frac"), "sign_frac", value)
    column, _, stat = name.rpartition("_")
    if stat not in STATS and not (stat == "vfrac" and column in RISK):
        raise ValueError(f"no window statistic for {name}")
    if column in RISK:
        return FeatureName(column, stat, guard="front_exists", positive=True)
    return FeatureName(column, stat, guard=REL_COLS.get(column))


def feature(name: str) -> Column:
    """Aggregate expression of one window feature, read off its name."""
    part = read_name(name)
    x = F.col(part.column)
    if part.stat == "equals":
        return F.max((F.coalesce(x, F.lit(0)) == part.value).cast("double"))
    if part.stat == "exists_frac":
        return share(F.coalesce(x, F.lit(0)) > 0.5)
    if part.stat == "sign_frac":
        return fraction(F.signum(x) == part.value, x)
    valid = F.coalesce(F.col(part.guard), F.lit(0)) > 0.5 if part.guard else None
    if part.positive:
        valid = (x > 0) & valid
    if part.stat == "vfrac":
        return share(valid)
    y = x if valid is None else F.when(valid, x)
    makers = {
        "last": lambda: last(x, valid), "slope": lambda: slope(x, valid), "min": lambda: minimum(x, valid),
        "max": lambda: F.max(y), "mean": lambda: F.avg(y), "std": lambda: F.stddev_pop(y),
        "rms": lambda: rms(y), "p95": lambda: p95(y),
    }
    return makers[part.stat]()


def feature_inputs(names: list[str]) -> list[str]:
    """Frame columns the named features read."""
    cols: dict[str, None] = {}
    for part in map(read_name, names):
        cols[part.column] = None
        if part.guard:
            cols[part.guard] = None
    return list(cols)


def _pane_quantiles(slim: DataFrame, names: list[str], W: int, stride: int, p: float = 0.95) -> DataFrame:
    """Exact quantiles of all windows from panes of gcd(W, stride) rows.

    The wanted ranks of at most ``W`` values lie among the largest few, so a pane keeps its count and no more than those, sorted. Panes, not
    rows, are sent to the windows that contain them. (Sums and extremes need no panes: they are added up by window before the shuffle.)
    """
    size, by = math.gcd(W, stride), [*KEYS, "window_idx"]
    few = math.floor((1 - p) * (W - 1)) + 2
    y = {n: _masked(read_name(n)) for n in names}
    panes = slim.groupBy(*KEYS, F.expr(f"t div {size}").alias("t")).agg(
        *[F.slice(F.sort_array(F.collect_list(y[n]), asc=False), 1, few).alias(f"_{n}") for n in names], *[F.count(y[n]).alias(f"_n_{n}") for n in names])
    merged = window_members(panes, W // size, stride // size).groupBy(*by).agg(
        *[F.sort_array(F.flatten(F.collect_list(f"_{n}")), asc=False).alias(f"_{n}") for n in names], *[F.sum(f"_n_{n}").alias(f"_n_{n}") for n in names])
    return merged.select(*by, *[_from_top(F.col(f"_{n}"), F.col(f"_n_{n}"), p).alias(n) for n in names])


def _masked(part: FeatureName) -> Column:
    """The values that count: NULL where a guard does not let them through."""
    x = F.col(part.column)
    ok = F.coalesce(F.col(part.guard), F.lit(0)) > 0.5 if part.guard else F.lit(True)
    return F.when(ok & (x > 0) if part.positive else ok, x)


def _from_top(largest: Column, n: Column, p: float) -> Column:
    """Interpolated quantile of ``n`` values from the largest ones, in falling order."""
    rank = (n - 1) * F.lit(p)
    low = F.floor(rank)
    at = lambda r: F.element_at(largest, (n - r).cast("int"))
    a, b = at(low), at(F.least(low + 1, n - 1))
    return F.when(n > 0, a + (b - a) * (rank - low))


def windowize(
    frames: DataFrame, names: list[str] | None = None, W: int = WINDOW_LEN, stride: int = WINDOW_STRIDE,
) -> DataFrame:
    """The window table: keys, ``window_idx``, ``start_frame``, metadata and features."""
    names = names or WINDOW_FEATURES
    carry = [c for c in ("meta_class", "meta_drivingDirection") if c in frames.columns]
    slim = with_index(frames).select(*KEYS, "t", "frame", *carry, *feature_inputs(names))
    top = [n for n in names if read_name(n).stat == "p95"]
    listed = top if W <= LIST_ROWS else []
    out = window_aggregate(slim, {n: feature(n) for n in names if n not in top}, W, stride, carry, top=listed)
    if top and not listed:
        out = out.join(_pane_quantiles(slim, top, W, stride), [*KEYS, "window_idx"])
    return out.select(*KEYS, "window_idx", "start_frame", *carry, *names)


def window_counts(frames: DataFrame, W: int = WINDOW_LEN, stride: int = WINDOW_STRIDE) -> DataFrame:
    """Per trajectory: length, number of windows, too short or not."""
    n = frames.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
    count = F.when(F.col("n_rows") >= W, 1 + F.floor((F.col("n_rows") - W) / stride)).otherwise(0).cast("bigint")
    return n.withColumn("n_windows", count).withColumn("skipped", F.col("n_rows") < W)


def window_starts(frames: DataFrame, W: int = WINDOW_LEN, stride: int = WINDOW_STRIDE) -> DataFrame:
    return window_aggregate(with_index(frames).select(*KEYS, "t", "frame"), {}, W, stride)


def to_sequences(frames: DataFrame, cols: list[str], chunk: int = 4096) -> DataFrame:
    """Frames as ordered arrays, ``chunk`` rows per array so no row grows with its trajectory."""
    df = with_index(frames)
    meta = [c for c in ("meta_class", "meta_drivingDirection") if c in df.columns]
    return (
        df.withColumn("chunk", F.floor(F.col("t") / chunk).cast("bigint"))
        .groupBy(*KEYS, "chunk")
        .agg(
            F.array_sort(F.collect_list(F.struct("t", "frame", *cols))).alias("rows"),
            *[F.min_by(c, "t").alias(c) for c in meta],
        )
    )
