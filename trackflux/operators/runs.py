"""Ordered functions over runs and events inside a trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordering import SEGMENT_ROWS, dense_index, in_segments, running_sum
from ..schema import KEYS
from .windows import window_aggregate


def index_and_length(df: DataFrame) -> DataFrame:
    """``t`` and trajectory length ``n_rows`` on every row; it comes from a pre-aggregated count."""
    return df.join(df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")), KEYS)


def lc_events(df: DataFrame, lc: str = "lc") -> DataFrame:
    """Event rows with their side."""
    side = F.when(F.col(lc) == -1, "left").when(F.col(lc) == 1, "right").otherwise("unknown")
    return df.where(F.col(lc).isNotNull() & (F.bround(F.col(lc).cast("double")) != 0)).withColumn("lc_side", side)


def lane_events(df: DataFrame, lane: str = "lane_id", longest: int | None = None) -> DataFrame:
    """Fallback events: the lane differs from the row before."""
    out = in_segments(df, lambda w: [{"_prev": F.lag(lane).over(w)}], before=1, longest=longest)
    return out.where(F.col(lane) != F.col("_prev")).drop("_prev")


def mask_runs(df: DataFrame, mask: Column, min_len: int = 1, longest: int | None = None,
              by: list[str] | None = None) -> DataFrame:
    """Maximal runs of rows where ``mask`` holds: start, end, length, centre.

    A run is numbered by the running count of run starts, so no trajectory
    needs to be held as a whole.
    """
    keys = [*KEYS, *(by or [])]
    flag = F.coalesce(mask, F.lit(False))
    marked = in_segments(
        df.select(*keys, "t", flag.alias("_on")),
        lambda w: [{"_start": F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))}],
        before=1, longest=longest, keys=keys,
    )
    ids = running_sum(marked, F.col("_start").cast("int"), "_run", longest=longest, keys=keys)
    runs = ids.where("_on").groupBy(*keys, "_run").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count(F.lit(1)).alias("length")
    )
    return runs.where(F.col("length") >= min_len).withColumn(
        "center", F.floor((F.col("start_t") + F.col("end_t")) / 2).cast("bigint")
    ).drop("_run")


def run_lengths(df: DataFrame, state: str, longest: int | None = None) -> DataFrame:
    """Run-length encoding of a state path: run index, state, duration."""
    marked = in_segments(
        df.select(*KEYS, "t", state),
        lambda w: [{"_new": F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))}],
        before=1, longest=longest,
    )
    marked = marked.withColumn("_new", F.when(F.col("t") == 0, 1).otherwise(F.col("_new")))
    ids = running_sum(marked, F.col("_new"), "run", longest=longest)
    return ids.groupBy(*KEYS, "run").agg(
        F.first(state).alias(state), F.min("t").alias("start_t"), F.count(F.lit(1)).alias("duration")
    )


def debounce(events: DataFrame, min_gap: int, longest: int | None = None, by: list[str] | None = None,
             rows: int = SEGMENT_ROWS) -> DataFrame:
    """Keep the first event, then each at least ``min_gap`` after the last kept one.

    An event that far from the event before it is kept whatever happened
    earlier, so events split there into independent chains; the greedy fold
    runs inside one chain. ``events`` needs ``t`` unique per key.
    """
    keys = [*KEYS, *(by or [])]
    pos = dense_index(events.select(*keys, "t"), F.col("t"), keys=keys, out="_i", longest=longest, rows_per_slice=rows)
    pos = in_segments(
        pos, lambda w: [{"_break": (F.col("t") - F.lag("t").over(w) >= min_gap).cast("int")}],
        before=1, keys=keys, t="_i", longest=longest, rows=rows,
    )
    chains = running_sum(pos, F.coalesce("_break", F.lit(0)), "_chain", keys=keys, t="_i", longest=longest, rows=rows)
    chains = chains.withColumn("_piece", F.floor(F.col("_i") / rows).cast("bigint"))
    pieces = chains.groupBy(*keys, "_chain", "_piece").agg(F.array_sort(F.collect_list("t")).alias("_ts"))
    first = F.element_at("_ts", 1)
    if longest is not None and longest <= rows:
        entry = first - min_gap
    else:
        pieces = pieces.join(_chain_entries(pieces, keys, min_gap), [*keys, "_chain", "_piece"], "left")
        entry = F.coalesce("_entry", first - min_gap)
    types = dict(events.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", t bigint"

    def fold(batches):
        # only the last kept event is carried along a sorted piece
        for pdf in batches:
            kept = []
            for n, (ts, last) in enumerate(zip(pdf["_ts"], pdf["_last"])):
                for t in ts:
                    if t - last >= min_gap:
                        last = t
                        kept.append((n, t))
            yield pdf[keys].iloc[[n for n, _ in kept]].assign(t=[t for _, t in kept])

    return pieces.select(*keys, "_ts", entry.cast("bigint").alias("_last")).mapInPandas(fold, schema)


def _chain_entries(pieces: DataFrame, keys: list[str], min_gap: int) -> DataFrame:
    """Last kept event before every later piece of a chain cut into pieces.

    A piece sees its past only through the distance ``d`` from the last kept
    event to its first event, and distances of ``min_gap`` or more are alike;
    so each piece is summarised by its last kept event for every ``d`` and the
    summaries (one small row per piece) are walked in order.
    """
    first = F.element_at("_ts", 1)
    exits = F.transform(
        F.sequence(F.lit(1), F.lit(min_gap)),
        lambda d: F.aggregate("_ts", first - d, lambda acc, t: F.when(t - acc >= min_gap, t).otherwise(acc)),
    )
    several = pieces.groupBy(*keys, "_chain").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    summary = pieces.select(*keys, "_chain", "_piece", first.alias("_first"), exits.alias("_exits")).join(
        several, [*keys, "_chain"], "left_semi"
    )
    schema = ", ".join(f"`{n}` {t}" for n, t in summary.dtypes if n not in ("_first", "_exits")) + ", _entry bigint"

    def walk(pdf):
        pdf = pdf.sort_values("_piece")
        last, entries = None, []
        for t0, table in zip(pdf["_first"], pdf["_exits"]):
            entries.append(last)
            d = min_gap if last is None else min(min_gap, int(t0) - last)
            last = int(table[d - 1])
        out = pdf.drop(columns=["_first", "_exits"])
        out["_entry"] = entries
        out["_entry"] = out["_entry"].astype("Int64")
        return out

    return summary.groupBy(*keys, "_chain").applyInPandas(walk, schema)


def centered_feasible(t: Column, T: Column, W: int) -> Column:
    """Whether a window of ``W`` centred on ``t`` fits the trajectory."""
    left = W // 2
    return (t - left >= 0) & (t + (W - left) <= T)


def nearest_known(df: DataFrame, value: Column, longest: int | None = None, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add the closest earlier and later known value (``_p``, ``_n`` as (t, v) structs)."""
    if longest is None:
        longest = int(df.agg(F.max("t")).first()[0] or 0) + 1
    here = F.when(value.isNotNull(), F.struct("t", value.alias("v")))
    base = df.withColumn("_here", here)
    split = longest > rows
    keys = [*KEYS, "_seg"] if split else KEYS
    if split:
        base = base.withColumn("_seg", F.floor(F.col("t") / rows).cast("bigint"))
        ends = base.groupBy(*keys).agg(F.max("_here").alias("_hi"), F.min("_here").alias("_lo"))
        w = Window.partitionBy(*KEYS).orderBy("_seg")
        ends = ends.select(
            *keys,
            F.last("_hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.first("_lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        )
        base = base.join(ends, keys, "left")
    w = Window.partitionBy(*keys).orderBy("t")
    prev = F.last("_here", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("_here", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = base.withColumns({
        "_p": F.coalesce(prev, F.col("_before")) if split else prev,
        "_n": F.coalesce(nxt, F.col("_after")) if split else nxt,
    })
    return out.drop("_here", "_seg", "_before", "_after")


def fill_unknown(df: DataFrame, z: str = "z", unknown: int = -1, max_gap: int = 5, tie: str = "future",
                 longest: int | None = None) -> DataFrame:
    """Fill unknown labels from the nearest known ones; long inner gaps stay."""
    known = F.when(F.col(z) != unknown, F.col(z))
    df = nearest_known(df, known, longest)
    L, R, t = F.col("_p.t"), F.col("_n.t"), F.col("t")
    mid = F.floor((L + R) / 2)
    from_left = t < mid if tie == "future" else t <= mid
    inner = F.when(R - L - 1 <= max_gap, F.when(from_left, F.col("_p.v")).otherwise(F.col("_n.v"))).otherwise(unknown)
    filled = (
        F.when(known.isNotNull(), F.col(z))
        .when(L.isNull() & R.isNull(), F.lit(unknown))
        .when(L.isNull(), F.col("_n.v"))
        .when(R.isNull(), F.col("_p.v"))
        .otherwise(inner)
    )
    return df.withColumn(z, filled).drop("_p", "_n")


def presence(df: DataFrame, flags: dict[str, Column], W: int, stride: int) -> DataFrame:
    """Number of flagged rows in every complete window."""
    slim = df.select(*KEYS, "t", "frame", *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in flags.items()])
    return window_aggregate(slim, {n: F.sum(n) for n in flags}, W, stride)
