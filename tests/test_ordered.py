"""Hand-computed fixtures, and the sliced plans against the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackflux.functions.ordering import dense_index, in_segments, running_sum
from trackflux.functions.quantiles import exact_quantiles
from trackflux.operators import kinematics as kin, runs, sampling, selection as sel, windows as win

KEYS = ["recording_id", "vehicle_id"]


def track(spark, **cols):
    n = len(next(iter(cols.values())))
    rows = [(1, 1, i, i + 1, *[cols[c][i] for c in cols]) for i in range(n)]
    types = {"lane_id": "int", "z": "int", "on": "boolean"}
    schema = "recording_id bigint, vehicle_id bigint, t bigint, frame bigint, " + ", ".join(
        f"{c} {types.get(c, 'double')}" for c in cols)
    return spark.createDataFrame(rows, schema)


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_debounce(spark):
    ev = spark.createDataFrame([(1, 1, t) for t in (0, 5, 10, 19, 20)], "recording_id bigint, vehicle_id bigint, t bigint")
    assert sorted(r.t for r in runs.debounce(ev, 10, 5).collect()) == [0, 10, 20]


def test_debounce_in_pieces_equals_greedy(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for v in (1, 2):
        ts = sorted(rng.sample(range(120), 70))
        rows += [(1, v, t) for t in ts]
        last = None
        for t in ts:
            if last is None or t - last >= 7:
                want.add((v, t))
                last = t
    ev = spark.createDataFrame(rows, "recording_id bigint, vehicle_id bigint, t bigint")
    got = {(r.vehicle_id, r.t) for r in runs.debounce(ev, 7, None, rows=8).collect()}
    assert got == want


def test_runs_and_lengths(spark):
    df = track(spark, on=[False, True, True, True, False, True, False, True, True])
    assert sorted(r.center for r in runs.mask_runs(df, F.col("on"), 2, 9).collect()) == [2, 7]
    path = track(spark, lane_id=[1, 1, 2, 2, 2, 1])
    assert column(runs.run_lengths(path, "lane_id", 6), "duration", "run") == [2, 3, 1]


@pytest.mark.parametrize("rows", [100, 3])
def test_fill_unknown(spark, rows):
    df = track(spark, z=[-1, -1, 3, -1, -1, -1, 4, -1])
    known = runs.nearest_known(df, F.when(F.col("z") != -1, F.col("z")), 8, rows)
    assert column(known, "_p")[-1].t == 6 and column(known, "_n")[0].t == 2
    assert column(runs.fill_unknown(df, longest=8), "z") == [3, 3, 3, 3, 4, 4, 4, 4]
    far = track(spark, z=[1] + [-1] * 6 + [2])
    assert column(runs.fill_unknown(far, longest=8), "z") == [1] + [-1] * 6 + [2]


def test_lane_change(spark):
    df = track(spark, lane_id=[2, 2, 3, None, 3, 2]).withColumn("dir_sign", F.lit(-1))
    assert column(kin.lane_change(df, 6), "lc") == [0, 0, -1, 0, 0, 1]


def test_windows_small(spark):
    df = track(spark, x=[None, 1.0, None, 3.0])
    out = win.window_aggregate(df, {"s": win.slope(F.col("x")), "last": win.last(F.col("x"))}, 4, 1).first()
    assert out.s == pytest.approx(1.0) and out.last == 3.0
    p = win.window_aggregate(track(spark, x=[0.0, 1.0, 2.0, 3.0]), {"p": win.p95(F.col("x"))}, 4, 1).first().p
    assert p == pytest.approx(2.85)
    long = track(spark, x=[float(i) for i in range(70)])
    assert sorted(r.window_idx for r in win.window_starts(long, 50, 10).collect()) == [0, 1, 2]
    apart = win.window_starts(long, 5, 20)
    assert sorted(r.start_frame for r in apart.collect()) == [1, 21, 41, 61]


def test_codec_and_feasible(spark):
    r = spark.range(1).select(
        sel.sa_to_z(F.lit(1), F.lit(3)).alias("z"), *[c.alias(n) for n, c in zip("sa", sel.z_to_sa(F.lit(-1)))],
        *[runs.centered_feasible(F.lit(t), F.lit(70), 50).alias(f"c{t}") for t in (24, 25, 45, 46)],
    ).first()
    assert (r.z, r.s, r.a) == (7, -1, -1)
    assert (r.c24, r.c25, r.c45, r.c46) == (False, True, True, False)


def skewed(spark):
    """One trajectory holds most rows."""
    rng = np.random.default_rng(3)
    sizes = {1: 180, 2: 7, 3: 1}
    rows = [(1, v, int(o), float(rng.normal())) for v, n in sizes.items() for o in rng.choice(10_000, n, replace=False)]
    return spark.createDataFrame(rows, "recording_id bigint, vehicle_id bigint, o bigint, x double")


def test_sliced_index_and_segments_equal_plain(spark):
    df = skewed(spark)
    plain = dense_index(df, F.col("o"), longest=200)
    cut = dense_index(df, F.col("o"), longest=200, rows_per_slice=16)
    key = [*KEYS, "o"]
    assert {tuple(r) for r in plain.select(*key, "t").collect()} == {tuple(r) for r in cut.select(*key, "t").collect()}
    steps = lambda w: [{"p": F.lag("x", 2).over(w), "n": F.lead("x").over(w)}]
    a = in_segments(plain, steps, before=2, after=1, longest=200)
    b = in_segments(plain, steps, before=2, after=1, longest=200, rows=8)
    assert {tuple(r) for r in a.select(*key, "p", "n").collect()} == {tuple(r) for r in b.select(*key, "p", "n").collect()}
    s1 = running_sum(plain, F.lit(1), "c", longest=200)
    s2 = running_sum(plain, F.lit(1), "c", longest=200, rows=8)
    assert {tuple(r) for r in s1.select(*key, "c").collect()} == {tuple(r) for r in s2.select(*key, "c").collect()}


@pytest.mark.parametrize("case", ["nulls", "outlier", "crowd", "ties"])
def test_slices_follow_rows_not_width(spark, case):
    rng = np.random.default_rng(9)
    o = {
        "nulls": [None] * 40 + rng.permutation(200).tolist(),
        "outlier": [*rng.permutation(400).tolist(), 10**12],
        "crowd": [*range(0, 10**9, 10**7), *rng.permutation(300).tolist()],
        "ties": [5] * 60 + rng.permutation(100).tolist(),
    }[case]
    rows = [(1, 1, None if x is None else float(x), k) for k, x in enumerate(o)] + [(1, 2, float(k), k) for k in range(3)]
    df = spark.createDataFrame(rows, "recording_id bigint, vehicle_id bigint, o double, k bigint")
    plain = dense_index(df, F.col("o"), ["k"], longest=500)
    cut = dense_index(df, F.col("o"), ["k"], longest=500, rows_per_slice=16)
    assert {(r.vehicle_id, r.k): r.t for r in plain.collect()} == {(r.vehicle_id, r.k): r.t for r in cut.collect()}


def test_quantiles_of_large_groups_equal_small(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), 1e6 * rng.normal(size=20)])
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [(None, 1.0), (None, 2.0)], "g string, x double")
    probs = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    small = {r.g: r for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    big = {r.g: r for r in exact_quantiles(df, ["g"], "x", probs, row_limit=40).collect()}
    for g in small:
        for n, p in probs.items():
            assert big[g][n] == pytest.approx(small[g][n], rel=1e-12)
    assert small["a"].p50 == pytest.approx(np.quantile(vals, 0.5))


def test_split_sizes_and_disjoint(spark):
    keys = spark.range(103).select((F.col("id") % 5).alias("recording_id"), F.col("id").alias("vehicle_id"))
    split = sampling.split_assign(keys, 0.7, 0.1, 123)
    n = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert n == {"train": 72, "val": 10, "test": 21}
    assert sampling.split_overlap(split).isEmpty()
    with pytest.raises(ValueError):
        sampling.split_assign(keys, 0.8, 0.3, 1)


def test_answers_are_shuffled_before_they_become_columns(spark):
    from trackflux.operators import context

    rows = [(1, 7, v, float(v), 1.0, 2.0, 0.5, 1, 1, v + 1, None) for v in (1, 2)] + [(1, 7, 3, 3.0, 1.0, 2.0, 0.5, 1, 1, 0, 1)]
    df = spark.createDataFrame(rows, "recording_id bigint, frame bigint, vehicle_id bigint, x_center double, y_center double, vx double, vy double, "
                                     "lane_id int, dir_sign int, preceding_id bigint, following_id bigint")
    out = context.neighbor_context(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan[plan.index("Aggregate"):]
    got = {r.vehicle_id: (r.front_exists, r.front_dx, r.rear_exists, r.rear_dx) for r in out.collect()}
    assert got == {1: (1, 1.0, 0, None), 2: (1, 1.0, 0, None), 3: (0, None, 1, -2.0)}
