"""Window features from panes against the same features from rows."""

import numpy as np
import pytest

from trackflux.operators import windows as win
from trackflux.schema import KEYS, WINDOW_FEATURES

NAMES = WINDOW_FEATURES + ["vx_mean", "vx_std", "vx_rms", "ax_max", "front_thw_p95", "vx_p95"]


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(8)
    cols = win.feature_inputs(NAMES)
    rows = []
    for v, n in ((1, 90), (2, 7), (3, 31), (4, 1)):
        for t in range(n):
            x = [float(rng.integers(0, 2)) if c.endswith("_exists") else float(rng.integers(-1, 2)) if c == "lc" else None if rng.random() < 0.5 or v == 3 else round(float(rng.normal(scale=50)), 1) for c in cols]
            rows.append((1, v, t, 100 + t, "car", *x))
    schema = "recording_id bigint, vehicle_id bigint, t bigint, frame bigint, meta_class string, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.mark.parametrize("W,stride", [(50, 10), (10, 2), (6, 4), (4, 6), (8, 8), (7, 3), (3, 1), (2, 4)])
def test_panes_give_the_features_of_rows(frames, W, stride):
    got = win.windowize(frames, NAMES, W, stride).orderBy(*KEYS, "window_idx").toPandas()
    exact = {n: win.feature(n) for n in NAMES if n.endswith("_p95")}
    want = win.window_aggregate(frames, {n: win.feature(n) for n in NAMES if n not in exact}, W, stride, ["meta_class"], exact)
    want = want.select(*got.columns).orderBy(*KEYS, "window_idx").toPandas()
    assert len(got) == sum(max(0, 1 + (n - W) // stride) for n in (90, 7, 31, 1))
    assert (got[[*KEYS, "window_idx", "start_frame"]] == want[[*KEYS, "window_idx", "start_frame"]]).all().all()
    np.testing.assert_allclose(got[NAMES].to_numpy(float), want[NAMES].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_quantiles_send_panes_to_windows(frames):
    plan = win._pane_quantiles(frames, ["vx_p95"], 50, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Aggregate" in plan[plan.index("Generate"):], "rows are aggregated before they are copied"


@pytest.mark.parametrize("name", ["vx_median", "lc", "vx_vfrac", "nothing"])
def test_names_without_a_statistic_are_an_error(name):
    with pytest.raises(ValueError):
        win.read_name(name)


@pytest.mark.parametrize("W,stride", [(50, 10), (10, 2)])
def test_rows_are_shuffled_once(frames, W, stride):
    plan = win.windowize(frames, None, W, stride)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("W,stride", [(10, 2), (7, 3), (3, 5)])
def test_short_runs_give_the_same_windows(frames, monkeypatch, W, stride):
    by = [*KEYS, "window_idx"]
    want = win.windowize(frames, NAMES, W, stride).orderBy(*by).toPandas()
    monkeypatch.setattr(win, "RUN_ROWS", 1)
    monkeypatch.setattr(win, "LIST_ROWS", 1)
    got = win.windowize(frames, NAMES, W, stride).select(*want.columns).orderBy(*by).toPandas()
    assert len(got) == len(want) and (got[[*by, "start_frame"]] == want[[*by, "start_frame"]]).all().all()
    np.testing.assert_allclose(got[NAMES].to_numpy(float), want[NAMES].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_a_first_row_that_comes_twice_gives_its_window_twice(spark):
    rows = [(1, 1, t, 10 + t, float(t)) for t in (0, 0, 1, 1)] + [(1, 2, t, 10 + t, float(t)) for t in range(4)] + [(None, 3, t, 10 + t, 0.0) for t in range(4)]
    df = spark.createDataFrame(rows, "recording_id bigint, vehicle_id bigint, t bigint, frame bigint, vx double")
    got = sorted(tuple(r) for r in win.windowize(df, ["vx_last"], 4, 2).collect())
    assert got == [(1, 1, 0, 10, 1.0), (1, 1, 0, 10, 1.0), (1, 2, 0, 10, 3.0)]


@pytest.mark.parametrize("vehicles", [20, 60])
def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch, vehicles):
    monkeypatch.setattr(win, "TASK_ROWS", 64)
    rows = [(1, v, t, t, float(v + t)) for v in range(vehicles) for t in range(30)]
    df = spark.createDataFrame(rows, "recording_id bigint, vehicle_id bigint, t bigint, frame bigint, vx double")
    got = win.windowize(df, ["vx_last", "vx_p95"], 10, 2)
    assert got.rdd.getNumPartitions() == -(-len(rows) // (4 * 64 // 5))
    assert sorted((r.vehicle_id, r.window_idx, r.vx_last) for r in got.collect()) == [(v, w, float(v + 2 * w + 9)) for v in range(vehicles) for w in range(11)]
