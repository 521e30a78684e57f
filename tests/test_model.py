"""Recursions against brute force, in one block and in many."""

import itertools

import numpy as np
import pytest

from trackflux.latent import em, recursion as R, starts
from trackflux.latent.params import from_long, patterned, to_long

P = patterned()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(1, v, t, [float(x) for x in rng.normal(scale=3, size=P.K)]) for v, n in ((1, 23), (2, 3), (3, 1)) for t in range(n)]
    return spark.createDataFrame(data, "recording_id bigint, vehicle_id bigint, t bigint, logb array<double>")


def brute(rows, vehicle):
    lb = [r.logb for r in sorted(rows.where(f"vehicle_id = {vehicle}").collect(), key=lambda r: r.t)]
    paths, scores = [], []
    start, M = np.log(P.start("add")), np.log(P.kernel("add"))
    for path in itertools.product(range(P.K), repeat=len(lb)):
        s = start[path[0]] + lb[0][path[0]]
        for i in range(1, len(lb)):
            s += M[path[i - 1], path[i]] + lb[i][path[i]]
        paths.append(path)
        scores.append(s)
    return np.array(paths), np.array(scores)


def collect(df, name):
    return {(r.vehicle_id, r.t): r[name] for r in df.collect()}


def test_smooth_and_best_path_match_enumeration(rows):
    paths, scores = brute(rows, 2)
    w = np.exp(scores - scores.max())
    w /= w.sum()
    gamma = collect(R.smooth(rows, P.start("add"), P.kernel("add")), "gamma")
    for t in range(3):
        want = [w[paths[:, t] == z].sum() for z in range(P.K)]
        assert np.allclose(gamma[(2, t)], want, atol=1e-10)
    z = collect(R.best_path(rows, P.start("add"), P.kernel("add")), "z")
    assert [z[(2, t)] for t in range(3)] == list(paths[scores.argmax()])
    ll = collect(R.smooth(rows, P.start("add"), P.kernel("add")), "ll")
    assert sum(ll[(2, t)] for t in range(3)) == pytest.approx(np.logaddexp.reduce(scores))


def test_blocks_equal_one_block(rows):
    args = (rows, P.start("add"), P.kernel("add"))
    for job, col in ((R.smooth, "gamma"), (R.forward_filter, "post"), (R.best_path, "z")):
        one, many = collect(job(*args), col), collect(job(*args, block=3, fan=2), col)
        assert one.keys() == many.keys()
        for k in one:
            assert np.allclose(one[k], many[k], atol=1e-9)


def path_score(path, lb, start, M):
    return start[path[0]] + lb[0][path[0]] + sum(M[a, b] + x[b] for a, b, x in zip(path, path[1:], lb[1:]))


@pytest.mark.parametrize("block,fan", [(256, 256), (2, 256), (2, 2), (3, 2)])
def test_tied_best_path_is_a_path(spark, block, fan):
    start, M = np.array([0.5, 0.5]), np.array([[0.1, 0.9], [0.9, 0.1]])
    data = [(1, v, t, [0.0, 0.0]) for v, n in ((1, 4), (2, 9), (3, 1), (4, 2)) for t in range(n)]
    df = spark.createDataFrame(data, "recording_id bigint, vehicle_id bigint, t bigint, logb array<double>")
    z = collect(R.best_path(df, start, M, block=block, fan=fan), "z")
    for v, n in ((1, 4), (2, 9), (3, 1), (4, 2)):
        path = [z[(v, t)] for t in range(n)]
        assert all(a != b for a, b in zip(path, path[1:]))


def test_best_path_of_a_long_trajectory_is_optimal(rows):
    lb = [r.logb for r in sorted(rows.where("vehicle_id = 1").collect(), key=lambda r: r.t)]
    start, M = np.log(P.start("add")), np.log(P.kernel("add"))
    v = start + lb[0]
    for x in lb[1:]:
        v = (v[:, None] + M).max(axis=0) + x
    for block, fan in ((256, 256), (3, 2)):
        z = collect(R.best_path(rows, P.start("add"), P.kernel("add"), block=block, fan=fan), "z")
        assert path_score([z[(1, t)] for t in range(23)], lb, start, M) == pytest.approx(v.max())


@pytest.mark.parametrize("wrong", [float("inf"), float("-inf"), float("nan")])
def test_a_bad_trajectory_is_left_out_whole_in_any_block_size(spark, rows, wrong):
    data = [(r.recording_id, r.vehicle_id, r.t, [wrong, *r.logb[1:]] if (r.vehicle_id, r.t) == (1, 10) else r.logb) for r in rows.collect()]
    bad = spark.createDataFrame(data, rows.schema)
    args = (P.start("add"), P.kernel("add"))
    for job, col in ((R.smooth, "gamma"), (R.forward_filter, "ll"), (R.best_path, "z")):
        want = {k: v for k, v in collect(job(rows, *args), col).items() if k[0] != 1}
        for sizes in ({}, {"block": 3, "fan": 2}, {"block": 3}):
            got = collect(job(bad, *args, **sizes), col)
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def observed(spark, spoil=False):
    from trackflux.latent.emission import scaled

    rng = np.random.default_rng(4)
    cols = [scaled(c) for c in P.continuous]
    data = []
    for v, n in ((1, 12), (2, 5), (3, 1), (4, 30)):
        state = rng.integers(0, 3)
        for t in range(n):
            x = [float(z) for z in rng.normal(loc=2.0 * state - 2, size=len(cols))]
            if spoil and (v, t) == (1, 6):
                x[0] = 1e200
            data.append((1, v, t, *x, *[float(rng.random() < 0.3) for _ in P.binary]))
            state = state if rng.random() < 0.8 else rng.integers(0, 3)
    schema = "recording_id bigint, vehicle_id bigint, t bigint, " + ", ".join(f"{c} double" for c in [*cols, *P.binary])
    return spark.createDataFrame(data, schema)


def test_statistics_with_a_bad_window_do_not_depend_on_blocks(spark):
    good, bad = observed(spark).where("vehicle_id <> 1"), observed(spark, spoil=True)
    want = em.read_stats(em.e_step_table(good, P, 30), P)
    for block in (256, 3):
        got = em.read_stats(em.e_step_table(bad, P, 30, block=block), P)
        assert float(got.n_bad) == 1 and float(got.n_sequences) == 3 and float(got.n_rows) == 36
        for name in ("loglik", "mass", "xi_s", "xi_a", "sum_x2", "flag_on"):
            assert np.allclose(getattr(got, name), getattr(want, name))
        ll, n = em.total_loglik(bad, P, 30, block=block)
        assert n == 36 and ll == pytest.approx(float(want.loglik))


def test_fit_does_not_lose_likelihood_and_stops(spark, tmp_path):
    obs = observed(spark)
    done = em.fit(obs, obs, P, 30, max_iter=40, checkpoint_path=str(tmp_path))
    train = [h["train_loglik"] for h in done.history]
    assert len(train) < 40 and train[-1] > train[0]
    assert all(h["val_rows"] == 48 for h in done.history)
    assert np.allclose(done.params.A_s.sum(1), 1, atol=1e-4) and (tmp_path / "final").is_dir()
    if len(train) >= 5:
        assert (tmp_path / "iteration=5").is_dir()


def test_product_model_is_fitted_and_given_back(spark):
    rng = np.random.default_rng(6)
    D, B = len(P.continuous), len(P.binary)
    e = lambda k: {"mean": rng.normal(size=(k, D)), "var": np.ones((k, D)), "bern": np.full((k, B), 0.3)}
    start = e(2), e(4)
    done = em.fit_product(observed(spark), *start, P, 30, max_iter=4)
    assert len(done.history) >= 2 and not np.allclose(done.style["mean"], start[0]["mean"])
    assert done.history[-1]["train_loglik"] > done.history[0]["train_loglik"]


def test_kmeans_starts_find_the_clusters(spark):
    start = starts.kmeans_start(observed(spark), P.continuous, P.binary, 3)
    assert start["mean"].shape == (3, len(P.continuous)) and (start["var"] > 0).all()


def plain_lloyd(x, first, steps=starts.STEPS):
    c = x[first].copy()
    for _ in range(steps):
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


def test_lloyd_is_plain_lloyd_from_the_seeded_rows(spark):
    from pyspark.sql import functions as F

    rows = starts.complete_rows(observed(spark), P.continuous, P.binary, 5)
    got = [r for r in rows.withColumn("h", starts.seed_rank(5, "recording_id", "vehicle_id", "t")).collect()]
    x = np.array([r["x"] for r in got])
    first = sorted(range(len(got)), key=lambda i: got[i]["h"])[:4]
    want = plain_lloyd(x, first)
    for parts in (1, 7):
        assert np.allclose(starts.lloyd(rows.repartition(parts), 4, 5), want, atol=1e-9)
    assert not np.allclose(starts.lloyd(rows, 4, 6), want)
    assert rows.where(F.size("b") != len(P.binary)).isEmpty()


def test_product_starts_use_the_seed_and_the_next_one(spark):
    obs = observed(spark)
    style, action = starts.product_start(obs, P.continuous, P.binary, 2, 4, seed=9)
    assert style["mean"].shape == (2, len(P.continuous)) and action["bern"].shape == (4, len(P.binary))
    rows = starts.complete_rows(obs, P.continuous, P.binary, 9)
    assert starts.cluster_sums(rows, starts.lloyd(rows, 4, 10)).keys() == {0, 1, 2, 3}
    few = starts.product_start(obs.where("vehicle_id = 2"), P.continuous, P.binary, 2, 4)
    assert np.allclose(few[0]["mean"][0], few[0]["mean"][1]) and (few[1]["bern"] == 0.5).all(), "too few rows: overall moments"


@pytest.mark.parametrize("stopped", [7, 5, 3])
def test_a_fit_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch, stopped):
    obs = observed(spark)
    monkeypatch.setattr(em, "STOP_DELTA", -1e9)  # runs to the last iteration
    whole = em.fit(obs, obs, P, 30, max_iter=9)
    em.fit(obs, obs, P, 30, max_iter=stopped, checkpoint_path=str(tmp_path))
    # of the driver that was lost, only what it had written stays
    (tmp_path / "final").rename(tmp_path / "lost")
    again = em.fit(obs, obs, P, 30, max_iter=9, checkpoint_path=str(tmp_path))
    assert [h["iteration"] for h in again.history] == list(range(1, 10))
    assert [h.keys() for h in again.history] == [h.keys() for h in whole.history]
    for a, b in zip(again.history, whole.history):
        assert a == pytest.approx(b, rel=1e-9)
    for name in ("A_s", "A_a", "mean", "var", "bern"):
        assert np.allclose(getattr(again.params, name), getattr(whole.params, name), rtol=1e-9)


def test_a_half_written_checkpoint_is_not_used(spark, tmp_path):
    obs = observed(spark)
    em.save_state(spark, str(tmp_path), 5, P, [{"iteration": k, "train_loglik": 1.0, "train_rows": 48, "val_loglik": 1.0, "val_rows": 48} for k in range(1, 6)])
    (tmp_path / "history" / "5" / "_SUCCESS").rename(tmp_path / "gone")
    assert em.last_state(spark, str(tmp_path), 10) == 0 and em.last_state(spark, None, 10) == 0


def test_a_product_fit_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    obs = observed(spark)
    monkeypatch.setattr(em, "STOP_DELTA", -1e9)
    begin = starts.product_start(obs, P.continuous, P.binary, 2, 4)
    whole = em.fit_product(obs, *begin, P, 30, max_iter=7)
    em.fit_product(obs, *begin, P, 30, max_iter=6, checkpoint_path=str(tmp_path))
    again = em.fit_product(obs, *begin, P, 30, max_iter=7, checkpoint_path=str(tmp_path))
    assert np.allclose(again.style["mean"], whole.style["mean"]) and np.allclose(again.action["bern"], whole.action["bern"])
    assert [h["iteration"] for h in again.history] == list(range(1, 8))


def test_gammas_sum_to_one(rows):
    g = collect(R.smooth(rows, P.start("add"), P.kernel("add")), "gamma")
    assert np.allclose([sum(v) for v in g.values()], 1.0)


def test_params_roundtrip_and_checks(spark):
    table = to_long(spark, P)
    back, _ = from_long(table)
    assert np.allclose(back.A_a, P.A_a) and np.allclose(back.mean, P.mean)
    assert P.count() == 698
    with pytest.raises(ValueError):
        from_long(table.where("param <> 'A_s'"))


def test_product_step_lowers_loss():
    rng = np.random.default_rng(2)
    D, B = 3, 1
    g = rng.dirichlet(np.ones(8), size=200)
    x, f = rng.normal(size=(200, D)), (rng.random((200, B)) > 0.5).astype(float)
    st = em.Stats({"mass": g.sum(0), "sum_w": g.sum(0)[:, None] * np.ones(D), "sum_x": g.T @ x, "sum_x2": g.T @ (x * x),
                   "flag_w": g.sum(0)[:, None] * np.ones(B), "flag_on": g.T @ f})
    e = lambda k: {"mean": rng.normal(size=(k, D)), "var": np.ones((k, D)), "bern": np.full((k, B), 0.3)}
    _, _, history = em.update_product(e(2), e(4), st, lr=0.02)
    assert history[-1] < history[0]


def test_pair_sums_are_those_of_single_steps():
    rng = np.random.default_rng(3)
    n = np.array([5, 2, 4])
    lb = rng.normal(scale=4, size=(3, 5, P.K))
    lb[2, 2] = [0.0, *[-2000.0] * (P.K - 1)]
    for kernel in (P.kernel("add"), np.where(np.eye(P.K) > 0, 0.0, 1 / (P.K - 1))):
        k = R.Kernel(P.start("add"), kernel)

        class b:
            entry = exit = np.zeros((3, P.K))
            start = last = np.array([True, False, True])
            bad = np.array([False, False, False])

        w = rng.random((3, 5))
        gamma, _, xi = R.pair_sums(k, lb, n, b, w)
        _, post, _ = k.forward(lb, n, b.entry, b.start)
        beta, want = k.backward(lb, n, b.exit, b.last), np.zeros((P.K, P.K))
        for i in range(3):
            for t in range(int(b.start[i]), n[i]):
                s = (post[i, t - 1] if t else b.entry[i])[:, None] + k.logM + (lb[i, t] + beta[i, t])[None]
                s = np.exp(s - s.max())
                want += w[i, t] * s / s.sum()
        assert np.allclose(xi, want, rtol=1e-10, atol=1e-12) and np.allclose(gamma[0].sum(1), 1)


def test_packed_bytes_give_the_statistics_of_arrays(spark):
    packed = em.packed_rows(observed(spark), P, 30)
    assert dict(R.as_bytes(packed).dtypes)["x"] == "binary"
    a, b = (em.read_stats(em.e_step_packed(x, P, 30), P) for x in (packed, R.as_bytes(packed)))
    assert all(np.allclose(a.values[k], b.values[k]) for k in a.values) and em.loglik_packed(R.as_bytes(packed), P, 30)[1] == 48


def test_blocks_lie_in_partitions_that_follow_the_row_count(rows):
    many, few = R.pack(rows, 8, 1_000_000), R.pack(rows, 8)
    assert many.rdd.getNumPartitions() == 16
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
