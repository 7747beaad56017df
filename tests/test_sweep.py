import numpy as np
from pyspark.sql import functions as F

from varistack.jobs import sweep
from varistack.operators import simulate
from varistack.operators.moments import Moments, last_bounds, segment_starts
from varistack.operators.stack import Fold, fold_matrices, space_columns

RUNS = [(s, 0.1 * (s % 3), [0.7, 0.3], 0.5 * (s % 4)) for s in range(12)]


def test_runs_of_one_shape_share_their_decompositions(monkeypatch):
    calls, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda a: calls.append(1) or eigh(a))
    want = [simulate.run_one(s, 40, [3, 3], 0.5, c, a, 2, e) for s, c, a, e in RUNS]
    alone = len(calls)
    got = simulate.run_many(RUNS, 40, [3, 3], 0.5, 2)
    assert len(calls) - alone < 2 * alone / len(RUNS)
    for i, own in enumerate(want):
        assert all(np.allclose(got[name][i], own[name], atol=1e-9) for name in simulate.METRICS)


def test_draws_are_those_of_the_generator():
    cov = simulate.toeplitz_cov(7, 0.5)
    want = np.random.RandomState(3).multivariate_normal(np.zeros(7), cov, 5)
    assert np.array_equal(simulate._normal(np.random.RandomState(3), 7, 0.5, 5), want)


def test_tables_fitted_at_once_with_dead_columns_and_targets():
    """A constant, an infinite and a partly constant column, and a constant target, each in one of four tables."""
    rng, n, dims = np.random.default_rng(1), 60, [3, 2]
    x, y = rng.standard_normal((4, n, 5)), rng.standard_normal((4, n, 2))
    x[1, :, 0], x[2, 3, 4], x[3, :30, 1], y[1, :, 1] = 2.0, np.inf, 1.0, 5.0
    outer = last_bounds(n, 4)
    starts = segment_starts(n, outer, 5, 5)
    cuts = list(zip(starts, [*starts[1:], n]))

    def moments(r):
        each = [Moments.of(x[r, a:b], y[r, a:b]) for a, b in cuts]
        return {name: np.concatenate([getattr(own, name) for own in each]) for name in ("n", "s", "xx", "xy", "yy", "low", "high")}

    one = [moments(r) for r in range(4)]
    together = Moments(one[0]["n"], *(np.stack([m[name] for m in one], axis=1) for name in ("s", "xx", "xy", "yy", "low", "high")), 5)
    for a, b in zip(outer[:-1], outer[1:]):
        fold = Fold(starts, int(a), int(b), n, 5, 5)
        got = fold_matrices(together, fold, space_columns(dims), "cross_val_ridge", 5, "global")
        for r in range(4):
            want = fold_matrices(Moments(**one[r], p=5), fold, space_columns(dims), "cross_val_ridge", 5, "global")
            assert all(np.allclose(g[r], w, atol=1e-9, equal_nan=True) for g, w in zip(got[1:], want[1:]))


def test_tasks_of_several_shapes_meet(spark):
    rows = [(i, 40 if i % 3 else 30, [2, 2] if i % 2 else [3], [0.6, 0.4] if i % 2 else [1.0], 0.5, 0.1) for i in range(10)]
    tasks = spark.createDataFrame(rows, "global_index long, n int, ds array<int>, alpha array<double>, noise double, correl double")
    got = {(r.global_index, r.target_id): r for r in sweep.run_tasks(tasks.where(F.size("ds") == 2), parts=1).collect()}
    assert sorted(got) == [(i, t) for i in range(1, 10, 2) for t in range(2)]
    for i, n, ds, alpha, noise, correl in rows[1::2]:
        want = simulate.run_one(i, n, ds, 0.5, correl, alpha, 2, noise)
        assert all(abs(got[i, t][name] - want[name][t]) < 1e-9 for t in range(2) for name in simulate.METRICS)
