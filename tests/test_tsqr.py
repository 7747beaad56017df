import numpy as np

from varistack.operators import stack, tsqr

from . import oracle
from .test_stack import data, frame


def test_merged_factors_equal_one():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((50, 4)) + 3, rng.standard_normal((50, 2))
    whole = tsqr.Standard(tsqr.Factor.of(x, y))
    for cuts in ([2, 3, 30], [1, 2, 3, 4, 5], [49]):
        parts = [tsqr.Factor.of(a, b) for a, b in zip(np.split(x, cuts), np.split(y, cuts))]
        some = [tsqr.Factor.unpacked(f.packed(), 4, 2) for f in parts]
        merged = tsqr.Standard(tsqr.Factor.merged(some))
        assert merged.n == 50 and np.allclose(merged.r.T @ merged.r, whole.r.T @ whole.r) and np.allclose(merged.rest + (merged.c**2).sum(0), 50)
        assert np.allclose(merged.weights(np.array([1.0]))[0], oracle.ridge(oracle.z(x), oracle.z(y), 1.0))


def test_equals_the_plain_solver(spark):
    xs, y = data(seed=5)
    xs[1][:, 2] = 4.0  # a constant column
    xs[2][3, 0] = np.nan
    y[:, 1] = 2.0
    df = frame(spark, xs, y)
    for make in (stack.cross_val_ridge, stack.penalty_costs):
        plain, svd = (sorted(map(str, ((r[0], r[1], *np.round(np.hstack(r[2:]), 6) + 0.0) for r in make(df, [3, 4, 2], 5, solver=s, target_block=2).collect()))) for s in ("plain", "svd"))
        assert plain == svd
    plain, svd = ({r[:3]: r.weights for r in stack.ridge_path(df, [3, 4, 2], solver=s).collect()} for s in ("plain", "svd"))
    assert all(np.allclose(plain[k], svd[k], atol=1e-8) for k in plain) and plain.keys() == svd.keys()


def test_nearly_collinear_columns(spark):
    """At a correlation of 1 - 1e-9 and a penalty of 1e-6 moments have lost the digits that QR keeps."""
    rng = np.random.default_rng(3)
    n = 20_000
    x = rng.standard_normal((n, 2))
    x[:, 1] = x[:, 0] + np.sqrt(2e-9) * x[:, 1]
    assert 0 < 1 - np.corrcoef(x.T)[0, 1] < 2e-9
    y = ((x[:, 1] - x[:, 0]) / np.sqrt(2e-9) + x[:, 0])[:, None] + 0.1 * rng.standard_normal((n, 1))
    z, t = oracle.z(x), oracle.z(y)
    want = np.linalg.lstsq(np.concatenate([z, 1e-3 * np.eye(2)]), np.concatenate([t, np.zeros((2, 1))]), rcond=None)[0][:, 0]
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(n)], "t long, x array<double>, y array<double>").repartition(5)
    off = {s: np.abs(np.array(stack.ridge_path(df, [2], [1e-6], solver=s).first().weights) / want - 1).max() for s in ("plain", "svd")}
    assert off["svd"] < 1e-11 and off["plain"] > 1e-9, off
