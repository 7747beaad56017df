import numpy as np
import pytest

from varistack.operators import concat, stack, varpart

from . import oracle
from .test_stack import data, frame


def by_rows(x, y, folds, lambdas=None, splits=5):
    """R² of one ridge over outer folds, row by row, in dual form where that is smaller."""

    def ridge(a, b, lam):
        if a.shape[1] > len(a):
            return a.T @ np.linalg.solve(a @ a.T + lam * np.eye(len(a)), b)
        return oracle.ridge(a, b, lam)

    fold, pred, lambdas = oracle.last_folds(len(x), folds), np.zeros_like(y), lambdas or oracle.LAMBDAS
    for k in range(folds):
        xt, yt = oracle.z(x[fold != k]), oracle.z(y[fold != k])
        split, cost = oracle.first_folds(len(xt), splits), np.zeros((len(lambdas), y.shape[1]))
        for c in range(splits):
            a, b, xv, yv = (oracle.z(m) for m in (xt[split != c], yt[split != c], xt[split == c], yt[split == c]))
            for i, lam in enumerate(lambdas):
                cost[i] += 1 - oracle.r2(xv @ ridge(a, b, lam), yv)
        w = np.stack([ridge(xt, yt[:, t], lambdas[b]) for t, b in enumerate(cost.argmin(0))], axis=1)
        pred[fold == k] = oracle.z(x[fold == k]) @ w
    return oracle.r2(pred, oracle.z(y))


def test_chains_match_fits_of_their_own(spark):
    xs, y = data(seed=4)
    df = frame(spark, xs, y)
    got = {(r.direction, r.step, r.target_id): r.r2 for r in concat.concat_chain(df, [3, 4, 2], 4, target_block=2).collect()}
    assert len(got) == 2 * 3 * 3
    for direction in ("forward", "backward"):
        for step in range(3):
            kept = xs[step:] if direction == "forward" else xs[: 3 - step]
            want = by_rows(np.concatenate(kept, axis=1), y, 4)
            assert np.allclose([got[direction, step, t] for t in range(3)], want, atol=1e-8), (direction, step)
    lost = varpart.unique_variance(concat.concat_chain(df, [3, 4, 2], 4, ("forward",)), "target_id", "direction").where("step = 0").collect()
    assert all(abs(r.vp - (got["forward", 0, r.target_id] - got["forward", 1, r.target_id])) < 1e-9 for r in lost)
    with pytest.raises(ValueError, match="direction"):
        concat.concat_chain(df, [3, 4, 2], 4, ("sideways",))
    with pytest.raises(ValueError, match="positive"):
        concat.concat_chain(df, [3, 4, 2], 4, penalties=[0.0])


def test_odd_columns_as_the_stack_has_them(spark):
    xs, y = data(seed=7)
    xs[1][:, 2] = 0.1
    xs[2][:25, 0] = 7.0
    xs[0][3, 1] = np.nan
    y[:, 2] = 5.0
    y[:30, 1] = 1.0
    df = frame(spark, xs, y)
    want = {r.target_id: r.stacked_r2 for r in stack.target_scores(stack.fold_stats(df, [9], 4), 1).collect()}
    got = {r.target_id: r.r2 for r in concat.concat_scores(df, [3, 4, 2], 4, whole_only=True).collect()}
    assert want.keys() == got.keys() and all(abs(got[t] - want[t]) < 1e-8 for t in want)


def peak(spark, forget=False):
    """The most memory, in MB, that any of the Python workers has had, since it was last told to forget it."""

    def run(batches):
        for b in batches:
            if forget:
                with open("/proc/self/clear_refs", "w") as out:
                    out.write("5")
            status = dict(line.split(":", 1) for line in open("/proc/self/status"))
            yield b.assign(id=int(status["VmHWM"].split()[0]) // 1024)

    return spark.range(64, numPartitions=64).mapInPandas(run, "id long").agg({"id": "max"}).first()[0]


def test_two_thousand_columns(spark):
    """As wide as thousands of columns, a task stays under 1 GB."""
    rng = np.random.default_rng(0)
    n, p = 240, 2000
    x = rng.standard_normal((n, p))
    y = x[:, :40] @ rng.standard_normal((40, 3)) + rng.standard_normal((n, 3))
    want = by_rows(x, y, 2, [10.0, 1e3, 1e5])
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(n)], "t long, x array<double>, y array<double>").repartition(4)
    before = peak(spark, forget=True)  # what earlier tests have left
    got = {r.target_id: r.r2 for r in concat.concat_scores(df, [1000, 1000], 2, whole_only=True, penalties=[10.0, 1e3, 1e5]).collect()}
    assert np.allclose([got[t] for t in range(3)], want, atol=1e-8)
    assert peak(spark) < max(1024, before + 512)
