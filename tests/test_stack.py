import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression

from varistack.operators import concat, moments, predict, qp, stack, varpart
from varistack.operators.moments import Moments, first_bounds, last_bounds, segment_starts
from varistack.operators.ridge import solve

from . import oracle

SCHEMA = "t long, x array<double>, y array<double>"


def data(n=97, dims=(3, 4, 2), v=3, seed=0):
    rng = np.random.default_rng(seed)
    xs = [rng.standard_normal((n, d)) * 2 + 30 for d in dims]
    y = sum(a * (x @ rng.standard_normal((x.shape[1], v))) for a, x in zip((0.6, 0.3, 0.1), xs)) + rng.standard_normal((n, v))
    return xs, y


def frame(spark, xs, y):
    x = np.concatenate(xs, axis=1)
    rows = [(i, x[i].tolist(), y[i].tolist()) for i in range(len(y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def check(spark, xs, y, folds=4, tol=1e-6, weight_tol=2e-3):
    dims = [x.shape[1] for x in xs]
    stats = stack.fold_stats(frame(spark, xs, y), dims, folds).cache()
    each, pooled, train_each, train, weights = oracle.stack_cv(xs, y, folds)
    for r in stack.space_scores(stats, len(xs)).collect():
        assert abs(r.r2 - each[r.space_id, r.target_id]) < tol
        assert abs(r.r2_train - train_each[r.space_id, r.target_id]) < tol
        assert abs(r.weight - weights[r.target_id, r.space_id]) < weight_tol
    for r in stack.target_scores(stats, len(xs)).collect():
        assert abs(r.stacked_r2 - pooled[r.target_id]) < weight_tol and abs(r.stacked_train_r2 - train[r.target_id]) < 1e-4


def test_stack_cv_matches_rows(spark):
    check(spark, *data())


def test_constant_and_nan_columns(spark):
    xs, y = data(seed=1)
    xs[1][:, 2] = 0.1
    xs[2][:25, 0] = 7.0
    check(spark, xs, y)
    xs[0][3, 1] = np.nan
    y[:, 2] = 5.0
    check(spark, xs, y)


def test_concat_is_one_wide_space(spark):
    xs, y = data(seed=2)
    wide = [np.concatenate(xs, axis=1)]
    each, *_ = oracle.stack_cv(wide, y, 4)
    got = {r.target_id: r.concat_r2 for r in concat.concat_cv(frame(spark, xs, y), [3, 4, 2], 4).collect()}
    assert all(abs(got[t] - each[0, t]) < 1e-6 for t in got)


def test_target_blocks_change_nothing(spark):
    xs, y = data()
    df = frame(spark, xs, y)
    whole, cut = (sorted(map(tuple, stack.target_scores(stack.fold_stats(df, [3, 4, 2], 4, target_block=b), 3).collect())) for b in (10, 2))
    assert np.allclose(whole, cut, atol=1e-9)


@pytest.mark.parametrize("solver", ["plain", "svd", "ridge_sk"])
def test_costs_of_columns_as_they_are(spark, solver):
    xs, y = data(seed=8)
    got = {(r.space_id, r.target_id, r.i): r.cost for r in stack.penalty_costs(frame(spark, xs, y), [3, 4, 2], 5, [0.5, 20.0], solver=solver, standardize=False, target_block=2).collect()}
    fold = oracle.first_folds(len(y), 5)
    for s, x in enumerate(xs):
        for i, lam in enumerate((0.5, 20.0)):
            want = 0.0
            for k in range(5):
                a, b = x[fold != k], y[fold != k]
                w = oracle.ridge(a - a.mean(0), b - b.mean(0), lam) if solver == "ridge_sk" else oracle.ridge(a, b, lam)
                want = want + 1 - oracle.r2(x[fold == k] @ w, y[fold == k])
            assert np.allclose([got[s, t, i] for t in range(3)], want, rtol=1e-6)


@pytest.mark.parametrize("lanes", [1, 2, 8])
def test_lanes_change_nothing(spark, monkeypatch, lanes):
    """A task for a fold, or lanes of target blocks past shared eigenvectors: the same stats, penalties and weights."""
    xs, y = data(v=5)
    xs[1][:25, 2] = 1.5
    df = frame(spark, xs, y)
    want = stack.fit_folds(df, [3, 4, 2], 4)
    monkeypatch.setattr(stack, "FOLD_BYTES", 0)
    monkeypatch.setattr(stack, "LANES", lanes)
    got = stack.fit_folds(df, [3, 4, 2], 4, target_block=2)
    flat = lambda fitted: {r[:2]: np.hstack(r[2:]) for r in fitted.stats.collect()}
    one, two = flat(want), flat(got)
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-9) for k in one)
    listed = lambda fitted: sorted((r.outer_fold, r.space, r.block, tuple(r.penalty)) for r in fitted.fits.collect())
    assert [x[3] for x in listed(want)] == [sum((x[3] for x in listed(got) if x[:2] == key), ()) for key in sorted({x[:2] for x in listed(got)})]


def test_fit_predict_matches_rows(spark):
    xs, y = data(seed=3)
    x = xs[1]
    fold, pred = oracle.last_folds(len(x), 10), np.zeros_like(y)
    for k in range(10):
        pred[fold == k] = oracle.z(x[fold == k]) @ oracle.cv_ridge(oracle.z(x[fold != k]), oracle.z(y[fold != k]), 10)
    for r in stack.fit_predict(frame(spark, [x], y), 4, 10).collect():
        assert abs(r.corr - np.corrcoef(pred[:, r.target_id], y[:, r.target_id])[0, 1]) < 1e-8
        assert abs(r.r2 - oracle.r2(pred[:, r.target_id], y[:, r.target_id])) < 1e-8


def test_bad_input(spark):
    xs, y = data(n=20)
    df = frame(spark, xs, y)
    with pytest.raises(ValueError):
        stack.fold_stats(df.where("t > 2"), [3, 4, 2], 4)
    with pytest.raises(ValueError):
        stack.fold_stats(df.where("t < 3"), [3, 4, 2], 5)
    with pytest.raises(ValueError):
        stack.fold_stats(df, [3, 4, 2], 4, method="other")


def test_ridge_agrees_with_mllib(spark):
    xs, y = data(n=80)
    x, t = oracle.z(xs[1]), oracle.z(y[:, :1])[:, 0]
    side = Moments.of(x, t[:, None]).select(np.ones(1, bool))
    mine = solve(side, np.arange(4), np.array([10.0]))[0][:, 0]
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, t)], ["label", "features"])
    fitted = LinearRegression(fitIntercept=False, standardization=False, elasticNetParam=0.0, solver="normal", regParam=10.0 / 80).fit(df)
    assert np.allclose(mine, fitted.coefficients.toArray(), atol=1e-9)


def test_weights_penalties_and_costs(spark):
    xs, y = data(seed=5)
    df = frame(spark, xs, y)
    got = {(r.space_id, r.target_id): r for r in stack.cross_val_ridge(df, [3, 4, 2], 5, target_block=2).collect()}
    assert len(got) == 9
    costs = stack.penalty_costs(df, [3, 4, 2], 5, target_block=2).toPandas()
    for s, x in enumerate(xs):
        want = oracle.cv_ridge(oracle.z(x), oracle.z(y), 5)
        for t in range(3):
            assert np.allclose(got[s, t].weights, want[:, t], atol=1e-8)
            own = costs[(costs.space_id == s) & (costs.target_id == t)].sort_values("i")
            assert got[s, t].penalty == own.penalty.iloc[own.cost.argmin()]
    for solver in ("plain", "svd", "ridge_sk"):
        raw = stack.cross_val_ridge(df, [3, 4, 2], 5, [2.0], solver, standardize=False).where("space_id = 1").orderBy("target_id").collect()
        x, t = (xs[1], y) if solver != "ridge_sk" else (xs[1] - xs[1].mean(0), y - y.mean(0))
        assert np.allclose(np.array([r.weights for r in raw]).T, oracle.ridge(x, t, 2.0), atol=1e-7)
    with pytest.raises(ValueError):
        stack.cross_val_ridge(df, [3, 4, 2], solver="other")
    with pytest.raises(ValueError):
        stack.fit_folds(df, [3, 4, 2], penalties=[-1.0])


def test_predictions_of_rows(spark, monkeypatch):
    """Out-of-fold and test predictions of each row, in several passes and blocks, with a constant column."""
    xs, y = data(seed=6)
    xs[1][:, 1] = 4.0
    fitted = stack.fit_folds(frame(spark, xs, y), [3, 4, 2], 4, target_block=2)
    monkeypatch.setattr(predict, "PASS_BYTES", 600)
    test = {(r.t, r.space_id, r.target_id): (r.pred, r.real) for r in predict.long_predictions(fitted).collect()}
    train = {(r.outer_fold, r.t, r.space_id, r.target_id): (r.pred, r.real) for r in predict.long_predictions(fitted, train=True).collect()}
    assert len(test) == 97 * 9 and len(train) == 3 * 97 * 9
    fold, real = oracle.last_folds(97, 4), oracle.z(y)
    for k in range(4):
        tr, te = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        ytr = oracle.z(y[tr])
        for s, x in enumerate(xs):
            inner, outer = oracle.space_fit(oracle.z(x[tr]), ytr, oracle.z(x[te]))
            assert np.allclose([[train[k, t, s, v] for v in range(3)] for t in tr.tolist()], np.stack([inner, ytr], -1), atol=1e-7)
            assert np.allclose([[test[t, s, v] for v in range(3)] for t in te.tolist()], np.stack([outer, real[te]], -1), atol=1e-7)
    scores = stack.space_scores(fitted.stats, 3).collect()
    by_rows = {(r.space_id, r.target_id): r.score for r in predict.scored(fitted).collect()}
    assert all(abs(by_rows[r.space_id, r.target_id] - r.r2) < 1e-8 for r in scores)
    stacked = {r.target_id: r.stacked_r2 for r in stack.target_scores(fitted.stats, 3).collect()}
    assert all(abs(by_rows[None, t] - r) < 1e-8 for t, r in stacked.items())


def test_many_partitions_and_wide_spaces(spark, monkeypatch):
    """Sums of more tasks than one merge takes, and rows dealt by ranges, give the same moments."""
    xs, y = data(n=300, seed=7)
    want = sorted(map(tuple, stack.target_scores(stack.fold_stats(frame(spark, xs, y), [3, 4, 2], 4), 3).collect()))
    monkeypatch.setattr(moments, "FAN", 3)
    many = sorted(map(tuple, stack.target_scores(stack.fold_stats(frame(spark, xs, y).repartition(11), [3, 4, 2], 4), 3).collect()))
    monkeypatch.setattr(moments, "HELD_BYTES", 100)
    dealt = sorted(map(tuple, stack.target_scores(stack.fold_stats(frame(spark, xs, y), [3, 4, 2], 4), 3).collect()))
    assert np.allclose(want, many, atol=1e-9) and np.allclose(want, dealt, atol=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_simplex_weights(f, seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((2, f, f + 1))
    p = a @ np.swapaxes(a, 1, 2)
    w = qp.simplex_weights(p)
    assert (w >= 0).all() and np.allclose(w.sum(1), 1)
    for q, own in zip(p, w):
        value = own @ q @ own
        assert all(value <= q[i, i] + 1e-9 for i in range(f))
        other = rng.dirichlet(np.ones(f), 50)
        assert (np.einsum("ni,ij,nj->n", other, q, other) >= value - 1e-9).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(30, 120), st.integers(2, 5), st.integers(0, 4))
def test_segments_hold_every_split(n, k, o):
    """Each fold and split of the nested scheme is a union of segments."""
    outer = last_bounds(n, k)
    starts = segment_starts(n, outer, 5, 5)
    seg = np.searchsorted(starts, np.arange(n), "right") - 1

    def whole(t, labels):
        assert all(len(set(labels[seg[t] == s])) == 1 for s in np.unique(seg[t]))

    t = np.arange(n)
    whole(t, oracle.last_folds(n, k))
    tr = t[oracle.last_folds(n, k) != min(o, k - 1)]
    whole(tr, oracle.first_folds(len(tr), 5))
    inner = oracle.last_folds(len(tr), 5)
    whole(tr, inner)
    rest = tr[inner != 2]
    whole(rest, oracle.first_folds(len(rest), 5))
    assert first_bounds(n, k)[-1] == n


def test_chains_share_the_fits(spark):
    xs, y = data(seed=4)
    stats = stack.fold_stats(frame(spark, xs, y), [3, 4, 2], 4).cache()
    chain = varpart.chain(stats, 3, "forward")
    vp = varpart.unique_variance(chain, "target_id", "direction").toPandas()
    full = {r.target_id: r.stacked_r2 for r in stack.target_scores(stats, 3).collect()}
    for t, own in vp.groupby("target_id"):
        assert abs(own.vp.sum() - full[t]) < 1e-9
    each, *_ = oracle.stack_cv([xs[2]], y, 4)
    last = chain.where("step = 2").collect()
    assert all(abs(r.r2 - each[0, r.target_id]) < 1e-6 for r in last)


@pytest.mark.parametrize(
    ("r2", "forward", "backward"),
    [
        ([0.0, 1, 1, 1, 1, 1, 1], None, None),
        ([1, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9], 1, 7),
        ([1, 0.99, 0.98, 0.97, 0.96, 0.95, 0.9], 6, 2),
        ([1, 1, 1, 1, 1, 1, 0.96], 7, 1),
        ([float("nan"), 0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 7, 1),
        ([1, float("nan"), 0.9, 0.9, 0.9, 0.9, 0.9], 2, 6),
    ],
)
def test_attribution(spark, r2, forward, backward):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(r2)], "target_id int, step int, r2 double")
    for back, want in ((False, forward), (True, backward)):
        got = varpart.attribution(df, "target_id", backward=back).first().layer
        assert np.isnan(got) if want is None else got == want
