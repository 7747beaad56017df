import numpy as np
import pytest
from pyspark.sql import functions as F

from varistack.functions import expressions as E
from varistack.functions.scores import R2, Correlation, MeanAbsoluteError
from varistack.operators import predict, stack

from .test_stack import data, frame


@pytest.mark.parametrize("score", [R2(), Correlation(), MeanAbsoluteError()])
def test_scores_merge(score):
    rng = np.random.default_rng(0)
    pred, real = rng.standard_normal((60, 4)) + 1e4, rng.standard_normal((60, 4)) + 1e4
    pred[:, 1], real[:, 2] = 3.0, 1e4
    pred[:, 3] = real[:, 3]
    whole = score.finish(score.update(score.init(4), pred, real))
    for cuts in ([1, 2, 30], [59], [20, 20, 40]):
        total = score.init(4)
        for a, b in zip(np.split(pred, cuts), np.split(real, cuts)):
            total = score.merge(score.update(score.init(4), a, b), total)
        assert np.allclose(score.finish(total), whole, equal_nan=True)
    if isinstance(score, R2):
        assert np.isclose(whole[0], 1 - ((real - pred) ** 2).mean(0)[0] / real.var(0)[0]) and whole[2] == -E.LARGEST and np.isclose(whole[3], 1)
    if isinstance(score, Correlation):
        assert np.isclose(whole[0], np.corrcoef(pred[:, 0], real[:, 0])[0, 1]) and np.isnan(whole[1]) and np.isnan(whole[2])


@pytest.fixture(scope="module")
def fitted(spark):
    xs, y = data(seed=6)
    xs[1][:, 1] = 4.0
    return stack.fit_folds(frame(spark, xs, y), [3, 4, 2], 4, target_block=2)


def test_stacked_predictions_have_no_exchange(spark, fitted):
    rows = predict.stacked_predictions(fitted)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(rows) == exchanges(fitted.design)
    w = stack.weighted(fitted.stats, 3).select("outer_fold", "target_id", F.posexplode("w").alias("space_id", "w"))
    for train in (False, True):
        each = predict.long_predictions(fitted, train).join(w, ["outer_fold", "target_id", "space_id"])
        want = {(r.t, r.outer_fold, r.target_id): r.p for r in each.groupBy("t", "outer_fold", "target_id").agg(F.sum(F.col("pred") * F.col("w")).alias("p")).collect()}
        got = {(r.t, r.outer_fold, r.target_id): r.pred for r in predict.stacked_predictions(fitted, train).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_scores_equal_moments_and_rows(spark, fitted, monkeypatch):
    one = {(r.target_id, r.space_id): r for r in predict.scored(fitted).collect()}
    monkeypatch.setattr(predict, "PASS_BYTES", 400)
    many = {(r.target_id, r.space_id): r for r in predict.scored(fitted).collect()}
    assert one.keys() == many.keys() and all(np.allclose(one[k][2:], many[k][2:]) for k in one)
    for r in stack.space_scores(fitted.stats, 3).collect():
        assert np.allclose(one[r.target_id, r.space_id][2:], (r.r2, r.r2_weighted, r.r2_train), atol=1e-8)
    for r in stack.target_scores(fitted.stats, 3).collect():
        assert np.allclose(one[r.target_id, None][2:], (r.stacked_r2, r.stacked_r2, r.stacked_train_r2), atol=1e-8)
    by_corr = {(r.target_id, r.space_id): r.score for r in predict.scored(fitted, Correlation()).collect()}
    rows = predict.long_predictions(fitted).groupBy("target_id", "space_id").agg(E.corr(F.col("pred"), F.col("real")).alias("c")).collect()
    assert all(abs(by_corr[r.target_id, r.space_id] - r.c) < 1e-9 for r in rows)
