"""Scores of predictions as mergeable aggregates over arrays: one state per target, rows in any order.

A score is an object with four methods. ``init(width)`` gives the state of no rows, an array (k, width);
``update(state, pred, real)`` takes rows (n, width) in; ``merge(a, b)`` joins two states; ``finish(state)``
gives the targets' scores. States must be arrays of doubles, and the object must pickle.
"""

from __future__ import annotations

import numpy as np

from varistack.functions.expressions import LARGEST


class _Joint:
    """Counts, means, squared deviations and the joint one of predictions and truths, merged without cancellation."""

    def init(self, width: int) -> np.ndarray:
        return np.zeros((6, width))

    def update(self, state: np.ndarray, pred: np.ndarray, real: np.ndarray) -> np.ndarray:
        if not len(pred):
            return state
        p, r = pred.mean(axis=0), real.mean(axis=0)
        a, b = pred - p, real - r
        own = np.stack([np.full(len(p), float(len(pred))), p, r, (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)])
        return self.merge(state, own)

    def merge(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = x[0] + y[0]
        share, both = np.divide(y[0], n, out=np.zeros_like(n), where=n > 0), np.divide(x[0] * y[0], n, out=np.zeros_like(n), where=n > 0)
        p, r = y[1] - x[1], y[2] - x[2]
        return np.stack([n, x[1] + p * share, x[2] + r * share, x[3] + y[3] + p * p * both, x[4] + y[4] + r * r * both, x[5] + y[5] + p * r * both])


class Correlation(_Joint):
    """Pearson's; NaN if either side is constant."""

    def finish(self, state: np.ndarray) -> np.ndarray:
        usable = (state[3] > 0) & (state[4] > 0)
        scale = np.sqrt(np.where(usable, state[3], 1.0)) * np.sqrt(np.where(usable, state[4], 1.0))
        return np.where(usable, state[5] / scale, np.nan)


class R2(_Joint):
    """1 - error / variance; of a constant truth 0 for a perfect prediction, else the lowest double; NaN becomes 0."""

    def finish(self, state: np.ndarray) -> np.ndarray:
        n, p, r, pp, rr, pr = state
        error = pp + rr - 2 * pr + n * (p - r) ** 2
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(rr > 0, 1.0 - error / np.where(rr > 0, rr, 1.0), np.where(error == 0, 0.0, -LARGEST))
        return np.where(np.isnan(error) | np.isnan(rr), 0.0, value)


class MeanAbsoluteError:
    """The mean distance; NaN of no rows."""

    def init(self, width: int) -> np.ndarray:
        return np.zeros((2, width))

    def update(self, state: np.ndarray, pred: np.ndarray, real: np.ndarray) -> np.ndarray:
        return state + np.stack([np.full(pred.shape[1], float(len(pred))), np.abs(pred - real).sum(axis=0)])

    def merge(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x + y

    def finish(self, state: np.ndarray) -> np.ndarray:
        return np.where(state[0] > 0, state[1] / np.maximum(state[0], 1.0), np.nan)
