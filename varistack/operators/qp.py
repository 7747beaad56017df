"""Weights on the simplex that minimise a quadratic form, by an active-set method.

The support grows by the space with the steepest descent and loses those that a step takes to zero, so
the value falls with every support and none comes twice; any number of spaces ends in the same way, with
a certificate: no space has a gradient under the multiplier. Where the optimum is not unique, which the
form's eigenvalues on the spaces without slack show, a ridge of ``TIE`` picks the support of the
least-norm optimum, and the weights on it are the least-norm solution of its own conditions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares of the largest entry: what is added to the diagonal, to keep systems solvable and to break ties;
#: the gradient that lets a space enter; eigenvalues that count as zero.
NORM, TIE, ENTERS, FLAT = 1e-11, 1e-7, 1e-10, 1e-9


def _on_support(q: np.ndarray, support: np.ndarray) -> np.ndarray:
    """The optimum over the affine hull of each support: zero outside it."""
    n, f = support.shape
    system = np.zeros((n, f + 1, f + 1))
    system[:, :f, :f] = np.where(support[:, :, None] & support[:, None, :], q, 0.0)
    system[:, range(f), range(f)] += ~support
    system[:, :f, f] = system[:, f, :f] = support
    right = np.zeros((n, f + 1, 1))
    right[:, f] = 1.0
    return np.linalg.solve(system, right)[:, :f, 0] * support


def violation(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How far weights are from optimal: by how much the multiplier exceeds the least gradient.

    For a convex form this bounds ``½ wᵀPw`` less its minimum.
    """
    gradient = np.einsum("nij,nj->ni", p, w)
    return (w * gradient).sum(axis=1) - gradient.min(axis=1)


def simplex_weights(p: np.ndarray) -> np.ndarray:
    """``argmin ½ wᵀPw`` over w >= 0, Σw = 1 for each of a stack (n, F, F); of several, the least norm.

    ``P`` must be positive semidefinite up to rounding; one that is not finite counts as zero, whose
    weights are equal. A stack without rows gives none.
    """
    p = np.where(np.isfinite(p).all(axis=(1, 2), keepdims=True), p, 0.0)
    p = (p + np.swapaxes(p, 1, 2)) / 2
    scale = np.maximum(np.abs(p).max(axis=(1, 2), initial=0.0), 1e-300)
    q = p / scale[:, None, None]
    w = _active_set(q, NORM)
    tied = np.flatnonzero(_flat(q, w))
    if len(tied):
        w[tied] = _least_norm(q[tied], _active_set(q[tied], TIE))
    return w


def _flat(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Where the optimum is not alone: the form is flat along some change among the spaces without slack."""
    gradient = np.einsum("nij,nj->ni", q, w)
    free = gradient <= (w * gradient).sum(axis=1, keepdims=True) + FLAT
    share = free / np.maximum(free.sum(axis=1, keepdims=True), 1)
    project = np.eye(q.shape[1]) * free[:, :, None] - share[:, :, None] * free[:, None, :]
    values = np.linalg.eigvalsh(project @ q @ np.swapaxes(project, 1, 2))
    return (values > FLAT).sum(axis=1) < free.sum(axis=1) - 1


def _least_norm(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The least-norm optimum on each support; the weights as they are where it leaves the simplex or the value rises."""
    support = w > 0
    n, f = w.shape
    system = np.zeros((n, f + 1, f + 1))
    system[:, :f, :f] = np.where(support[:, :, None] & support[:, None, :], q, 0.0)
    system[:, :f, f] = system[:, f, :f] = support
    right = np.zeros(f + 1)
    right[f] = 1.0
    found = (np.linalg.pinv(system, rcond=FLAT) @ right)[:, :f] * support
    inside = (found >= -1e-9).all(axis=1) & (np.abs(found.sum(axis=1) - 1) < 1e-8)
    found = np.maximum(found, 0.0)
    found /= np.maximum(found.sum(axis=1, keepdims=True), 1e-300)
    value = lambda x: np.einsum("ni,nij,nj->n", x, q, x)
    return np.where((inside & (value(found) <= value(w) + FLAT))[:, None], found, w)


def _active_set(q: np.ndarray, ridge: float) -> np.ndarray:
    n, f = q.shape[:2]
    q = q + ridge * np.eye(f)
    w = np.zeros((n, f))
    w[np.arange(n), np.diagonal(q, axis1=1, axis2=2).argmin(axis=1)] = 1.0
    support, open_ = w > 0, np.arange(n)
    for _ in range(64 * (f + 1)):
        if not len(open_):
            return w
        own, at = support[open_], w[open_]
        aim = _on_support(q[open_], own)
        out = own & (aim <= 0)
        inside = ~out.any(axis=1)
        share = np.where(out, at / np.where(out, np.maximum(at - aim, 1e-300), 1.0), np.inf)
        step = np.minimum(share.min(axis=1), 1.0)
        at = np.where(inside[:, None], aim, at + step[:, None] * (aim - at))
        own &= inside[:, None] | ~(out & (share <= step[:, None]))
        at = np.where(own, np.maximum(at, 0.0), 0.0)
        at /= at.sum(axis=1, keepdims=True)
        gradient = np.einsum("nij,nj->ni", q[open_], at)
        slack = np.where(own, np.inf, gradient - (at * gradient).sum(axis=1, keepdims=True))
        enters = inside & (slack.min(axis=1) < -ENTERS)
        own[enters, slack.argmin(axis=1)[enters]] = True
        w[open_], support[open_] = at, own
        open_ = open_[~inside | enters]
    raise ArithmeticError(f"no certified weights for {len(open_)} targets")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def simplex_udf(p: pd.Series) -> pd.Series:
    """The same over a column of flattened matrices."""
    out = [None] * len(p)
    sizes = p.map(len)
    for size in sizes.unique():
        rows = np.flatnonzero((sizes == size).to_numpy())
        f = int(round(size**0.5))
        got = simplex_weights(np.stack(p.iloc[rows].to_list()).reshape(-1, f, f))
        for r, w in zip(rows, got.tolist()):
            out[r] = w
    return pd.Series(out)


def simplex_two(p11: Column, p12: Column, p22: Column) -> Column:
    """First weight of two, in closed form; equal weights where the form is flat."""
    spread = p11 + p22 - 2 * p12
    return F.when(F.abs(spread) < 1e-300, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p22 - p12) / F.when(F.abs(spread) >= 1e-300, spread))))
