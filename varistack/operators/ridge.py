"""Ridge regression with a penalty per target, from moments of row segments."""

from __future__ import annotations

import numpy as np

from varistack.functions.expressions import LARGEST
from varistack.operators.moments import Moments, Side

#: The penalties that are tried.
LAMBDAS = np.array([10.0**i for i in range(-6, 10)])


def solve(side: Side, columns: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Weights (penalty, column, target) of z-scored ridge without intercept: (N R + λ I)⁻¹ N r.

    One eigendecomposition serves all penalties. Dead columns get weight 0.
    """
    value, vector = side.eigen(columns)
    right = np.swapaxes(vector, -1, -2) @ (side.n * side.rxy[..., columns, :])
    scaled = right[..., None] / (np.maximum(value, 0.0)[..., None] + penalties)[..., None, :]
    return np.moveaxis(_times(vector, scaled), -1, 0)


def _times(matrix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The product with arrays (column, target, penalty), in one multiplication for all penalties."""
    return (matrix @ last.reshape(*last.shape[:-2], last.shape[-2] * last.shape[-1])).reshape(last.shape)


def val_cost(weights: np.ndarray, val: Side, columns: np.ndarray) -> np.ndarray:
    """1 - R² on a z-scored validation side, per penalty and target of ``weights``."""
    r, ry = val.rxx[..., columns[:, None], columns], val.rxy[..., columns, :]
    w = np.moveaxis(weights, 0, -1)
    fit = np.einsum("...dvl,...dv->...vl", w, ry)
    power = np.einsum("...dvl,...dvl->...vl", w, _times(r, w))
    return np.where(val.y_alive, np.moveaxis(1.0 - 2.0 * fit + power, -1, 0), 1.0)


def lambda_costs(m: Moments, base: np.ndarray, split: np.ndarray, splits: int, columns: np.ndarray, dead_x: np.ndarray, dead_y: np.ndarray, penalties: np.ndarray = LAMBDAS) -> np.ndarray:
    """Summed cost (penalty, target) over the splits of the segments in ``base``.

    A split in which a predictor of the space is dead on either side says nothing: its cost is 1 for
    every penalty and target. So it is for a target that is dead on either side.
    """
    total = np.zeros((len(penalties), *dead_y.shape))
    for k in range(splits):
        trn, val = m.select(base & (split != k)), m.select(base & (split == k))
        told = (~dead_x & trn.alive[..., : m.p] & val.alive[..., : m.p])[..., columns].all(axis=-1)
        if not told.any():
            total += 1.0
            continue
        cost = val_cost(solve(trn, columns, penalties), val, columns)
        total += np.where(trn.y_alive & val.y_alive & ~dead_y & told[..., None], cost, 1.0)
    return total


SOLVERS = ("plain", "svd", "ridge_sk")


def checked_solver(name: str) -> str:
    """The named solver. All three have one solution of z-scored data, which has no intercept, ``svd`` without
    squaring the columns' condition where it is asked of whole tables; of raw data (:func:`solve_raw`) the last one centres."""
    if name not in SOLVERS:
        raise ValueError(f"unknown solver {name!r}, not one of {', '.join(SOLVERS)}")
    return name


def solve_raw(side: Side, origin: np.ndarray, columns: np.ndarray, penalty: float, solver: str = "plain") -> np.ndarray:
    """Weights (column, target) of ridge on the columns as they are; ``ridge_sk`` fits an intercept besides.

    Columns that are constant count with their value for the first two, and not at all for the last.
    """
    p = side.p
    sd, mean = side.sd, side.mean + origin
    xx = side.n * side.rxx[np.ix_(columns, columns)] * np.outer(sd[columns], sd[columns])
    xy = side.n * side.rxy[columns] * np.outer(sd[columns], sd[p:])
    if checked_solver(solver) != "ridge_sk":
        xx, xy = xx + side.n * np.outer(mean[columns], mean[columns]), xy + side.n * np.outer(mean[columns], mean[p:])
    return np.linalg.solve(xx + penalty * np.eye(len(columns)), xy)


def raw_costs(m: Moments, split: np.ndarray, splits: int, origin: np.ndarray, penalties: np.ndarray, solver: str = "plain") -> np.ndarray:
    """Summed 1 - R² (penalty, target) over the splits, of ridge on the columns as they are.

    Predictions are the columns times the weights, without the intercept that ``ridge_sk`` fits beside
    them. A target that is constant on the held rows has R² 0 for a perfect prediction, else the lowest double.
    """
    columns, total = np.arange(m.p), 0.0
    for k in range(splits):
        train, held = m.select(split != k), m.select(split == k)
        mean, sd, p = held.mean + origin, held.sd, m.p
        xx = held.rxx * np.outer(sd[:p], sd[:p]) + np.outer(mean[:p], mean[:p])
        xy = held.rxy * np.outer(sd[:p], sd[p:]) + np.outer(mean[:p], mean[p:])
        yy, cost = sd[p:] ** 2 + mean[p:] ** 2, []
        for penalty in penalties:
            w = solve_raw(train, origin, columns, penalty, solver)
            error = np.maximum(yy - 2 * (w * xy).sum(axis=0) + (w * (xx @ w)).sum(axis=0), 0.0)
            varies = sd[p:] > 0
            cost.append(np.where(varies, error / np.where(varies, sd[p:] ** 2, 1.0), np.where(error <= 1e-12 * yy, 1.0, 1.0 + LARGEST)))
        total = total + np.stack(cost)
    return total


def fit(m: Moments, base: np.ndarray, split: np.ndarray, splits: int, columns: np.ndarray, dead_x: np.ndarray, dead_y: np.ndarray, penalties: np.ndarray = LAMBDAS) -> tuple[np.ndarray, np.ndarray]:
    """``(weights (column, target), penalty per target)``, refitted on ``base`` at each target's best penalty (ties: the smallest)."""
    choice = lambda_costs(m, base, split, splits, columns, dead_x, dead_y, penalties).argmin(axis=0)
    side = m.select(base)
    weights = np.zeros((*choice.shape[:-1], len(columns), choice.shape[-1]))
    live, usable = side.y_alive & ~dead_y, ~dead_x[..., columns]  # a column dead in an enclosing frame is 0 here
    for kept in np.unique(usable.reshape(-1, len(columns)), axis=0):
        same = live & (usable == kept).all(axis=-1)[..., None]
        for i in np.unique(choice[same]):
            own = (same & (choice == i))[..., None, :]
            weights[..., kept, :] = np.where(own, solve(side, columns[kept], penalties[i : i + 1])[0], weights[..., kept, :])
    return weights, penalties[choice]
