"""Synthetic stacked-regression data with a known variance partition, and one experiment on it."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

from varistack.operators.moments import Moments, last_bounds, segment_starts
from varistack.operators.qp import simplex_weights
from varistack.operators.stack import Fold, fold_matrices, space_columns

METRICS = ("stacked", "concat", "max", "r2_X0", "varpar_X0_concat", "varpar_X0_stacked", "varpar_X0_real", "weight_0", "alpha_0")
#: Experiments fitted at once, their bytes at most, and the matrices of all columns that each keeps meanwhile
#: (segments, statistics of a fold's sides, eigenvectors).
AT_ONCE, AT_ONCE_BYTES, KEPT = 256, 128 << 20, 320


def toeplitz_cov(n: int, scale: float = 1.0) -> np.ndarray:
    """``exp(-(i - j)² / (n scale))``."""
    i = np.arange(n)
    return np.exp(-((i[:, None] - i) ** 2) / (n * scale))


def _z(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)


def _r2(pred: np.ndarray, real: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nan_to_num(1 - ((real - pred) ** 2).mean(0) / real.var(0))


@functools.lru_cache(32)
def _root(dim: int, scale: float) -> np.ndarray:
    _, values, vectors = np.linalg.svd(toeplitz_cov(dim, scale))
    return np.sqrt(values)[:, None] * vectors


def _normal(rng: np.random.RandomState, dim: int, scale: float, size: int) -> np.ndarray:
    """What ``rng.multivariate_normal`` draws, bit for bit, with one decomposition of the covariance for all draws."""
    return np.dot(rng.standard_normal((size, dim)), _root(dim, scale))


def sample(rng: np.random.RandomState, n: int, ds: Sequence[int], scale: float, correl: float, alpha: Sequence[float], targets: int, noise: float = 0.0):
    """``(spaces, y, true variance per space and target)``.

    Draws come in a fixed order: the spaces, all target weights, the maps between neighbouring spaces
    (with a correlation), the noise (always).
    """
    if len(ds) != len(alpha):
        raise ValueError("one alpha per space")
    spaces = [_normal(rng, d, scale, n) for d in ds]
    all_weights = _normal(rng, sum(ds), scale, targets).T
    y, parts = np.zeros((n, targets)), []
    for i, own in enumerate(space_columns(ds)):
        w = all_weights[own]
        part = _z(spaces[i] @ w)
        parts.append(part)
        y = y + alpha[i] * part
        if correl > 0 and i + 1 < len(ds):
            leak = spaces[i + 1] @ _normal(rng, ds[i + 1], scale, ds[i]).T
            y = y + alpha[i] * correl * _z(leak @ w)
            spaces[i] = spaces[i] + correl * leak
        elif correl > 0:
            y = y + alpha[i] * correl * part
            spaces[i] = spaces[i] * (1 + correl)
    y = _z(y)
    y = y + noise * rng.standard_normal(y.shape)
    return spaces, y, np.stack([_r2(a * t, y) for a, t in zip(alpha, parts)])


def _scores(stats: list[tuple], own: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pooled stacked R² and mean weights for a subset of spaces, per experiment and target."""
    own = list(own)
    ss, n, total = 0.0, 0, 0.0
    for held, base, _, _, p, c, q in stats:
        p, c, q = p[..., own, :][..., own], c[..., own], q[..., own, :][..., own]
        w = simplex_weights(p.reshape(-1, len(own), len(own))).reshape(c.shape)
        ss = ss + base - 2 * (w * c).sum(-1) + np.einsum("...i,...ij,...j->...", w, q, w)
        n, total = n + held, total + w
    return 1 - ss / n, total / len(stats)


def run_one(seed: int, n: int, ds: Sequence[int], scale: float, correl: float, alpha: Sequence[float], targets: int, noise: float, n_folds: int = 4) -> dict[str, np.ndarray]:
    """One experiment: the nine metrics per target."""
    return {name: values[0] for name, values in run_many([(seed, correl, alpha, noise)], n, ds, scale, targets, n_folds).items()}


def at_once(ds: Sequence[int], targets: int) -> int:
    """Experiments that are fitted at once: their moments and statistics stay within ``AT_ONCE_BYTES``, if more than one's do."""
    p = sum(ds)
    return int(np.clip(AT_ONCE_BYTES // (KEPT * (p + 1) * (p + targets) * 8), 1, AT_ONCE))


def run_many(runs: Sequence[tuple], n: int, ds: Sequence[int], scale: float, targets: int, n_folds: int = 4) -> dict[str, np.ndarray]:
    """The nine metrics per run and target of experiments ``(seed, correl, alpha, noise)`` of one shape.

    The fits of all runs are taken together; subsets of spaces reuse the fits of all of them.
    """
    drawn = [sample(np.random.RandomState(seed), n, ds, scale, correl, alpha, targets, noise) for seed, correl, alpha, noise in runs]
    x = np.stack([np.concatenate(spaces, axis=1) for spaces, _, _ in drawn])
    y = np.stack([_z(own) for _, own, _ in drawn])
    outer = last_bounds(n, n_folds)
    starts = segment_starts(n, outer, 5, 5)
    cuts = [slice(a, b) for a, b in zip(starts, [*starts[1:], n])]
    z, across = np.concatenate([x, y], axis=-1), np.swapaxes(x, 1, 2)
    each = lambda f: np.stack([f(own) for own in cuts])
    m = Moments(
        each(lambda own: own.stop - own.start), each(lambda own: z[:, own].sum(1)), each(lambda own: across[:, :, own] @ x[:, own]), each(lambda own: across[:, :, own] @ y[:, own]),
        each(lambda own: (y[:, own] ** 2).sum(1)), each(lambda own: z[:, own].min(1)), each(lambda own: z[:, own].max(1)), x.shape[-1],
    )
    columns, found = space_columns(ds), []
    for a, b in zip(outer[:-1], outer[1:]):
        m.sides, m.eigen = {}, {}
        fold = Fold(starts, int(a), int(b), n, 5, 5)
        found.append([fold_matrices(m, fold, groups, "cross_val_ridge", 5, "global") for groups in (columns, [np.concatenate(columns)], [np.concatenate(columns[1:])])])
    spaces, whole, without_first = zip(*found)
    stacked, weights = _scores(spaces, range(len(ds)))
    rest, _ = _scores(spaces, range(1, len(ds)))
    single = [_scores(spaces, [i])[0] for i in range(min(2, len(ds)))]
    concat, _ = _scores(whole, [0])
    concat_rest, _ = _scores(without_first, [0])
    real = np.stack([own[0] for _, _, own in drawn])
    alphas = np.array([[alpha[0]] * targets for _, _, alpha, _ in runs])
    values = (stacked, concat, np.max(single, axis=0), single[0], concat - concat_rest, stacked - rest, real, weights[..., 0], alphas)
    return dict(zip(METRICS, values))
