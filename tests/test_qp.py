from itertools import combinations

import numpy as np
import pytest

from varistack.operators import qp


def enumerated(p, tie=1e-10):
    """Every support's minimum-norm optimum; the best on the simplex, of equals the least norm."""
    f = len(p)
    q = p / max(abs(p).max(), 1e-300)
    best = (np.inf, np.inf, None)
    for size in range(1, f + 1):
        for own in map(list, combinations(range(f), size)):
            system = np.zeros((size + 1, size + 1))
            system[:size, :size] = q[np.ix_(own, own)]
            system[:size, size] = system[size, :size] = 1
            w = (np.linalg.pinv(system, rcond=1e-12) @ np.eye(size + 1)[size])[:size]
            if (w < -1e-12).any() or abs(w.sum() - 1) > 1e-8:
                continue
            full = np.zeros(f)
            full[own] = np.maximum(w, 0)
            value, norm = full @ q @ full, full @ full
            if value < best[0] - tie or (value <= best[0] + tie and norm < best[1] - 1e-9):
                best = (min(value, best[0]), norm, full)
    return best[2]


@pytest.mark.parametrize("f", [1, 2, 3, 5, 9])
def test_equals_enumeration(f):
    rng = np.random.default_rng(f)
    for rank in sorted({1, 2, f, f + 3}):
        e = rng.standard_normal((12, rank, f)) * rng.uniform(0.5, 2, (12, 1, f))
        if f > 2:
            e[:4, :, 1] = e[:4, :, 0]  # two spaces alike: their weights must be, too
        p = np.einsum("nri,nrj->nij", e, e) / rank
        w = qp.simplex_weights(p)
        assert (w >= 0).all() and np.allclose(w.sum(1), 1, atol=1e-12)
        assert (qp.violation(p, w) <= 1e-8 * abs(p).max(axis=(1, 2))).all()
        for mine, matrix in zip(w, p):
            other = enumerated(matrix)
            assert abs(mine @ matrix @ mine - other @ matrix @ other) < 1e-9 * abs(matrix).max()
            assert mine @ mine <= other @ other + 1e-6 and np.allclose(mine, other, atol=2e-3 if rank < f else 1e-7)
        if f > 2:
            assert np.allclose(w[:4, 0], w[:4, 1], atol=1e-8)


def test_many_spaces_are_certified():
    rng = np.random.default_rng(1)
    for f, n in ((20, 200), (60, 40)):
        e = rng.standard_normal((n, f // 2, f)) + rng.standard_normal((n, 1, f))
        p = np.einsum("nri,nrj->nij", e, e)
        w = qp.simplex_weights(p)
        assert (qp.violation(p, w) <= 1e-8 * abs(p).max(axis=(1, 2))).all() and (w >= 0).all()


def test_odd_matrices():
    assert np.allclose(qp.simplex_weights(np.zeros((2, 4, 4))), 0.25)
    assert np.allclose(qp.simplex_weights(np.ones((1, 3, 3))), 1 / 3)
    assert qp.simplex_weights(np.zeros((0, 3, 3))).shape == (0, 3)
    odd = np.array([[[np.nan, 0], [0, 1]], [[2.0, 0], [0, 1]], [[np.inf, 0], [0, 1]], [[1e-200, 0], [0, 1e-200]]])
    assert np.allclose(qp.simplex_weights(odd), [[0.5, 0.5], [1 / 3, 2 / 3], [0.5, 0.5], [0.5, 0.5]])
