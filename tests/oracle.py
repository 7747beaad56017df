"""Row by row statements of the regression semantics, to hold the moment-based operators against."""

import numpy as np

LAMBDAS = [10.0**i for i in range(-6, 10)]


def last_folds(n, k):
    size = n // k
    return np.array([min(i // size, k - 1) for i in range(n)])


def first_folds(n, k):
    return np.repeat(np.arange(k), [n // k + (i < n % k) for i in range(k)])


def z(a, clean=True):
    out = np.full(a.shape, 0.0 if clean else np.nan)
    for j in range(a.shape[1]):
        c = a[:, j]
        if np.isfinite(c).all() and c.min() < c.max():
            out[:, j] = (c - c.mean()) / c.std()
    return out


def r2(pred, real):
    with np.errstate(all="ignore"):
        return np.nan_to_num(1 - ((real - pred) ** 2).mean(0) / real.var(0))


def ridge(x, y, lam):
    return np.linalg.solve(x.T @ x + lam * np.eye(x.shape[1]), x.T @ y)


def cv_ridge(x, y, splits):
    fold = first_folds(len(x), splits)
    cost = np.zeros((len(LAMBDAS), y.shape[1]))
    for k in range(splits):
        xt, yt, xv, yv = z(x[fold != k], False), z(y[fold != k], False), z(x[fold == k], False), z(y[fold == k], False)
        for i, lam in enumerate(LAMBDAS):
            if np.isnan(xt).any() or np.isnan(xv).any():
                cost[i] += 1
                continue
            for v in range(y.shape[1]):
                dead = np.isnan(yt[:, v]).any() or np.isnan(yv[:, v]).any()
                cost[i, v] += 1 if dead else 1 - r2(xv @ ridge(xt, yt[:, v], lam), yv[:, v])
    best = cost.argmin(0)
    return np.stack([ridge(x, y[:, v], LAMBDAS[b]) for v, b in enumerate(best)], axis=1)


def space_fit(xtr, ytr, xte, inner=5):
    fold = last_folds(len(xtr), inner)
    pred = np.zeros_like(ytr)
    for b in range(inner):
        w = cv_ridge(z(xtr[fold != b]), z(ytr[fold != b]), 5)
        pred[fold == b] = z(xtr[fold == b]) @ w
    return pred, xte @ cv_ridge(xtr, ytr, 5)


def simplex(p):
    """Fine search over the simplex by exponentiated gradient."""
    w = np.full(len(p), 1 / len(p))
    for _ in range(20000):
        g = p @ w
        w = w * np.exp(-(g - g.min()) * 2 / max(abs(p).max(), 1e-12))
        w /= w.sum()
    return w


def stack_cv(xs, y, k):
    n, f, v = len(y), len(xs), y.shape[1]
    fold = last_folds(n, k)
    pred = np.zeros((f, n, v))
    stacked, train, weights, train_each = np.zeros((n, v)), [], [], []
    for o in range(k):
        tr, te = fold != o, fold == o
        ytr = z(y[tr])
        fits = [space_fit(z(x[tr]), ytr, z(x[te])) for x in xs]
        err = [ytr - a for a, _ in fits]
        p = np.array([[(err[i] * err[j]).mean(0) for j in range(f)] for i in range(f)])
        w = np.stack([simplex(p[:, :, t]) for t in range(v)])
        for i in range(f):
            pred[i, te] = fits[i][1]
        stacked[te] = sum(fits[i][1] * w[:, i] for i in range(f))
        train.append(r2(sum(fits[i][0] * w[:, i] for i in range(f)), ytr))
        train_each.append([r2(a, ytr) for a, _ in fits])
        weights.append(w)
    real = z(y, clean=False)
    return np.array([r2(p, real) for p in pred]), r2(stacked, real), np.mean(train_each, 0), np.mean(train, 0), np.mean(weights, 0)
