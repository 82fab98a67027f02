"""Dense NumPy versions of the methods, from their formulas. NaN marks a missing cell."""

import numpy as np


def bicenter(x, passes):
    a, b = np.zeros(x.shape[0]), np.zeros(x.shape[1])
    for _ in range(passes):
        b = np.nanmean(x - a[:, None], axis=0)
        a = np.nanmean(x - b[None, :], axis=1)
    return a, b


def integer_start(rows, rank):
    i, k = np.arange(rows)[:, None], np.arange(rank)[None, :]
    f = ((i * 7919 + k * 104729 + 31) % 1000) / 1000.0 - 0.5
    return np.linalg.svd(f, full_matrices=False)[0]


def filled(x, m):
    return np.where(np.isnan(x), m, x)


def als(x, rank, lam, steps):
    """Each half step is a ridge-shrunk projection of the matrix filled in with the current fit."""
    u, d = integer_start(len(x), rank), np.ones(rank)
    v = np.zeros((x.shape[1], rank))
    for _ in range(steps):
        for side in (0, 1):
            full = filled(x, (u * d) @ v.T)
            # With V = 0 at the start the fill-in is 0.
            if side == 0:
                v, d, w = np.linalg.svd((full.T @ u) * (d / (d + lam)), full_matrices=False)
                u = u @ w.T
            else:
                u, d, w = np.linalg.svd((full @ v) * (d / (d + lam)), full_matrices=False)
                v = v @ w.T
    full = filled(x, (u * d) @ v.T)
    u, d, w = np.linalg.svd(full @ v, full_matrices=False)
    return u, np.maximum(d - lam, 0), v @ w.T


def nested(x, rank, lam, outer, inner):
    u, d = integer_start(len(x), rank), np.ones(rank)
    v = np.zeros((x.shape[1], rank))
    for _ in range(outer):
        full = filled(x, (u * d) @ v.T)
        for _ in range(inner):
            v, d, _ = np.linalg.svd((full.T @ u) * (d / (d + lam)), full_matrices=False)
            u, d, w = np.linalg.svd((full @ v) * (d / (d + lam)), full_matrices=False)
            v = v @ w.T
        u, d, w = np.linalg.svd(full @ v, full_matrices=False)
        v = v @ w.T
        d = np.maximum(d - lam, 0)
    return u, d, v


def objective(x, u, d, v, lam):
    return 0.5 * np.nansum((x - (u * d) @ v.T) ** 2) + lam * d.sum()
