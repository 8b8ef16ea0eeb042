"""Leading eigenpairs of a symmetric matrix that one process can hold.

Householder reflections make the matrix tridiagonal, Sturm counts bisect for its
largest eigenvalues, and inverse iteration finds their vectors; vectors of
eigenvalues that lie close together are made orthogonal to each other in every
step. The reflections then turn them into vectors of the matrix itself.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps
#: Eigenvalues nearer to each other than this share of the norm form a cluster.
CLUSTER = 1e-3
_STEPS = 6


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, off-diagonal, reflections) with unit vectors v of I - 2 v v^T,
    each acting on the places from its number on."""
    a = np.array(matrix, np.float64)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if not np.any(v[1:]) or size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        p = 2 * a[k + 1:, k + 1:] @ v
        w = p - (v @ p) * v
        a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
        x = a[k + 1:, k].copy()
        a[k + 1:, k] = a[k, k + 1:] = x - 2 * (v @ x) * v
        reflections.append((k + 1, v))
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflections


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    square = off * off
    tiny = _EPS * max(float(np.abs(diag).max()), float(np.abs(off).max()) if len(off) else 0.0, np.finfo(float).tiny)
    q = diag[0] - at
    below = (q < 0).astype(np.int64)
    for i in range(1, len(diag)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diag[i] - at - square[i - 1] / q
        below += q < 0
    return below


def largest_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, bisected by Sturm counts."""
    d = len(diag)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = float((diag - reach).min()), float((diag + reach).max())
    size = max(abs(low), abs(high))
    lo, hi = np.full(k, low - size * _EPS * d), np.full(k, high + size * _EPS * d)
    wanted = d - np.arange(k)  # the j-th largest has d - j values below or at it
    for _ in range(200):
        mid = (lo + hi) / 2
        less = sturm_counts(diag, off, mid) < wanted
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
        if (hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)) + np.finfo(float).tiny).all():
            break
    return (lo + hi) / 2


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x of (T - shift I) x = b by elimination with row exchanges; a pivot that
    vanishes counts as the smallest that rounding can tell from it."""
    d = len(diag)
    main, up, up2 = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d
    low, x = off.tolist(), b.tolist()
    tiny = _EPS * max(max(map(abs, main)), max(map(abs, low), default=0.0), np.finfo(float).tiny)
    for i in range(d - 1):
        if abs(low[i]) > abs(main[i]):
            f = main[i] / low[i]
            main[i], (main[i + 1], up[i]) = low[i], (up[i] - f * main[i + 1], main[i + 1])
            if i + 1 < d - 1:
                up2[i], up[i + 1] = up[i + 1], -f * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            f = low[i] / (main[i] if abs(main[i]) > tiny else tiny)
            main[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
    for i in range(d - 1, -1, -1):
        r = x[i] - (up[i] * x[i + 1] if i + 1 < d else 0.0) - (up2[i] * x[i + 2] if i + 2 < d else 0.0)
        x[i] = r / (main[i] if abs(main[i]) > tiny else tiny)
    return np.array(x)


def vectors_of(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix for falling ``values``."""
    rng = np.random.RandomState(11)
    size = max(float(np.abs(diag).max()), float(np.abs(off).max()) if len(off) else 0.0)
    out = np.zeros((len(values), len(diag)))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * size:
            first = j
        # Equal values are set apart, so that their systems differ.
        shift = value - (j - first) * 4 * _EPS * size
        x = rng.uniform(0.5, 1.0, len(diag)) * rng.choice([-1.0, 1.0], len(diag))
        for _ in range(_STEPS):
            for _ in range(2):  # twice is enough
                x -= out[first:j].T @ (out[first:j] @ x)
            x = solve_shifted(diag, off, shift, x / np.linalg.norm(x))
            x /= np.abs(x).max()
        for _ in range(2):
            x -= out[first:j].T @ (out[first:j] @ x)
        out[j] = x / np.linalg.norm(x)
    return out


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and their unit vectors as rows, each
    with its largest entry positive."""
    k = min(k, len(matrix))
    diag, off, reflections = tridiagonal(matrix)
    if not np.any(diag) and not np.any(off):
        return np.zeros(k), np.eye(len(matrix))[:k]
    values = largest_values(diag, off, k)
    vectors = vectors_of(diag, off, values)
    for at, v in reversed(reflections):
        vectors[:, at:] -= 2 * np.outer(vectors[:, at:] @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    sign = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])
    return values, vectors * np.where(sign == 0, 1.0, sign)[:, None]
