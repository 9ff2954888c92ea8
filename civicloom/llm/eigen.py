"""Leading eigenpairs of a symmetric matrix that fits one machine.

Householder reflections make the matrix tridiagonal; Sturm counts (how many
eigenvalues lie below a value) bracket each wanted eigenvalue by bisection;
inverse iteration gives its vector, made orthogonal to those of the same cluster
in every step, and the reflections turn it back.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the norm form a cluster.
CLUSTER = 1e-3
_STEPS = 8


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, unit reflection vectors) of a symmetric matrix."""
    a = matrix.astype(float).copy()
    reflections = []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        length = np.linalg.norm(x)
        v[0] += length if v[0] >= 0 else -length
        norm = np.linalg.norm(v)
        if norm == 0:
            reflections.append(np.zeros_like(v))
            continue
        v /= norm
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value: the negative pivots of T - value."""
    least = _EPS * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny / _EPS)
    pivot, count = np.ones(len(values)), np.zeros(len(values), int)
    for d, e in zip(diagonal, [0.0, *off]):
        pivot = d - values - e * e / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected until no double lies between."""
    radius = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    low = np.full(k, (diagonal - radius).min())
    high = np.full(k, (diagonal + radius).max())
    margin = _EPS * max(np.abs(low[0]), np.abs(high[0])) * len(diagonal) + np.finfo(float).tiny
    low, high = low - margin, high + margin
    place = len(diagonal) - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        under = below(diagonal, off, middle) > place
        high, low = np.where(under, middle, high), np.where(under, low, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
    """A function that solves (T - value) x = b, factored once with row exchanges."""
    n = len(diagonal)
    d = (diagonal - value).tolist()
    upper, lower, second = off.tolist(), off.tolist(), [0.0] * max(n - 2, 0)
    factor, exchanged = [0.0] * max(n - 1, 0), [False] * max(n - 1, 0)
    for i in range(n - 1):
        if abs(lower[i]) > abs(d[i]):
            exchanged[i] = True
            factor[i] = d[i] / lower[i]
            d[i], under = lower[i], d[i + 1]
            d[i + 1] = upper[i] - factor[i] * under
            upper[i] = under
            if i < n - 2:
                second[i] = upper[i + 1]
                upper[i + 1] = -factor[i] * second[i]
        else:
            pivot = d[i] if abs(d[i]) > least else least
            factor[i] = lower[i] / pivot
            d[i] = pivot
            d[i + 1] -= factor[i] * upper[i]
    d = [x if abs(x) > least else least for x in d]

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(n - 1):
            if exchanged[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            x[i] = (x[i] - (upper[i] * x[i + 1] if i < n - 1 else 0) - (second[i] * x[i + 2] if i < n - 2 else 0)) / d[i]
        return np.array(x)

    return solve


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the k largest eigenvalues, falling."""
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0)) or 1.0
    rng = np.random.default_rng(1)
    vectors = np.zeros((len(diagonal), k))
    cluster = 0
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            cluster = j
        mates = vectors[:, cluster:j]
        solve = _solver(diagonal, off, values[j], _EPS * norm)
        x = rng.standard_normal(len(diagonal))
        for _ in range(_STEPS):
            x /= np.abs(x).max()
            x = solve(x)
            for _ in range(2):
                x -= mates @ (mates.T @ x)
            x /= np.linalg.norm(x)
        vectors[:, j] = x
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
