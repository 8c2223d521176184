"""Row-by-row oracles in NumPy, independent of the library: enumeration for tiny problems, plain loops else."""

from itertools import combinations

import numpy as np


def cone_residual(basis, y):
    """Squared distance of y to the cone of the rows of ``basis``, by trying every support."""
    best = float(y @ y)
    for size in range(1, min(len(basis), len(y)) + 1):
        for support in combinations(range(len(basis)), size):
            x, *_ = np.linalg.lstsq(basis[list(support)].T, y, rcond=None)
            if (x >= -1e-10).all():
                left = y - basis[list(support)].T @ x
                best = min(best, float(left @ left))
    return best


def cone_residual_by_supports(basis, y):
    """The same for more rows than can be enumerated: grow a support one row at a time, solving by SVD."""
    support, x = [], np.zeros(len(basis))
    for _ in range(10 * len(basis) + 10):
        left = y - basis.T @ x
        gain = basis @ left
        gain[support] = -np.inf
        if len(basis) == 0 or gain.max() <= 1e-10:
            break
        support.append(int(gain.argmax()))
        while True:
            z = np.zeros(len(basis))
            z[support] = np.linalg.lstsq(basis[support].T, y, rcond=None)[0]
            if (z[support] > 0).all():
                x = z
                break
            negative = [j for j in support if z[j] <= 0]
            step = min(x[j] / (x[j] - z[j]) if x[j] > z[j] else 0.0 for j in negative)
            x = x + step * (z - x)
            support = [j for j in support if x[j] > 1e-13]
            x[[j for j in range(len(x)) if j not in support]] = 0.0
            if not support:
                break
    left = y - basis.T @ x
    return float(left @ left)


def span_residual(basis, y):
    if len(basis) == 0:
        return float(y @ y)
    x, *_ = np.linalg.lstsq(basis.T, y, rcond=None)
    left = y - basis.T @ x
    return float(left @ left)


def greedy(rows, solver, threshold=0.95, solve_by="r2", residual=None):
    """Positions found redundant when rows are tested in order against the rest minus those already dropped."""
    residual = residual or {"nnls": cone_residual_by_supports, "lstsq": span_residual}[solver]
    unit = rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-12)
    dropped = []
    for i, y in enumerate(unit):
        others = [j for j in range(len(unit)) if j != i and j not in dropped]
        left = residual(unit[others], y)
        if solve_by == "res":
            redundant = np.sqrt(left) <= 1e-8 * np.linalg.norm(unit[others])
        elif y.max() == y.min():
            redundant = bool(np.allclose(y, 0, atol=1e-10))
        else:
            redundant = 1 - left / np.sum((y - y.mean()) ** 2) >= threshold
        if redundant:
            dropped.append(i)
    return dropped


def simplex_minimum(cost, rows, floor=-0.01, ceiling=100_000.0):
    """min cost·w on the simplex with floor ≤ rows·w ≤ ceiling by enumerating vertices; None when infeasible."""
    d = len(cost)
    above = rows[(rows > ceiling).any(axis=1)] if len(rows) else rows
    normals = np.vstack([np.eye(d), rows - floor, (ceiling - above) / ceiling])
    best = None
    for active in combinations(range(len(normals)), d - 1):
        try:
            w = np.linalg.solve(np.vstack([np.ones(d), normals[list(active)]]), np.eye(d)[0])
        except np.linalg.LinAlgError:
            continue
        if (normals @ w >= -1e-9).all():
            value = float(cost @ w)
            best = value if best is None else min(best, value)
    return best


def half_space_greedy(rows):
    dropped = []
    for i, c in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i and j not in dropped]
        low = simplex_minimum(c, rows[others])
        if low is not None and round(low, 6) >= -0.01:
            dropped.append(i)
    return dropped
