"""NumPy helpers that run inside tasks on bounded pieces: one row against a working set of columns.

Working sets are matrices whose *rows* are the basis vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RANK_TOL = 1e-10
GRADIENT_TOL = 1e-11
# A basis row improves a fit when its inner product with the residual exceeds this share of the residual.
IMPROVES = 1e-8
# Basis rows that enter a non-negative fit together, and steps per basis row after which it is given up as an error.
AT_ONCE, STEPS = 8, 30
# A linear programme on more rows looks at some of them at a time, to which as many join as it violates most.
PRICED, JOINING = 512, 64
# Programmes solved side by side: at most so many, and as many as work within a core's cache.
SIDES, SIDE_BYTES = 64, 2 << 20


# ---------------------------------------------------------------- least squares


def lstsq_residual(basis: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y minus its projection on the row space of ``basis``."""
    if len(basis) == 0:
        return y.copy()
    x = np.linalg.lstsq(basis.T, y, rcond=None)[0]
    return y - basis.T @ x


def nnls(basis: np.ndarray, y: np.ndarray, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative coefficients that minimise ‖y − basisᵀx‖, and the residual vector.

    The active-set method of Lawson and Hanson with several rows entering at once, finished by a QR solve on
    the final support. ``usable`` masks basis rows out.
    """
    k, d = basis.shape if basis.ndim == 2 else (0, len(y))
    x = np.zeros(k)
    if k == 0:
        return x, y.copy()
    allowed = np.ones(k, dtype=bool) if usable is None else usable.copy()
    support = np.zeros(k, dtype=bool)
    c = basis @ y

    def settle() -> None:
        """Move x to the least-squares point of the support, dropping rows that would turn negative."""
        p = np.flatnonzero(support)
        gram = basis[p] @ basis[p].T
        while len(p):
            try:
                z = np.linalg.solve(gram, c[p])
            except np.linalg.LinAlgError:
                z = np.full(len(p), np.inf)
            if not np.abs(z).max() < 1e8:
                # Rows that entered together may depend on one another.
                z = np.linalg.lstsq(gram, c[p], rcond=1e-12)[0]
            if z.min() > 0:
                x[:] = 0.0
                x[p] = z
                return
            now = x[p]
            falling = z <= 0
            step = np.min(now[falling] / np.maximum(now[falling] - z[falling], 1e-300))
            now += step * (z - now)
            stays = ~(falling & (now <= 1e-14))
            if stays.all():
                stays[np.argmin(np.where(falling, now, np.inf))] = False
            x[p] = np.where(stays, now, 0.0)
            support[p[~stays]] = False
            p, gram = p[stays], gram[np.ix_(stays, stays)]

    at_once, reached = AT_ONCE, 0.0
    for _ in range(STEPS * (k + 20)):
        p = np.flatnonzero(support)
        w = basis @ (y - x[p] @ basis[p])
        w[support | ~allowed] = -np.inf
        room = max(1, min(at_once, d - len(p)))
        entering = np.argpartition(-w, room - 1)[:room] if room < k else np.arange(k)
        entering = entering[w[entering] > GRADIENT_TOL]
        if len(entering) == 0:
            break
        support[entering] = True
        settle()
        gain = x @ c
        if len(entering) > 1:
            # Several at once are only worth it while they help; one at a time always does.
            at_once = AT_ONCE if gain > reached + 1e-12 else 1
        elif not support[entering[0]]:
            allowed[entering[0]] = False  # numerically dependent on the support
        reached = max(gain, reached)
    else:
        raise ArithmeticError("a non-negative fit did not converge")
    p = np.flatnonzero(support)
    if 0 < len(p) <= d:
        q, r = np.linalg.qr(basis[p].T)
        if np.abs(np.diag(r)).min() > RANK_TOL:
            z = np.linalg.solve(r, q.T @ y)
            if z.min() > 0:
                x[p] = z
    return x, y - basis.T @ x


def certify(targets: np.ndarray, pool: np.ndarray, limits: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Which target rows some non-negative combination of ``pool`` brings to ‖residual‖² ≤ limit.

    Coordinate descent on many rows at once. True is proof; False says nothing.
    """
    done = np.zeros(len(targets), dtype=bool)
    weights = np.einsum("ij,ij->i", pool, pool)
    columns = np.flatnonzero(weights > 0)
    if len(columns) == 0:
        return done
    for begin in range(0, len(targets), 1024):  # small enough to stay in cache
        active = np.arange(begin, min(begin + 1024, len(targets)))
        left = targets[active].copy()
        x = np.zeros((len(pool), len(active)))
        for sweep in range(sweeps):
            for j in columns:
                step = np.maximum(left @ pool[j] / weights[j], -x[j])
                x[j] += step
                left -= np.outer(step, pool[j])
            ok = np.einsum("ij,ij->i", left, left) <= limits[active]
            done[active[ok]] = True
            if ok.any():
                active, left, x = active[~ok], left[~ok], x[:, ~ok]
            if len(active) == 0:
                break
    return done


def spans_everything(pool: np.ndarray, accuracy: float) -> bool:
    """Whether non-negative combinations of ``pool`` reach every unit vector to within ``accuracy``.

    They do when the rows have full rank and some combination with every weight at least 1 cancels out:
    then minus each row is available too.
    """
    rows = pool[np.einsum("ij,ij->i", pool, pool) > 0.25]
    if len(rows) <= pool.shape[1]:
        return False
    smallest = np.linalg.svd(rows, compute_uv=False)[-1]
    if smallest <= 1e-6:
        return False
    balance = -rows.sum(axis=0)
    size = np.linalg.norm(balance)
    if size <= accuracy * smallest:
        return True
    _, left = nnls(rows, balance / size)
    # Signed weights of a unit vector are at most 1/smallest; shifting them by multiples of the cancelling
    # combination makes them non-negative at the cost of that many times its remainder.
    return float(np.linalg.norm(left)) * size / smallest <= accuracy


def last_independent(keys: np.ndarray, rows: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Positions of rows independent of ``basis`` and of all rows with a larger key, largest key first."""
    d = rows.shape[1]
    q = np.zeros((0, d)) if basis is None else basis
    picked: list[int] = []
    order = np.argsort(-keys, kind="stable")
    for begin in range(0, len(order), 512):
        if len(q) >= d:
            break
        part = order[begin : begin + 512]
        left = rows[part] - (rows[part] @ q.T) @ q
        left -= (left @ q.T) @ q
        for i in range(len(part)):
            size = np.linalg.norm(left[i])
            if size <= RANK_TOL:
                continue
            unit = left[i] / size
            unit -= (unit @ q.T) @ q
            unit /= np.linalg.norm(unit)
            picked.append(int(part[i]))
            q = np.vstack([q, unit])
            if len(q) >= d:
                break
            left[i + 1 :] -= np.outer(left[i + 1 :] @ unit, unit)
    return np.array(picked, dtype=np.int64)


def orthonormal(rows: np.ndarray) -> np.ndarray:
    """Orthonormal rows that span the given ones."""
    if len(rows) == 0:
        return rows
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return vt[s > RANK_TOL]


# ---------------------------------------------------------------- one test per row


@dataclass
class Verdict:
    """Outcome of one row against one working set.

    ``direction`` and ``limit`` say which basis row could change it: one whose inner product with
    ``direction`` exceeds ``limit``.
    """

    redundant: bool
    value: float
    direction: np.ndarray
    limit: float


@dataclass(frozen=True)
class ConeTest:
    """Is the row a non-negative combination of the basis, by R² or by residual?"""

    solve_by: str
    threshold: float

    def judge(self, y: np.ndarray, basis: np.ndarray, spread: float, n_columns: int, usable: np.ndarray | None = None) -> Verdict:
        """``spread`` is the centred sum of squares of y; ``n_columns`` counts the non-zero basis rows."""
        _, left = nnls(basis, y, usable)
        return self._verdict(left, spread, n_columns)

    def _verdict(self, left: np.ndarray, spread: float, n_columns: int) -> Verdict:
        size = float(np.linalg.norm(left))
        if self.solve_by == "res":
            return Verdict(size <= 1e-8 * np.sqrt(n_columns), size, left, IMPROVES * size)
        r2 = 1.0 - size * size / spread
        return Verdict(r2 >= self.threshold, r2, left, IMPROVES * size)

    def exact(self, verdict: Verdict, size: float) -> bool:
        """Whether the fit misses its row by so little that no further row matters."""
        return float(np.linalg.norm(verdict.direction)) <= size

    def prove(self, rows: np.ndarray, spread: np.ndarray, basis: np.ndarray, n_columns: int) -> np.ndarray:
        """Which rows a cheap joint fit on ``basis`` already shows redundant."""
        if self.solve_by == "res":
            limits = np.full(len(rows), 1e-16 * n_columns)
        else:
            limits = (1.0 - self.threshold) * spread
        return certify(rows, basis, limits * (1 - 1e-9))


@dataclass(frozen=True)
class SpanTest(ConeTest):
    """The same with coefficients of any sign."""

    def judge(self, y, basis, spread, n_columns, usable=None) -> Verdict:
        rows = basis if usable is None else basis[usable]
        return self._verdict(lstsq_residual(rows, y), spread, n_columns)


# ---------------------------------------------------------------- half-space test

# ---- fixed values: slack of every half-space constraint, its upper bound, and the rounding of the minimum ----
HALF_SPACE_SLACK = 0.01
UPPER_BOUND = 100_000.0
MIN_VALUE_DIGITS = 6


def upper_sides(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can exceed the upper bound on the simplex, and the same bounds written as lower ones.

    With Σw = 1, row·w ≤ bound is (bound − slack − row)·w ≥ −slack. It can only bind where a component is above the bound.
    """
    large = np.flatnonzero(rows.max(axis=1, initial=-np.inf) > UPPER_BOUND)
    return large, UPPER_BOUND - HALF_SPACE_SLACK - rows[large]


def gains(rows: np.ndarray, directions: np.ndarray, two_sided: bool) -> np.ndarray:
    """Inner products of rows (``two_sided``: the larger one of a row's two sides) with the directions."""
    found = rows @ directions.T
    if two_sided:
        large, above = upper_sides(rows)
        if len(large):
            found[large] = np.maximum(found[large], above @ directions.T)
    return found


def simplex_minimum(cost: np.ndarray, rows: np.ndarray, usable: np.ndarray | None = None) -> tuple[float | None, np.ndarray | None]:
    """min cost·w over w ≥ 0, Σw = 1, rows·w ≥ 0, and the minimising w; (None, None) when infeasible.

    Works on the dual, max s subject to Σ λ_j rows_j + s·1 ≤ cost, where the start s = min(cost) is
    feasible. Unbounded there means infeasible here. Tiny unequal shifts of the cost keep ties, and with them
    cycles, away; they move the minimum by less than 1e-9. Of many rows only those join the programme that its
    solution violates, until it violates none: the basis stays feasible when columns join.
    """
    d = len(cost)
    shifted = cost + np.random.default_rng(d).uniform(0.0, 5e-10, size=d)
    if usable is not None and len(rows) <= PRICED:
        rows, usable = rows[usable], None
    waiting = None
    if len(rows) > PRICED:
        waiting = np.ones(len(rows), dtype=bool) if usable is None else usable.copy()
    # Columns of the dual: d slacks, then the rows; s itself never leaves the basis.
    columns = np.eye(d) if waiting is not None else np.vstack([np.eye(d), rows])
    lowest = int(np.argmin(shifted))
    basis = np.arange(d)
    level = lowest  # the basis place of s
    basis[lowest] = -1
    outside = np.ones(len(columns), dtype=bool)
    outside[basis[basis >= 0]] = False

    def factor() -> np.ndarray:
        matrix = columns[basis].T.copy()
        matrix[:, level] = 1.0
        return np.linalg.inv(matrix)

    inverse = factor()
    still = 0
    for step in range(50 * d + 10 * len(rows) + 200):
        if step % 50 == 49:
            inverse = factor()
        w = inverse[level]
        prices = np.where(outside, columns @ w, np.inf)
        # The most negative price enters; after a run of steps without progress the first one does.
        entering = int(np.argmin(prices)) if still < 20 else int(np.argmax(prices < -1e-11))
        if prices[entering] >= -1e-11:
            if waiting is not None:
                missed = np.where(waiting, rows @ w, np.inf)
                joining = np.argpartition(missed, JOINING)[:JOINING]
                joining = joining[missed[joining] < -1e-11]
                if len(joining):
                    waiting[joining] = False
                    columns = np.vstack([columns, rows[joining]])
                    outside = np.concatenate([outside, np.ones(len(joining), dtype=bool)])
                    still = 0
                    continue
            w = np.maximum(w, 0.0)
            w /= w.sum()
            return float(cost @ w), w
        direction = inverse @ columns[entering]
        can = direction > 1e-10
        can[level] = False
        if not can.any():
            return None, None
        values = np.maximum(inverse @ shifted, 0.0)
        ratios = np.full(d, np.inf)
        ratios[can] = values[can] / direction[can]
        tied = np.flatnonzero(ratios <= ratios.min() + 1e-13)
        leaving = tied[np.argmin(basis[tied])]
        still = still + 1 if ratios[leaving] <= 1e-13 else 0
        pivot = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, pivot)
        inverse[leaving] = pivot
        outside[basis[leaving]] = True
        outside[entering] = False
        basis[leaving] = entering
    raise ArithmeticError("the half-space programme did not converge")


def slack_basis(costs: np.ndarray) -> np.ndarray:
    """The start of ``simplex_minima``: every component's slack, and s (−1) in place of the one with the lowest cost."""
    bases = np.tile(np.arange(costs.shape[1]), (len(costs), 1))
    bases[np.arange(len(costs)), _shifted(costs).argmin(axis=1)] = -1
    return bases


def _shifted(costs: np.ndarray) -> np.ndarray:
    d = costs.shape[-1]
    return costs + np.random.default_rng(d).uniform(0.0, 5e-10, size=d)


def simplex_minima(costs: np.ndarray, rows: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``simplex_minimum`` of many costs, each on rows of its own: the minimising points, and which programmes are feasible.

    ``rows`` is programmes × rows × d; rows of zeros do not count. ``bases`` holds the columns each programme starts from (its d
    slacks, then its rows; −1 is s) and is overwritten with those it ends on: with more rows a programme goes on from there. The
    steps are those of one programme, taken by ``SIDE_BYTES`` of programmes at a time; one that ends makes room for the next.
    """
    n, d = costs.shape
    m = rows.shape[1]
    points, feasible = np.zeros((n, d)), np.zeros(n, dtype=bool)
    shifted, unit = _shifted(costs), np.eye(d)
    width = min(n, max(1, min(SIDES, SIDE_BYTES // (8 * d * (m + 2 * d)))))
    mine = np.arange(width)  # the programme of each place
    begun = width
    own, cost, basis = rows[mine], shifted[mine], bases[mine]
    inverse, values, update = np.empty((width, d, d)), np.empty((width, d)), np.empty((width, d, d))
    closed = np.zeros((width, d + m))  # infinite for columns of the basis, which do not enter
    level, still, steps, age = (np.zeros(width, dtype=np.int64) for _ in range(4))  # age: steps since the basis was factored

    def factor(at: np.ndarray) -> None:
        columns = basis[at]
        matrix = own[at[:, None], np.maximum(columns - d, 0)] if m else np.zeros((len(at), d, d))
        slacks = (columns >= 0) & (columns < d)
        matrix[slacks] = unit[columns[slacks]]
        matrix[columns < 0] = 1.0
        inverse[at] = np.linalg.inv(matrix.transpose(0, 2, 1))
        values[at] = np.maximum(np.matmul(inverse[at], cost[at][:, :, None])[:, :, 0], 0.0)
        age[at] = 0

    def begin(at: np.ndarray) -> None:
        columns = basis[at]
        level[at] = (columns < 0).argmax(axis=1)
        closed[at] = 0.0
        place, which = np.nonzero(columns >= 0)
        closed[at[place], columns[place, which]] = np.inf
        still[at] = steps[at] = 0
        factor(at)

    places = np.arange(width)
    begin(places)
    step = 0
    while len(places):
        step += 1
        if step % 100 == 0:
            factor(places)
        w = inverse[places, level]
        prices = np.concatenate([w, np.matmul(own, w[:, :, None])[:, :, 0]], axis=1)
        prices += closed
        # The most negative price enters; after a run of steps without progress the first one does.
        entering = prices.argmin(axis=1)
        if still.max() >= 20:
            for i in np.flatnonzero(still >= 20):
                entering[i] = int(np.argmax(prices[i] < -1e-11))
        ended = prices[places, entering] >= -1e-11
        if ended.any():
            # A programme ends on a basis factored lately.
            old = np.flatnonzero(ended & (age > 50))
            if len(old):
                factor(old)
                continue
            leave = np.flatnonzero(ended)
            w = np.maximum(w[leave], 0.0)
            points[mine[leave]], feasible[mine[leave]] = w / w.sum(axis=1)[:, None], True
        else:
            chosen = own[places, np.maximum(entering - d, 0)] if m else np.zeros((len(places), d))
            slacks = np.flatnonzero(entering < d)
            chosen[slacks] = unit[entering[slacks]]
            direction = np.matmul(inverse, chosen[:, :, None])[:, :, 0]
            can = direction > 1e-10
            can[places, level] = False
            ratios = np.divide(values, direction, out=np.full_like(values, np.inf), where=can)
            leaving = ratios.argmin(axis=1)
            size = ratios[places, leaving]
            leave = np.flatnonzero(size == np.inf)
            if not len(leave):
                tied = ratios <= size[:, None] + 1e-13
                if tied.sum() > len(places):
                    leaving = np.where(tied, basis, d + m).argmin(axis=1)
                    size = ratios[places, leaving]
                still = np.where(size <= 1e-13, still + 1, 0)
                values -= size[:, None] * direction
                np.maximum(values, 0.0, out=values)
                values[places, leaving] = size
                pivot = inverse[places, leaving] / direction[places, leaving][:, None]
                np.multiply(direction[:, :, None], pivot[:, None, :], out=update)
                inverse -= update
                inverse[places, leaving] = pivot
                closed[places, basis[places, leaving]] = 0.0
                closed[places, entering] = np.inf
                basis[places, leaving] = entering
                age += 1
                steps += 1
                if steps.max() > 50 * d + 10 * m + 200:
                    raise ArithmeticError("the half-space programme did not converge")
                continue
        bases[mine[leave]] = basis[leave]
        into = leave[: n - begun]
        if len(into):
            mine[into] = np.arange(begun, begun + len(into))
            begun += len(into)
            own[into], cost[into], basis[into] = rows[mine[into]], shifted[mine[into]], bases[mine[into]]
            begin(into)
        if len(into) < len(leave):
            stay = np.setdiff1d(places, leave[len(into) :])
            mine, own, cost, basis, inverse, values, closed = (a[stay] for a in (mine, own, cost, basis, inverse, values, closed))
            level, still, steps, age, places = level[stay], still[stay], steps[stay], age[stay], np.arange(len(stay))
            update = np.empty_like(inverse)
    return points, feasible


@dataclass(frozen=True)
class HalfSpaceTest:
    """Is row·w ≥ −slack implied on the simplex by −slack ≤ row·w ≤ bound for the basis rows?"""

    def exact(self, verdict: Verdict, size: float) -> bool:
        """Never: any further row may cut off the point where the minimum is."""
        return False

    def prove(self, rows: np.ndarray, spread: np.ndarray, basis: np.ndarray, n_columns: int) -> np.ndarray:
        """Rows without a component below −slack: the minimum over the simplex is the smallest component."""
        return rows.min(axis=1) >= -HALF_SPACE_SLACK

    def ready(self, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The half-spaces of the rows, those from above after them, as rows·w ≥ 0; and of which row each is."""
        large, above = upper_sides(basis)
        rows = np.vstack([basis, above]) + HALF_SPACE_SLACK if len(large) else basis + HALF_SPACE_SLACK
        # Long rows are shortened, which does not move their half-spaces, and so is a long cost.
        rows = rows / np.maximum(1.0, np.abs(rows).max(axis=1, initial=0.0))[:, None]
        return rows, np.concatenate([np.arange(len(basis)), large])

    def judge(self, y: np.ndarray, basis: np.ndarray, spread: float, n_columns: int, usable: np.ndarray | None = None) -> Verdict:
        return self.solve(y, self.ready(basis if usable is None else basis[usable])[0])

    def solve(self, y: np.ndarray, rows: np.ndarray, usable: np.ndarray | None = None) -> Verdict:
        """``judge`` on rows that ``ready`` made."""
        cost = y + HALF_SPACE_SLACK
        scale = max(1.0, float(np.abs(cost).max()))
        lowest, w = simplex_minimum(cost / scale, rows, usable)
        if lowest is None:
            return Verdict(False, np.nan, np.zeros(len(y)), np.inf)
        value = scale * lowest - HALF_SPACE_SLACK
        redundant = round(value, MIN_VALUE_DIGITS) >= -HALF_SPACE_SLACK
        return Verdict(redundant, value, -w, HALF_SPACE_SLACK + 1e-9)
