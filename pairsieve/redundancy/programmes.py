"""Half-space programmes of any number of rows, each on all the rows of a table that count for it.

The table is cut into pieces of bounded size, broadcast one by one. A task takes some targets, solves their programmes side by
side on the few rows that cut deepest against each, and then goes through the pieces, one in memory at a time: rows that a
solution violates join its programme, until no row of the table is violated. What a task holds does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import HALF_SPACE_SLACK, JOINING, MIN_VALUE_DIGITS, HalfSpaceTest
from .pricing import list_column, vectors

# Targets that one task solves; half-spaces looked at together; and bytes of the half-spaces in the programmes solved side by side.
TASK_ROWS, PART, WORKING_BYTES = 256, 4096, 40 << 20
# A half-space counts as no nearer to the middle of the simplex than this share of what half-spaces are on average.
NEAREST = 0.05
SOLVED = "_problem int, _g string, _key bigint, _vec array<double>, _spread double, _value double, _active array<bigint>"


class Pieces:
    """The rows of a table as broadcast pieces. ``_kept_by`` lists the problems for which a row counts for later rows, too."""

    def __init__(self, context: SparkContext, table: DataFrame, sizes: dict[str, int], d: int, piece_bytes: int):
        """``table`` has ``_g, _key, _vec, _kept_by``; without ``_kept_by`` every row counts for every other one."""
        room = max(1, piece_bytes // (8 * d))
        first, buckets, used = {}, {}, []
        for g, n in sorted(sizes.items()):
            # A group that does not fit into the last piece begins a new one; a large one fills several.
            if not used or used[-1] + n > room:
                used.append(0)
            first[g], buckets[g] = len(used) - 1, -(-n // room)
            used[-1] += n // buckets[g]
            used += [n // buckets[g]] * (buckets[g] - 1)
        self.sizes = sizes
        self.places = {g: range(first[g], first[g] + buckets[g]) for g in sizes}
        place = _by_group(first) + F.pmod(F.xxhash64("_key"), _by_group(buckets)).cast("int")
        self.shared = [self._piece(context, table.where(place == i) if len(used) > 1 else table, d) for i in range(len(used))]

    @staticmethod
    def _piece(context: SparkContext, table: DataFrame, d: int) -> Broadcast:
        found = table.toArrow()
        names, keys, vecs = found.column("_g").to_numpy(), found.column("_key").to_numpy(), vectors(found.column("_vec"), d)
        kept_by = found.column("_kept_by").to_pylist() if "_kept_by" in found.column_names else None
        out = {}
        codes, groups = pd.factorize(names)
        for c, g in enumerate(groups):
            rows = np.flatnonzero(codes == c)
            spaces, owner = HalfSpaceTest().ready(vecs[rows])
            marks = None
            if kept_by is not None:
                numbers = sorted({p for i in rows for p in kept_by[i] or ()})
                marks = {p: np.array([p in (kept_by[i] or ()) for i in rows], bool)[owner] for p in numbers}
            out[g] = keys[rows][owner], spaces, marks
        return context.broadcast(out)

    def discard(self) -> None:
        for piece in self.shared:
            piece.destroy()


def _by_group(values: dict[str, int]) -> Column:
    if len(set(values.values())) == 1:
        return F.lit(next(iter(values.values())))
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("_g"))


def _read(piece: Broadcast, keep: bool) -> dict:
    """The value of a broadcast, which the worker forgets unless it is to ``keep`` it."""
    path = getattr(piece, "_path", None)
    return piece.value if keep or not path else piece.load_from_path(path)


def solve_programmes(targets: DataFrame, pieces: Pieces, d: int, part: bool) -> DataFrame:
    """``SOLVED`` of ``targets``: the minimum of each (NaN where no point meets its constraints), and its active earlier rows.

    A row counts for targets before it, and for those after it if its ``_kept_by`` says so. The minimum stays what it is on any
    of these rows that the active ones are among. With ``part`` a row that some of them imply is not looked at further: its
    active rows imply it, but its minimum may be lower than it is on all of them.
    """
    tasks = max(targets.sparkSession.sparkContext.defaultParallelism, -(-targets.count() // TASK_ROWS))
    targets = targets.select("_problem", "_g", "_key", "_vec", "_spread")
    single = len(pieces.sizes) == 1
    dealt = targets.repartition(tasks) if single else targets.repartitionByRange(tasks, "_problem", "_key")
    return dealt.mapInArrow(_programme_task(pieces.shared, pieces.places, pieces.sizes, d, part), SOLVED)


def _programme_task(shared: list[Broadcast], places: dict[str, range], sizes: dict[str, int], d: int, part: bool):
    at_once = int(max(1, min(TASK_ROWS, WORKING_BYTES // (8 * d * 4 * d))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems, names = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            keys, vecs = batch.column(2).to_numpy(), vectors(batch.column(3), d)
            for number in np.unique(problems):
                mine = np.flatnonzero(problems == number)
                g = names[mine[0]]
                for rows in np.array_split(mine, -(-len(mine) // at_once)):
                    values, active = _Block(int(number), keys[rows], vecs[rows], sizes[g]).solve(lambda: _parts(shared, places[g], g), part)
                    columns = [*batch.take(pa.array(rows)).columns, pa.array(values), pa.array(active, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_value", "_active"])

    return run


def _parts(shared: list[Broadcast], places: range, g: str) -> Iterator[tuple]:
    """The group's half-spaces part by part: the number of the first, their rows' keys, themselves and where they count."""
    for place in places:
        piece = _read(shared[place], len(shared) == 1).get(g)
        if piece is None:
            continue
        keys, spaces, marks = piece
        for begin in range(0, len(keys), PART):
            some = slice(begin, begin + PART)
            yield (place << 40) + begin, keys[some], spaces[some], None if marks is None else {p: m[some] for p, m in marks.items()}


class _Block:
    """Targets of one problem and the half-spaces in their programmes."""

    def __init__(self, number: int, keys: np.ndarray, vecs: np.ndarray, n_rows: int):
        self.number, self.keys, self.n_rows = number, keys, n_rows
        n, d = vecs.shape
        costs = vecs + HALF_SPACE_SLACK
        self.scales = np.maximum(1.0, np.abs(costs).max(axis=1))
        self.costs = costs / self.scales[:, None]
        self.counts = np.zeros(n, dtype=np.int64)
        self.spaces = np.zeros((n, 0, d))
        self.ids, self.owners = np.zeros((n, 0), dtype=np.int64), np.zeros((n, 0), dtype=np.int64)

    def solve(self, parts, part: bool) -> tuple[np.ndarray, list[list[int]]]:
        n, d = self.costs.shape
        values, active = np.full(n, np.nan), [[] for _ in range(n)]
        everyone = np.arange(n)
        self._add(everyone, self._deepest(parts))
        bases = kernels.slack_basis(self.costs)
        left = everyone
        while len(left):
            m = self.counts[left].max()
            basis = bases[left]
            points, feasible = kernels.simplex_minima(self.costs[left], self.spaces[left, :m], basis)
            bases[left] = basis
            found = self.scales * np.einsum("ij,ij->i", self.costs, _placed(points, left, n)) - HALF_SPACE_SLACK
            values[left] = np.where(feasible, found[left], np.nan)
            # Where some rows leave no point, more rows do not either.
            going = feasible
            if part:
                going = going & ~(np.round(found[left], MIN_VALUE_DIGITS) >= -HALF_SPACE_SLACK)
            hits = self._violated(parts, left[going], points[going])
            self._add(left[going], hits)
            ended = np.ones(len(left), dtype=bool)
            ended[np.flatnonzero(going)[np.unique(hits[0])]] = False
            for t in left[ended & feasible]:
                rows = bases[t][bases[t] >= d] - d
                owners = np.unique(self.owners[t, rows])
                active[t] = owners[owners < self.keys[t]].tolist()
            left = left[~ended]
        return values, active

    def _usable(self, t: np.ndarray, r: np.ndarray, keys: np.ndarray, marks: dict | None) -> np.ndarray:
        """Which of the pairs of target and half-space count."""
        usable = keys[r] > self.keys[t]
        if marks is None:
            usable |= keys[r] < self.keys[t]
        elif self.number in marks:
            usable |= (keys[r] < self.keys[t]) & marks[self.number][r]
        return usable

    def _deepest(self, parts) -> tuple:
        """The half-spaces that, seen from the middle of the simplex, come first against each cost: about 5/2·d of a target.

        Which they are decides what the solution costs, never the solution.
        """
        n, d = self.costs.shape
        want = 5 * d // 2
        slopes = (self.costs - self.costs.mean(axis=1)[:, None]).astype(np.float32)
        hits, bound, floor = _Hits(n, want, d), None, None
        for begin, keys, spaces, marks in parts():
            depth = spaces.mean(axis=1)
            if floor is None:
                floor = max(NEAREST * float(np.abs(depth).mean()), 1e-12)
            scores = slopes @ (spaces / np.maximum(depth, floor)[:, None]).astype(np.float32).T
            if bound is None:
                # What so many of this part, the first, exceed, about so many of all in proportion do.
                some = min(len(keys), 1 + int(1.25 * want * len(keys) / max(self.n_rows, 1)))
                bound = np.partition(scores, len(keys) - some, axis=1)[:, len(keys) - some] if some < len(keys) else np.full(n, -np.inf)
            t, r = np.nonzero(scores >= bound[:, None])
            usable = self._usable(t, r, keys, marks)
            t, r = t[usable], r[usable]
            hits.take(t, scores[t, r], begin + r, keys[r], spaces, r)
        return hits.best()

    def _violated(self, parts, targets: np.ndarray, points: np.ndarray) -> tuple:
        """The half-spaces outside its programme that each solution violates most; targets by their place in ``targets``."""
        d = self.costs.shape[1]
        hits = _Hits(len(targets), JOINING, d)
        if not len(targets):
            return hits.best()
        # Half-spaces have components of 1 at most and points add up to 1: single precision is off by less than this.
        near = (d + 4) * float(np.finfo(np.float32).eps)
        coarse = points.astype(np.float32)
        for begin, keys, spaces, marks in parts():
            t, r = np.nonzero(coarse @ spaces.astype(np.float32).T < near)
            usable = self._usable(targets[t], r, keys, marks)
            t, r = t[usable], r[usable]
            if len(t) > len(targets) * len(keys) // 64:
                prices = (points @ spaces.T)[t, r]
            else:
                prices = np.einsum("ij,ij->i", points[t], spaces[r])
            low = np.flatnonzero(prices < -1e-11)
            if len(low):
                # Those of the programme are violated by rounding only.
                low = low[~self._inside(targets, t[low], begin + r[low])]
                t, r = t[low], r[low]
                hits.take(t, -prices[low], begin + r, keys[r], spaces, r)
        return hits.best()

    def _inside(self, targets: np.ndarray, t: np.ndarray, ids: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(t), dtype=bool)
        for i in np.unique(t):
            at = np.flatnonzero(t == i)
            inside[at] = np.isin(ids[at], self.ids[targets[i], : self.counts[targets[i]]])
        return inside

    def _add(self, targets: np.ndarray, hits: tuple) -> None:
        """Put half-spaces (place in ``targets``, id, owner, space), sorted by place, into the programmes of the targets."""
        t, ids, owners, spaces = hits
        if not len(t):
            return
        at = targets[t]
        place = self.counts[at] + np.arange(len(t)) - np.searchsorted(t, t)
        self.counts[targets] += np.bincount(t, minlength=len(targets))
        more = int(place.max()) + 1 - self.spaces.shape[1]
        if more > 0:
            n, _, d = self.spaces.shape
            self.spaces = np.concatenate([self.spaces, np.zeros((n, more, d))], axis=1)
            self.ids = np.concatenate([self.ids, np.full((n, more), -1)], axis=1)
            self.owners = np.concatenate([self.owners, np.zeros((n, more), dtype=np.int64)], axis=1)
        self.ids[at, place], self.owners[at, place], self.spaces[at, place] = ids, owners, spaces


def _placed(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, points.shape[1]))
    out[at] = points
    return out


class _Hits:
    """Half-spaces found for targets, of which the ``most`` best of each target stay."""

    def __init__(self, n: int, most: int, d: int):
        self.most, self.limit, self.pending = most, 2 * n * most, 0
        self.found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, d)))]

    def take(self, t: np.ndarray, scores: np.ndarray, ids: np.ndarray, owners: np.ndarray, spaces: np.ndarray, r: np.ndarray) -> None:
        if len(t) > self.limit:
            stay = self._first(t, scores)
            t, scores, ids, owners, r = t[stay], scores[stay], ids[stay], owners[stay], r[stay]
        self.found.append((t, scores, ids, owners, spaces[r]))
        self.pending += len(t)
        if self.pending > self.limit:
            self._prune()

    def _first(self, t: np.ndarray, scores: np.ndarray) -> np.ndarray:
        order = np.lexsort((-scores, t))
        return order[np.arange(len(t)) - np.searchsorted(t[order], t[order]) < self.most]

    def _prune(self) -> None:
        t, scores, ids, owners, spaces = (np.concatenate(column) for column in zip(*self.found))
        stay = self._first(t, scores)
        self.found = [(t[stay], scores[stay], ids[stay], owners[stay], spaces[stay])]
        self.pending = len(stay)

    def best(self) -> tuple:
        """Target, id, owner and half-space, by target."""
        self._prune()
        t, _, ids, owners, spaces = self.found[0]
        return t, ids, owners, spaces
