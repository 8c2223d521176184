"""Greedy redundancy in row order, found by a bounded number of Spark jobs.

Row i is tested against all later rows and the earlier rows kept so far. More basis rows can only improve a
fit, which gives four exact steps:

1. *Tail.* The last few rows of a group are later than every row before them. If non-negative combinations
   of the tail reach every direction, all rows before it are redundant and no fit is needed.
2. *Screen.* Otherwise each remaining row is tested, inside its own task, against the tail and against later
   rows of its own batch. Passing proves redundancy; the survivors are few and are screened again among
   themselves.
3. *Resolve.* Survivors are decided in row order, a block at a time. Each is solved on a small working set;
   one scan of all rows then looks for rows that would change a solution. A solution that no row can change
   is exact.
4. *Finish.* The tail is a last block, resolved the same way; all its basis rows are known, so no scan is needed.

Half-spaces are decided all at once, not block after block: a redundant row does not move the others' common part, so nearly
every row is settled by a programme on all other rows: kept where these do not imply it, redundant where its active rows are later
or kept ones; and the minimum there is its value.

Decisions only need part of a basis; the fit value of a row needs all of it. A last pass fits every row, in its own task,
on the later and the kept rows, and scans for rows that would improve the fits that are not exact yet.

With coefficients of any sign the last linearly independent rows decide everything, and they combine like
a sum: per task, then in a two-level merge.

What is held in memory is bounded by the number of tail, block and component counts, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import discard, materialise, scratch_path
from . import kernels, pricing
from .kernels import ConeTest, HalfSpaceTest, SpanTest
from .programmes import Pieces, solve_programmes

# Rows whose centred sum of squares is smaller are fitted even when the tail reaches every direction.
SPREAD_FLOOR = 1e-4
# Vectors of kept rows held on the driver per problem; beyond this the scan looks among kept rows too.
KEPT_IN_MEMORY = 2048
# Best rows a scan returns per target: few for many targets, more for few.
LANES = (4, 64)
SCAN_HITS = 2048
MERGE_SLOTS = 256
TAIL_BYTES = 256 << 20
FLUSH_ROWS = 50_000
# A table this small may sit in one file; its rows are spread over the cores before costly per-row work.
SMALL_TABLE = 100_000
SCREEN_ROUNDS = 12
# Rows of a block that one task decides one after another, while other tasks judge the rest: so many at least, more where
# fits are cheap (multiplications of a pass over the known rows, added up over the run).
RUN_ROWS, RUN_WORK = 32, 1 << 23
# A unit row that its fit misses by less is fitted exactly: no further row can improve it.
EXACT = 1e-9
# Rows that a task holds at a time while it solves half-space programmes: as many as fit these bytes.
PROGRAMME_BYTES = 16 << 20
LOWEST_KEY = -(1 << 63)
GONE, KEPT, OPEN = 0, 1, 2  # states of a known row as seen by later targets
HIGHEST_KEY = (1 << 63) - 1

VECTOR_ROW = "_problem int, _key bigint, _vec array<double>, _spread double"


@dataclass(frozen=True)
class Spec:
    """One way to test: solver ``nnls``, ``lstsq`` or ``linprog``; by ``r2`` or ``res``; R² threshold."""

    solver: str = "nnls"
    solve_by: str = "r2"
    threshold: float = 0.95

    def __post_init__(self):
        if self.solver not in ("nnls", "lstsq", "linprog"):
            raise ValueError(f"unknown solver {self.solver!r}")
        if self.solve_by not in ("r2", "res"):
            raise ValueError(f"solve_by must be 'r2' or 'res', not {self.solve_by!r}")

    @property
    def test(self):
        if self.solver == "linprog":
            return HalfSpaceTest()
        kind = ConeTest if self.solver == "nnls" else SpanTest
        return kind(self.solve_by, self.threshold)


@dataclass
class Target:
    key: int
    vec: np.ndarray
    spread: float
    later: int = 0
    redundant: bool | None = None


@dataclass
class Problem:
    """One group under one spec, with what the driver holds of it."""

    number: int
    group: str
    index: int
    spec: Spec
    test: object
    fixed: np.ndarray
    tail_keys: np.ndarray
    tail: np.ndarray
    tail_spread: np.ndarray
    covered: bool = False
    feasible: bool = True
    later: np.ndarray | None = None  # fitted rows after each tail row, where that is not just the tail
    kept_keys: list[int] = field(default_factory=list)
    kept: list[np.ndarray] = field(default_factory=list)
    n_kept: int = 0
    cursor: int | None = None
    block: list[Target] = field(default_factory=list)
    hits: dict[int, np.ndarray] = field(default_factory=dict)  # rows scans found useful for the block
    kept_hits: set[int] = field(default_factory=set)  # those of them that were kept
    kept_tail: set[int] = field(default_factory=set)
    open_tail: set[int] | None = None  # tail rows still open, where that is not all of them

    @property
    def overflow(self) -> bool:
        return self.n_kept > len(self.kept)

    def keep(self, key: int, vec: np.ndarray) -> None:
        self.n_kept += 1
        if self.in_tail(key):
            self.kept_tail.add(key)
        if len(self.kept) < KEPT_IN_MEMORY:
            self.kept_keys.append(key)
            self.kept.append(vec)

    def in_tail(self, key: int) -> bool:
        return len(self.tail_keys) > 0 and bool(np.any(self.tail_keys == key))

    def known_keys(self) -> set[int]:
        return {int(k) for k in self.tail_keys} | set(self.hits) | set(self.kept_keys) | {t.key for t in self.block}

    def working_set(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, rows and states of all basis rows the driver knows besides the fixed ones.

        A row counts for targets before it; for targets after it when KEPT, and possibly when OPEN.
        """
        known: dict[int, tuple[np.ndarray, int]] = {}
        for key, vec in zip(self.tail_keys, self.tail):
            known[int(key)] = (vec, KEPT if int(key) in self.kept_tail else GONE)
        first = self.block[0].key if self.block else HIGHEST_KEY
        for key, vec in self.hits.items():
            # Scans return rows before the block only if they were kept.
            known[key] = (vec, KEPT if key < first or key in self.kept_hits else GONE)
        for key, vec in zip(self.kept_keys, self.kept):
            known[key] = (vec, KEPT)
        for t in self.block:
            known[t.key] = (t.vec, {None: OPEN, True: GONE, False: KEPT}[t.redundant])
        keys = np.array(list(known), dtype=np.int64)
        vecs = np.array([v for v, _ in known.values()]).reshape(-1, self.tail.shape[1])
        return keys, vecs, np.array([state for _, state in known.values()], dtype=np.int8)


# ---------------------------------------------------------------- Arrow helpers


def _arrays(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group names, keys, vectors and spreads of a batch with columns _g, _key, _vec, _spread."""
    n = batch.num_rows
    vec = batch.column(batch.schema.get_field_index("_vec")).flatten().to_numpy(zero_copy_only=False)
    return (
        batch.column(batch.schema.get_field_index("_g")).to_numpy(zero_copy_only=False),
        batch.column(batch.schema.get_field_index("_key")).to_numpy(zero_copy_only=False),
        np.ascontiguousarray(vec.reshape(n, d), dtype=np.float64),
        batch.column(batch.schema.get_field_index("_spread")).to_numpy(zero_copy_only=False),
    )


def _groups_in(names: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    codes, uniques = pd.factorize(names)
    if len(uniques) == 1:
        yield uniques[0], np.arange(len(names))
        return
    for c, name in enumerate(uniques):
        yield name, np.flatnonzero(codes == c)


def _vector_column(vectors: np.ndarray) -> pa.Array:
    n, d = vectors.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)))


def _vector_rows(problem: int, keys: np.ndarray, vectors: np.ndarray, spreads: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(keys), problem, dtype=np.int32)),
            pa.array(keys.astype(np.int64)),
            _vector_column(vectors),
            pa.array(spreads.astype(np.float64)),
        ],
        names=["_problem", "_key", "_vec", "_spread"],
    )


# ---------------------------------------------------------------- work inside tasks


def survivors_of(test, keys: np.ndarray, vecs: np.ndarray, spreads: np.ndarray, pool: np.ndarray, n_pool: int, cap: int) -> np.ndarray:
    """Positions of rows that neither the pool nor later rows of the batch prove redundant."""

    def proven(rows: np.ndarray, basis: np.ndarray, n_columns: int) -> np.ndarray:
        return test.prove(vecs[rows], spreads[rows], basis, n_columns)

    rest = np.argsort(-keys, kind="stable")
    rest = rest[~proven(rest, pool, n_pool)]
    local: list[int] = []
    while len(rest) and len(local) < cap:
        head, rest = rest[:32], rest[32:]
        before = len(local)
        for i in head:
            basis = np.vstack([pool, vecs[local]]) if local else pool
            if not test.judge(vecs[i], basis, spreads[i], n_pool + len(local)).redundant:
                local.append(int(i))
        if len(local) > before and len(rest):
            rest = rest[~proven(rest, np.vstack([pool, vecs[local]]), n_pool + len(local))]
    return np.array(local + rest.tolist(), dtype=np.int64)


def decide_run(test, fixed: np.ndarray, known: tuple, n_kept: int, targets: list[tuple]) -> list[tuple[bool, float]]:
    """Decide bounded rows one after another, all rows before the first of them being decided.

    Exact only where ``known`` holds every row of the problem that can matter.
    """
    keys, rows, states = known[0], known[1], known[2].copy()
    basis = np.vstack([fixed, rows])
    always = np.ones(len(fixed), dtype=bool)
    out = []
    for key, vec, spread, later in targets:
        usable = (keys > key) | ((states == KEPT) & (keys < key))
        verdict = test.judge(vec, basis, spread, later + n_kept, np.concatenate([always, usable]))
        states[keys == key] = GONE if verdict.redundant else KEPT
        n_kept += not verdict.redundant
        out.append((bool(verdict.redundant), float(verdict.value)))
    return out


def judge_between(test, fixed: np.ndarray, known: tuple, n_kept: int, key: int, vec: np.ndarray, spread: float, later: int):
    """(redundant, final, verdict) of one target while earlier rows are still open.

    Without the open rows the basis is at most the true one: redundant there is redundant. With them it is at
    least the true one: not redundant there, and no row of the table that changes it, is not redundant.
    """
    keys, rows, states = known
    certain = (keys > key) | ((states == KEPT) & (keys < key))
    open_before = (states == OPEN) & (keys < key)
    basis = np.vstack([fixed, rows])
    always = np.ones(len(fixed), dtype=bool)
    low = test.judge(vec, basis, spread, later + n_kept, np.concatenate([always, certain]))
    if low.redundant or not open_before.any():
        return low.redundant, not low.redundant, low
    high = test.judge(vec, basis, spread, later + n_kept + int(open_before.sum()), np.concatenate([always, certain | open_before]))
    return (False, False, low) if high.redundant else (False, True, high)


def _solve_task(table, tests: dict[int, object]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                number, positions, targets = table.value["targets"][i]
                fixed, known, n_kept = table.value["problems"][number]
                if len(positions) > 1:
                    done = decide_run(tests[number], fixed, known, n_kept, targets)
                    out += [(number, p, redundant, not redundant, [], np.inf) for p, (redundant, _) in zip(positions, done)]
                    continue
                redundant, final, v = judge_between(tests[number], fixed, known, n_kept, *targets[0])
                out.append((number, positions[0], bool(redundant), bool(final), v.direction.tolist(), float(v.limit)))
            yield pd.DataFrame(out, columns=["_problem", "_position", "_redundant", "_final", "_direction", "_limit"])

    return run


def _value_task(problems, tests: dict[int, object], d: int):
    """The fit of each row on the later and kept rows of a pool. ``_settled``: no row outside the pool can change it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names, keys, vecs, spreads = _arrays(batch, d)
            for name, rows in _groups_in(names):
                for number, fixed, pool_keys, pool, kept, complete in problems.value.get(name, ()):
                    basis, always = np.vstack([fixed, pool]), np.ones(len(fixed), dtype=bool)
                    values, settled = np.empty(len(rows)), np.empty(len(rows), dtype=bool)
                    for at, i in enumerate(rows):
                        usable = (pool_keys > keys[i]) | (kept & (pool_keys < keys[i]))
                        v = tests[number].judge(vecs[i], basis, spreads[i], 0, np.concatenate([always, usable]))
                        values[at] = v.value
                        settled[at] = complete or tests[number].exact(v, EXACT)
                    yield pa.RecordBatch.from_arrays(
                        [*_vector_rows(number, keys[rows], vecs[rows], spreads[rows]).columns, pa.array(values), pa.array(settled)],
                        names=["_problem", "_key", "_vec", "_spread", "_value", "_settled"],
                    )

    return run


def _screen_task(problems, tests: dict[int, object], d: int, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names, keys, vecs, spreads = _arrays(batch, d)
            for name, rows in _groups_in(names):
                for number, pool, n_pool, below, floor in problems.value.get(name, ()):
                    mine = rows[(keys[rows] < below) & (spreads[rows] < floor)]
                    if len(mine) == 0:
                        continue
                    found = survivors_of(tests[number], keys[mine], vecs[mine], spreads[mine], pool, n_pool, cap)
                    left = mine[found]
                    if len(left):
                        yield _vector_rows(number, keys[left], vecs[left], spreads[left])

    return run


def _scan_task(targets, d: int, lanes: int, two_sided: bool):
    """Best row per (target, lane) among rows that would change the target's solution."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names, keys, vecs, _ = _arrays(batch, d)
            kept_by = None
            if "_kept_by" in batch.schema.names:
                kept_by = batch.column(batch.schema.get_field_index("_kept_by")).to_pylist()
            for name, rows in _groups_in(names):
                if name not in targets.value:
                    continue
                numbers, positions, tkeys, directions, limits = targets.value[name]
                scores = kernels.gains(vecs[rows], directions, two_sided)
                own = keys[rows]
                eligible = own[:, None] > tkeys[None, :]
                if kept_by is not None:
                    for r, i in enumerate(rows):
                        if kept_by[i]:
                            eligible[r] |= np.isin(numbers, kept_by[i]) & (own[r] < tkeys)
                scores = np.where(eligible & (scores > limits[None, :]), scores, -np.inf)
                if name not in best:
                    shape = (lanes, len(tkeys))
                    best[name] = (np.full(shape, -np.inf), np.zeros(shape, np.int64), np.zeros((*shape, d)))
                top, top_key, top_vec = best[name]
                lane_of = own % lanes
                for lane in range(lanes):
                    members = np.flatnonzero(lane_of == lane)
                    if len(members) == 0:
                        continue
                    pick = scores[members].argmax(axis=0)
                    value = scores[members[pick], np.arange(len(tkeys))]
                    better = value > top[lane]
                    chosen = rows[members[pick[better]]]
                    top[lane, better] = value[better]
                    top_key[lane, better] = keys[chosen]
                    top_vec[lane, better] = vecs[chosen]
        for name, (top, top_key, top_vec) in best.items():
            numbers, positions, *_ = targets.value[name]
            lane, t = np.nonzero(np.isfinite(top))
            if len(lane):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers[t].astype(np.int32)),
                        pa.array(positions[t].astype(np.int32)),
                        pa.array(lane.astype(np.int32)),
                        pa.array(top[lane, t]),
                        pa.array(top_key[lane, t]),
                        _vector_column(top_vec[lane, t]),
                    ],
                    names=["_problem", "_position", "_lane", "_score", "_key", "_vec"],
                )

    return run


def _count_task(targets):
    """How many rows of the task come after each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for name, rows in _groups_in(names) if len(names) else ():
                if name in targets.value:
                    own = np.sort(keys[rows])
                    n = len(own) - np.searchsorted(own, targets.value[name], side="right")
                    totals[name] = totals.get(name, 0) + n
        for name, n in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(n)),
                    pa.array(targets.value[name].astype(np.int64)),
                    pa.array(np.asarray(n).astype(np.int64)),
                ],
                names=["_g", "_key", "_n"],
            )

    return run


def _edge_task(count: int, last: bool):
    """The ``count`` largest (``last``) or smallest keys of each group of the task; columns group, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for name, rows in _groups_in(names) if len(names) else ():
                own = np.sort(np.concatenate([held.get(name, keys[:0]), keys[rows]]))
                held[name] = own[-count:] if last else own[:count]
        for name, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), batch.schema.field(0).type), pa.array(own)], schema=batch.schema)

    return run


def _pivot_task(spans, d: int):
    """The last independent rows of the task, beyond what each group's tail already spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names, keys, vecs, spreads = _arrays(batch, d)
            for name, rows in _groups_in(names):
                span = spans.value.get(name)
                if span is None:
                    continue
                k, v, s = keys[rows], vecs[rows], spreads[rows]
                if name in held:
                    k, v, s = (np.concatenate(pair) for pair in zip(held[name], (k, v, s)))
                pick = kernels.last_independent(k, v, span)
                held[name] = (k[pick], v[pick], s[pick])
        for name, (k, v, s) in held.items():
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(k)), pa.array(k), _vector_column(v), pa.array(s)],
                    names=["_g", "_key", "_vec", "_spread"],
                )

    return run


def constant_rows(plus: bool, minus: bool, d: int) -> np.ndarray:
    """Constant non-zero rows are always kept, so their directions are in every basis."""
    unit = np.full(d, 1.0 / np.sqrt(d))
    return np.array(([unit] if plus else []) + ([-unit] if minus else [])).reshape(-1, d)


# ---------------------------------------------------------------- driver


def _per_group(values: dict) -> Column:
    """A literal that depends on the row's group."""
    if len(set(values.values())) == 1:
        return F.lit(next(iter(values.values())))
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("_g"))


def _per_number(values: dict[str, int]) -> Column:
    """A literal that depends on the row's problem."""
    pairs = [F.lit(x) for number, value in values.items() for x in (int(number), value)]
    return F.try_element_at(F.create_map(*pairs), F.col("_problem"))


def _per_group_of(groups: dict[int, str]) -> Column:
    """The group of the row's problem."""
    pairs = [F.lit(x) for item in groups.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("_problem"))


class Sieve:
    """Decisions for one set of groups. ``rows`` has _g, _key, _vec, _spread, _kind ('fit', 'drop', 'keep')."""

    def __init__(self, rows: DataFrame, specs: Sequence[Spec], groups: dict[str, dict], d: int, tail_rows: int, block_rows: int):
        self.rows = rows
        self.spark: SparkSession = rows.sparkSession
        self.specs = list(specs)
        self.two_sided = any(s.solver == "linprog" for s in specs)
        self.groups = groups
        self.d = d
        self.tail_rows = tail_rows
        self.block_rows = block_rows
        self.fit_rows = rows.where(F.col("_kind") == "fit").select("_g", "_key", "_vec", "_spread")
        self._units: DataFrame | None = None
        self._pending: list[tuple] = []
        self._flushed: str | None = None
        self._kept_path: str | None = None
        self._fresh: list[tuple] = []  # kept rows not yet written
        self._kept_at_once: list[DataFrame] = []
        self._solved: list[DataFrame] = []  # rows whose programme was solved on at least the final basis

    # -- tail

    def _edge_keys(self, source: DataFrame, by: str, count: int, last: bool, single: bool) -> dict:
        """Per value of ``by``: the ``count``-th largest key (``last``) or smallest key. Reads keys only."""
        order = F.desc("_key") if last else F.asc("_key")
        narrow = source.select(by, "_key")
        if single:
            edge = narrow.orderBy(order).limit(count)
        else:
            # Each task keeps its own edge first, so that no group is sorted whole.
            edges = narrow.mapInArrow(_edge_task(count, last), narrow.schema)
            rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
            edge = edges.withColumn("_r", rank).where(F.col("_r") <= count)
        found = edge.groupBy(by).agg((F.min if last else F.max)("_key").alias("_k")).collect()
        return {r[by]: r["_k"] for r in found}

    def _collect_tails(self) -> dict[str, tuple]:
        """The last ``tail_rows`` fitted rows of each group, in key order."""
        tails: dict[str, tuple] = {}
        # Keys alone find the tail; the vectors are then read for that key range only. Where the range holds
        # too few fitted rows, a second look considers fitted rows only.
        for source, reach in ((self.rows, 2 * self.tail_rows), (self.fit_rows, self.tail_rows)):
            open_groups = [g for g in self.groups if g not in tails]
            if not open_groups:
                break
            chosen = source if len(open_groups) == len(self.groups) else source.where(F.col("_g").isin(open_groups))
            cuts = self._edge_keys(chosen, "_g", reach, True, len(self.groups) == 1)
            if not cuts:
                break
            wanted = self.fit_rows.where(F.col("_key") >= _per_group(cuts))
            if len(open_groups) < len(self.groups):
                wanted = wanted.where(F.col("_g").isin(open_groups))
            found = wanted.toArrow()
            names, keys, vecs, spreads = (
                _arrays(found.combine_chunks().to_batches()[0], self.d)
                if found.num_rows
                else (np.array([]), np.array([], np.int64), np.zeros((0, self.d)), np.array([]))
            )
            for name, rows in _groups_in(names) if len(names) else ():
                order = rows[np.argsort(keys[rows])][-self.tail_rows :]
                if len(order) == min(self.tail_rows, self.groups[name]["n_fit"]):
                    tails[name] = (keys[order], vecs[order], spreads[order])
        empty = (np.array([], np.int64), np.zeros((0, self.d)), np.array([]))
        return {g: tails.get(g, empty) for g in self.groups}

    # -- state on shared storage

    @property
    def units(self) -> DataFrame:
        """Fitted rows, which scans read several times: written once, unless the rows are a stored table anyway."""
        if self._units is None:
            self._units = self.fit_rows if self.rows.inputFiles() else materialise(self.fit_rows, "units")
        return self._units

    def _decide(self, problem: Problem, key: int, redundant: bool) -> None:
        self._pending.append((problem.group, problem.index, int(key), bool(redundant)))
        if len(self._pending) >= FLUSH_ROWS:
            self._flushed = self._flushed or scratch_path(self.spark, "decisions")
            self._frame(self._pending).write.mode("append").parquet(self._flushed)
            self._pending = []

    DECISION = "_g string, _s int, _key bigint, _redundant boolean"
    VALUE = "_g string, _s int, _key bigint, _value double"

    def _frame(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, self.DECISION)

    # -- run

    def run(self, values: bool = True) -> tuple[DataFrame, DataFrame, list[Problem]]:
        """Decisions, fit values of all fitted rows (none without ``values``), and the problems."""
        tails = self._collect_tails()
        problems: list[Problem] = []
        for name, facts in self.groups.items():
            for s, spec in enumerate(self.specs):
                keys, vecs, spreads = tails[name]
                problems.append(
                    Problem(len(problems), name, s, spec, spec.test, facts["fixed"], keys, vecs, spreads)
                )
        spans = [p for p in problems if p.spec.solver == "lstsq"]
        others = [p for p in problems if p.spec.solver != "lstsq"]
        if spans:
            self._reduce_to_pivots(spans)
        if others:
            self._check_tails(others)
            halves = [p for p in others if p.feasible and isinstance(p.test, HalfSpaceTest)]
            cones = [p for p in others if isinstance(p.test, ConeTest)]
            for chosen, narrowed in ((halves, partial(self._settle_half_spaces, values=values)), (cones, self._screen)):
                survivors = narrowed(chosen) if chosen else None
                if survivors is not None:
                    self._resolve(chosen, survivors)
                    discard(survivors)
        feasible = [p for p in problems if p.feasible]
        self._finish(feasible)
        found = self.spark.createDataFrame([], self.VALUE)
        for chosen, valued in (
            ([p for p in feasible if isinstance(p.test, HalfSpaceTest)], self._half_space_values),
            ([p for p in feasible if not isinstance(p.test, HalfSpaceTest)], self._values),
        ):
            if values and chosen:
                found = found.unionByName(valued(chosen))
        return self._decisions(), found, problems

    def _decisions(self) -> DataFrame:
        frame = self._frame(self._pending)
        if self._flushed:
            frame = frame.unionByName(self.spark.read.schema(self.DECISION).parquet(self._flushed))
        for kept in self._kept_at_once:
            frame = frame.unionByName(kept.select("_g", "_s", "_key", F.lit(False).alias("_redundant")))
        return frame

    # -- coefficients of any sign

    def _reduce_to_pivots(self, problems: list[Problem]) -> None:
        by_group: dict[str, list[Problem]] = {}
        for p in problems:
            by_group.setdefault(p.group, []).append(p)
        open_spans: dict[str, np.ndarray] = {}
        begins: dict[str, int] = {}
        later_counts: dict[str, dict[int, int]] = {}
        for name, mine in by_group.items():
            keys, tail, spread = mine[0].tail_keys, mine[0].tail, mine[0].tail_spread
            pick = kernels.last_independent(keys, tail)
            later_counts[name] = {int(k): len(keys) - 1 - i for i, k in enumerate(keys)}
            for p in mine:
                p.tail_keys, p.tail, p.tail_spread = keys[pick], tail[pick], spread[pick]
            if len(pick) < self.d and self.groups[name]["n_fit"] > len(keys):
                open_spans[name] = kernels.orthonormal(tail[pick])
                begins[name] = int(keys[0])
        found: dict[str, tuple] = {}
        if open_spans:
            spans = self.spark.sparkContext.broadcast(open_spans)
            source = self.fit_rows.where(F.col("_g").isin(list(open_spans)) & (F.col("_key") < _per_group(begins)))
            shape = "_g string, _key bigint, _vec array<double>, _spread double"
            task = _pivot_task(spans, self.d)
            slot = F.pmod(F.xxhash64("_key"), F.lit(MERGE_SLOTS))
            merged = (
                source.mapInArrow(task, shape)
                .repartition(slot)
                .mapInArrow(task, shape)
                .repartition("_g")
                .mapInArrow(task, shape)
            )
            table = merged.toArrow()
            if table.num_rows:
                names, keys, vecs, spreads = _arrays(table.combine_chunks().to_batches()[0], self.d)
                # Merging has left at most d rows per group and task; a group may still sit in two tasks.
                for name, rows in _groups_in(names):
                    pick = rows[kernels.last_independent(keys[rows], vecs[rows], open_spans[name])]
                    found[name] = (keys[pick], vecs[pick], spreads[pick])
        for name, (keys, vecs, spreads) in found.items():
            for p in by_group[name]:
                p.tail_keys = np.concatenate([p.tail_keys, keys])
                p.tail = np.vstack([p.tail, vecs])
                p.tail_spread = np.concatenate([p.tail_spread, spreads])
        if found and any(p.spec.solve_by == "res" for p in problems):
            counted = self._count_later({g: np.sort(keys) for g, (keys, _, _) in found.items()})
            for name, counts in counted.items():
                later_counts[name].update(counts)
        for p in problems:
            p.later = np.array([later_counts[p.group].get(int(k), 0) for k in p.tail_keys], dtype=np.int64)

    def _count_later(self, keys: dict[str, np.ndarray]) -> dict[str, dict[int, int]]:
        """Per group and key: how many fitted rows come after it."""
        targets = self.spark.sparkContext.broadcast(keys)
        counted = (
            self.fit_rows.select("_g", "_key")
            .mapInArrow(_count_task(targets), "_g string, _key bigint, _n bigint")
            .groupBy("_g", "_key")
            .agg(F.sum("_n").alias("_n"))
            .collect()
        )
        out: dict[str, dict[int, int]] = {g: {} for g in keys}
        for r in counted:
            out[r["_g"]][r["_key"]] = r["_n"]
        return out

    # -- non-negative coefficients and half-spaces

    def _check_tails(self, problems: list[Problem]) -> None:
        for p in problems:
            if isinstance(p.test, ConeTest):
                pool = np.vstack([p.fixed, p.tail])
                if p.spec.solve_by == "res":
                    accuracy = 0.5e-8 * np.sqrt(max(len(p.tail), 1))
                else:
                    accuracy = min(1e-6, 0.5 * np.sqrt(max(1.0 - p.spec.threshold, 0.0) * SPREAD_FLOOR))
                p.covered = accuracy > 0 and kernels.spans_everything(pool, accuracy)
        self._check_feasible([p for p in problems if isinstance(p.test, HalfSpaceTest)])

    def _check_feasible(self, problems: list[Problem]) -> None:
        """Half-space problems whose constraints no point of the simplex meets: there no row is redundant.

        Redundant rows do not change the feasible set, so it is that of all rows throughout.
        """
        waiting = list(problems)
        while waiting:
            asked = []
            for p in list(waiting):
                rows = np.vstack([p.tail, *p.hits.values()])
                # Any cost will do; an uneven one keeps the programme free of ties.
                v = p.test.judge(np.linspace(1.0, 2.0, self.d), rows, 0.0, 0)
                if v.limit == np.inf:
                    p.feasible = False
                    waiting.remove(p)
                elif self.groups[p.group]["n_fit"] <= len(p.tail):
                    waiting.remove(p)
                else:
                    asked.append((p, 0, LOWEST_KEY, v.direction, v.limit))
            changed = {number for number, _ in self.scan(asked)} if asked else set()
            waiting = [p for p in waiting if p.number in changed]
        for p in problems:
            p.hits = {}

    def _screen(self, problems: list[Problem]) -> DataFrame | None:
        """Rows before the tails that no cheap proof shows redundant: (_problem, _key, _vec, _spread)."""
        wanted = [
            p
            for p in problems
            if self.groups[p.group]["n_fit"] > len(p.tail_keys) and not (p.covered and self.groups[p.group]["n_low"] == 0)
        ]
        if not wanted:
            return None
        first = {p.group: int(p.tail_keys[0]) if len(p.tail_keys) else HIGHEST_KEY for p in wanted}
        source = self.fit_rows.where(F.col("_g").isin(list(first)) & (F.col("_key") < _per_group(first)))
        open_groups = {p.group for p in wanted if not p.covered}
        if not open_groups:
            source = source.where(F.col("_spread") < SPREAD_FLOOR)
        elif open_groups != set(first):
            source = source.where(F.col("_g").isin(list(open_groups)) | (F.col("_spread") < SPREAD_FLOOR))
        table: dict[str, list] = {}
        for p in wanted:
            pool = np.vstack([p.fixed, p.tail])
            floor = SPREAD_FLOOR if p.covered else np.inf
            table.setdefault(p.group, []).append((p.number, pool, len(p.tail), first[p.group], floor))
        shared = self.spark.sparkContext.broadcast(table)
        tests = {p.number: p.test for p in wanted}
        cap = 4 * self.d
        if sum(self.groups[g]["n_fit"] for g in first) <= SMALL_TABLE:
            source = source.repartition(self.spark.sparkContext.defaultParallelism)
        survivors = materialise(source.mapInArrow(_screen_task(shared, tests, self.d, cap), VECTOR_ROW), "survivors")

        # Survivors are screened among themselves, in ever fewer and larger batches, while that removes many.
        counts = self._survivor_counts(survivors)
        for _ in range(SCREEN_ROUNDS):
            n = sum(counts.values())
            if n <= self.block_rows or max(counts.values()) <= self.block_rows:
                break
            again = self._screen_again(survivors, wanted, n)
            fewer = self._survivor_counts(again)
            shrunk = sum(fewer.values()) < 0.8 * n
            discard(survivors)
            survivors, counts = again, fewer
            if not shrunk:
                break
        return survivors if counts else None

    def _survivor_counts(self, survivors: DataFrame) -> dict[int, int]:
        return {r["_problem"]: r["n"] for r in survivors.groupBy("_problem").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _screen_again(self, survivors: DataFrame, problems: list[Problem], n: int) -> DataFrame:
        """One more round: the last survivors of each problem join its pool and stay; the rest are tested."""
        by_number = {p.number: p for p in problems}
        cuts = self._edge_keys(survivors, "_problem", self.tail_rows, True, len(problems) == 1)
        named = survivors.withColumn("_g", F.col("_problem").cast("string"))
        cut = _per_group({str(number): key for number, key in cuts.items()})
        last = named.where(F.col("_key") >= cut).drop("_g").toArrow()
        frame = last.combine_chunks().to_batches()[0]
        numbers = frame.column(0).to_numpy(zero_copy_only=False)
        vecs = np.ascontiguousarray(frame.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.d))
        keys = frame.column(1).to_numpy(zero_copy_only=False)
        table: dict[str, list] = {}
        for number in np.unique(numbers):
            p, mine = by_number[int(number)], numbers == number
            pool = np.vstack([p.fixed, p.tail, vecs[mine]])
            n_pool = len(p.tail) + int(mine.sum())
            table[str(number)] = [(int(number), pool, n_pool, int(keys[mine].min()), np.inf)]
        shared = self.spark.sparkContext.broadcast(table)
        tests = {p.number: p.test for p in problems}
        named = named.select("_g", "_key", "_vec", "_spread")
        tested = (
            named.where(F.col("_key") < cut)
            .repartition(max(1, -(-n // 20_000)))
            .mapInArrow(_screen_task(shared, tests, self.d, 4 * self.d), VECTOR_ROW)
        )
        stays = named.where(F.col("_key") >= cut).select(F.col("_g").cast("int").alias("_problem"), "_key", "_vec", "_spread")
        return materialise(tested.unionByName(stays), "survivors")

    # -- half-spaces, all at once

    def _settle_half_spaces(self, problems: list[Problem], values: bool) -> DataFrame | None:
        """Decide what can be decided without an order; the rest before the tails is returned: (_problem, _key, _vec, _spread).

        A row that a later one repeats is redundant. Of the others, a row that all other rows together do not imply (but for earlier
        ones known to be redundant) is kept whatever they turn out to be; one that the later and the known kept ones imply is
        redundant, without another programme where the first one's active rows are among these. Each answer may settle more rows,
        so both are asked until fewer rows than a block are settled.
        """
        self._distinct = materialise(self.units.groupBy("_g", "_vec").agg(F.max("_key").alias("_key")), "distinct")
        self._distinct_sizes = {r["_g"]: r["count"] for r in self._distinct.groupBy("_g").count().collect()}
        names = self._names(problems)
        rows = self._distinct.join(F.broadcast(names), "_g")
        open_rows = rows.select("_problem", "_g", "_key", "_vec", F.lit(0.0).alias("_spread"))
        kept: list[DataFrame] = []
        n_open = open_rows.count()
        while n_open:
            implied = self._programmes(problems, open_rows, [open_rows, *kept] if kept else None, part=not values)
            certain = implied.where("not _redundant")
            kept.append(materialise(certain.select("_g", "_problem", "_key"), "kept"))
            rest = implied.where("_redundant")
            leaning = self._leaning(rest, kept)
            left = self._programmes(problems, rest.join(leaning, ["_problem", "_key"], "left_semi"), kept, part=True)
            self._solved += [certain, rest.join(leaning, ["_problem", "_key"], "left_anti")]
            open_rows = left.where("not _redundant").select("_problem", "_g", "_key", "_vec", "_spread")
            before, n_open = n_open, open_rows.count()
            if before - n_open < self.block_rows:
                break
        return self._take_over(problems, kept, open_rows, names)

    def _leaning(self, solved: DataFrame, kept: list[DataFrame]) -> DataFrame:
        """``_problem, _key`` of solved rows with an active earlier row that is none of the kept ones."""
        known = kept[0].select("_problem", F.col("_key").alias("_other"))
        for more in kept[1:]:
            known = known.unionByName(more.select("_problem", F.col("_key").alias("_other")))
        active = solved.select("_problem", "_key", F.explode("_active").alias("_other"))
        leaning = active.join(known, ["_problem", "_other"], "left_anti").select("_problem", "_key").distinct()
        return materialise(leaning, "leaning")

    def _take_over(self, problems: list[Problem], kept: list[DataFrame], open_rows: DataFrame, names: DataFrame) -> DataFrame | None:
        """Hand the kept rows and the few open ones to the search in order."""
        all_kept = kept[0]
        for more in kept[1:]:
            all_kept = all_kept.unionByName(more)
        self._kept_path = self._kept_path or scratch_path(self.spark, "kept")
        all_kept.select("_g", "_problem", "_key").write.mode("append").parquet(self._kept_path)
        self._kept_at_once.append(all_kept.join(F.broadcast(names), ["_g", "_problem"]))
        counts = self._survivor_counts(all_kept)
        first = {str(p.number): int(p.tail_keys[0]) if len(p.tail_keys) else HIGHEST_KEY for p in problems}
        in_tail = F.col("_key") >= _per_number(first)
        tails = {"kept": all_kept, "open": open_rows}
        # At most the tails, which the driver holds anyway.
        found = {name: {(r["_problem"], r["_key"]) for r in t.where(in_tail).select("_problem", "_key").collect()} for name, t in tails.items()}
        for p in problems:
            p.n_kept = counts.get(p.number, 0)
            p.kept_tail = {key for number, key in found["kept"] if number == p.number}
            p.open_tail = {key for number, key in found["open"] if number == p.number}
        survivors = open_rows.where(~in_tail).select("_problem", "_key", "_vec", "_spread")
        return None if survivors.isEmpty() else materialise(survivors, "survivors")

    def _names(self, problems: list[Problem]) -> DataFrame:
        """Group, number and spec of the problems."""
        named = [F.struct(F.lit(p.number).alias("_problem"), F.lit(p.group).alias("_g"), F.lit(p.index).alias("_s")) for p in problems]
        return self.spark.range(1).select(F.explode(F.array(*named)).alias("_n")).select("_n.*")

    def _programmes(self, problems: list[Problem], rows: DataFrame, earlier: list[DataFrame] | None, part: bool) -> DataFrame:
        """The half-space test of every row on all later distinct rows and those of ``earlier`` (None: all): ``SOLVED``, _redundant."""
        sizes = {p.group: self._distinct_sizes[p.group] for p in problems}
        table = self._distinct.where(F.col("_g").isin(list(sizes)))
        marked = None
        if earlier is not None:
            marked = earlier[0].select("_g", "_problem", "_key")
            for more in earlier[1:]:
                marked = marked.unionByName(more.select("_g", "_problem", "_key"))
            marked = marked.groupBy("_g", "_key").agg(F.collect_set("_problem").alias("_kept_by"))
            marked = table = materialise(table.join(marked, ["_g", "_key"], "left"), "marked")
        pieces = Pieces(self.spark.sparkContext, table, sizes, self.d, PROGRAMME_BYTES)
        found = materialise(solve_programmes(rows, pieces, self.d, part), "programmes")
        pieces.discard()
        discard(marked)
        redundant = ~F.isnan("_value") & (F.bround("_value", kernels.MIN_VALUE_DIGITS) >= -kernels.HALF_SPACE_SLACK)
        return found.withColumn("_redundant", redundant)

    def _half_space_values(self, problems: list[Problem]) -> DataFrame:
        """The minimum of every row on its final basis: all later rows and the kept earlier ones.

        That of its first programme, on more rows, where none of its active rows has become redundant.
        """
        names = self._names(problems)
        kept = self._kept_rows().select("_g", "_key", F.explode("_kept_by").alias("_problem"))
        solved = self._solved[0]
        for more in self._solved[1:]:
            solved = solved.unionByName(more)
        final = solved.join(self._leaning(solved, [kept]), ["_problem", "_key"], "left_anti").select("_problem", "_key", "_value")
        rows = self.units.join(F.broadcast(names), "_g").select("_problem", "_g", "_key", "_vec", "_spread")
        rest = materialise(rows.join(final, ["_problem", "_key"], "left_anti"), "rest")
        found = self._programmes(problems, rest, [kept], part=False)
        discard(rest)
        found = found.select("_problem", "_key", "_value").unionByName(final)
        return found.join(F.broadcast(names), "_problem").select("_g", "_s", "_key", "_value")

    # -- resolve

    def _resolve(self, problems: list[Problem], survivors: DataFrame) -> None:
        active = self._next_blocks(problems, survivors)
        while active:
            self._work_through(active)
            active = self._next_blocks(active, survivors)

    def _next_blocks(self, problems: list[Problem], survivors: DataFrame) -> list[Problem]:
        """Load the next survivors of each problem in key order; problems without any drop out."""
        cursors = {str(p.number): LOWEST_KEY if p.cursor is None else p.cursor for p in problems}
        after = survivors.withColumn("_g", F.col("_problem").cast("string")).where(
            F.col("_g").isin(list(cursors)) & (F.col("_key") > _per_group(cursors))
        )
        ends = self._edge_keys(after, "_problem", self.block_rows, False, len(problems) == 1)
        if not ends:
            return []
        within = F.col("_key") <= _per_group({str(number): key for number, key in ends.items()})
        rows = after.where(within).orderBy("_problem", "_key").collect()
        blocks: dict[int, list[Target]] = {}
        for r in rows:
            blocks.setdefault(r["_problem"], []).append(Target(r["_key"], np.array(r["_vec"]), r["_spread"]))
        found = []
        for p in problems:
            p.block = blocks.get(p.number, [])
            if p.block:
                p.cursor = p.block[-1].key
                found.append(p)
        return found

    def _work_through(self, problems: list[Problem], scanning: bool = True) -> None:
        """Decide every row of the loaded blocks, in rounds of one solving and, where rows are unknown, one scanning job."""
        if scanning:
            self._fill_counts([p for p in problems if p.spec.solve_by == "res"])
        by_number = {p.number: p for p in problems}
        while any(t.redundant is None for p in problems for t in p.block):
            asked, final = [], []
            for r in self._solve(problems, runs=not scanning):
                p = by_number[r["_problem"]]
                t = p.block[r["_position"]]
                if r["_redundant"]:
                    t.redundant = True
                    self._decide(p, t.key, True)
                    continue
                if scanning:
                    asked.append((p, r["_position"], t.key, np.array(r["_direction"]), r["_limit"]))
                if r["_final"]:
                    final.append((p.number, r["_position"]))
            changed = self.scan(asked) if asked else set()
            for number, position in final:
                if (number, position) not in changed:
                    p = by_number[number]
                    t = p.block[position]
                    t.redundant = False
                    self._decide(p, t.key, False)
                    self._fresh.append((p.group, p.number, t.key))
        for p in problems:
            for t in p.block:
                if not t.redundant:
                    p.keep(t.key, t.vec)
            p.block, p.hits, p.kept_hits = [], {}, set()

    def _solve(self, problems: list[Problem], runs: bool) -> list:
        """Judge every open target on the rows known so far; targets are spread over tasks.

        With ``runs`` the first few open ones of a problem go to one task, which decides them in order: every round
        decides at least that many.
        """
        targets, shared = [], {}
        for p in problems:
            open_targets = [(i, (t.key, t.vec, t.spread, t.later)) for i, t in enumerate(p.block) if t.redundant is None]
            if not open_targets:
                continue
            n_kept = p.n_kept + sum(t.redundant is False for t in p.block)
            shared[p.number] = (p.fixed, p.working_set(), n_kept)
            run = max(RUN_ROWS, RUN_WORK // max(1, len(shared[p.number][1][0]) * self.d))
            first = min(run, len(open_targets)) if runs else 0
            if first > 1:
                targets.append((p.number, [i for i, _ in open_targets[:first]], [t for _, t in open_targets[:first]]))
            targets += [(p.number, [i], [t]) for i, t in open_targets[first if first > 1 else 0 :]]
        table = self.spark.sparkContext.broadcast({"problems": shared, "targets": targets})
        tests = {p.number: p.test for p in problems}
        slices = min(len(targets), 2 * self.spark.sparkContext.defaultParallelism)
        found = (
            self.spark.range(0, len(targets), 1, slices)
            .mapInPandas(
                _solve_task(table, tests),
                "_problem int, _position int, _redundant boolean, _final boolean, _direction array<double>, _limit double",
            )
            .collect()
        )
        table.unpersist()
        return found

    def _fill_counts(self, problems: list[Problem]) -> None:
        if not problems:
            return
        keys: dict[str, set] = {}
        for p in problems:
            keys.setdefault(p.group, set()).update(t.key for t in p.block)
        counts = self._count_later({g: np.array(sorted(k), dtype=np.int64) for g, k in keys.items()})
        for p in problems:
            for t in p.block:
                t.later = counts[p.group].get(t.key, 0)

    def _kept_rows(self) -> DataFrame:
        """Kept rows as (_g, _key, _kept_by)."""
        if self._fresh:
            self._kept_path = self._kept_path or scratch_path(self.spark, "kept")
            frame = self.spark.createDataFrame(self._fresh, "_g string, _problem int, _key bigint")
            frame.coalesce(1).write.mode("append").parquet(self._kept_path)
            self._fresh = []
        return (
            self.spark.read.parquet(self._kept_path)
            .groupBy("_g", "_key")
            .agg(F.collect_set("_problem").alias("_kept_by"))
        )

    def scan(self, asked: list[tuple]) -> set[tuple[int, int]]:
        """One pass over all rows for rows that would change a solution; they become known to the problem.

        ``asked`` holds (problem, position, key, direction, limit). Returns the (problem, position) pairs for
        which there was a row the driver did not know.
        """
        by_number = {p.number: p for p, *_ in asked}
        table = {}
        for g in {p.group for p in by_number.values()}:
            mine = [(p.number, i, k, d, limit) for p, i, k, d, limit in asked if p.group == g]
            numbers, positions, keys, directions, limits = (list(column) for column in zip(*mine))
            table[g] = (
                np.array(numbers), np.array(positions), np.array(keys, dtype=np.int64), np.array(directions), np.array(limits)
            )
        source = self.units.where(F.col("_g").isin(list(table)))
        if any(p.overflow for p in by_number.values()):
            # Rows kept earlier count as well; the driver no longer holds them all.
            source = source.join(self._kept_rows(), ["_g", "_key"], "left")
        else:
            # Only later rows count, so rows up to the first target need not be read.
            source = source.where(F.col("_key") > min(int(keys.min()) for _, _, keys, _, _ in table.values()))
        shared = self.spark.sparkContext.broadcast(table)
        lanes = min(max(SCAN_HITS // len(asked), LANES[0]), LANES[1])
        shape = "_problem int, _position int, _lane int, _score double, _key bigint, _vec array<double>"
        best = (
            source.mapInArrow(_scan_task(shared, self.d, lanes, self.two_sided), shape)
            .groupBy("_problem", "_position", "_lane")
            .agg(F.max_by(F.struct("_key", "_vec"), "_score").alias("_row"))
            .collect()
        )
        # A row that was known is in the solution already; scoring above the limit is rounding.
        known = {n: p.known_keys() for n, p in by_number.items()}
        target = {(p.number, position): key for p, position, key, *_ in asked}
        changed = set()
        for r in best:
            key, number, position = r["_row"]["_key"], r["_problem"], r["_position"]
            p = by_number[number]
            kept = key < target[number, position]  # earlier rows are only looked at if they were kept
            if key not in known[number] or (kept and key in p.hits and key not in p.kept_hits):
                p.hits[key] = np.array(r["_row"]["_vec"])
                if kept:
                    p.kept_hits.add(key)
                changed.add((number, position))
        shared.unpersist()
        return changed

    # -- finish

    def _finish(self, problems: list[Problem]) -> None:
        """Decide the tails as one block per problem. Scans are only needed where kept rows exceed what the driver holds."""
        for p in problems:
            later = np.arange(len(p.tail_keys))[::-1] if p.later is None else p.later
            rows = zip(p.tail_keys, p.tail, p.tail_spread, later)
            rows = (r for r in rows if p.open_tail is None or int(r[0]) in p.open_tail)
            p.block = sorted((Target(int(k), v, float(s), int(n)) for k, v, s, n in rows), key=lambda t: t.key)
        for scanning in (False, True):
            chosen = [p for p in problems if p.block and p.overflow == scanning]
            if chosen:
                self._work_through(chosen, scanning)

    # -- fit values

    def _values(self, problems: list[Problem]) -> DataFrame:
        """The fit value of every fitted row on its final basis: all later rows and the kept earlier ones."""
        table: dict[str, list] = {}
        for p in problems:
            keys, rows, states = p.working_set()
            complete = p.spec.solver == "lstsq" or self.groups[p.group]["n_fit"] <= len(p.tail_keys)
            table.setdefault(p.group, []).append((p.number, p.fixed, keys, rows, states == KEPT, complete))
        shared = self.spark.sparkContext.broadcast(table)
        tests = {p.number: p.test for p in problems}
        source = self.units.where(F.col("_g").isin(list(table)))
        if sum(self.groups[g]["n_fit"] for g in table) <= SMALL_TABLE:
            source = source.repartition(self.spark.sparkContext.defaultParallelism)
        judged = source.mapInArrow(_value_task(shared, tests, self.d), VECTOR_ROW + ", _value double, _settled boolean")
        judged = materialise(judged, "values")
        names = [
            F.struct(F.lit(p.number).alias("_problem"), F.lit(p.group).alias("_g"), F.lit(p.index).alias("_s")) for p in problems
        ]
        names = self.spark.range(1).select(F.explode(F.array(*names)).alias("_n")).select("_n.*")
        columns = ["_problem", "_key", "_value"]
        found = judged.where("_settled").select(*columns)
        if not all(entry[-1] for entries in table.values() for entry in entries):
            found = found.unionByName(self._refined(problems, judged.where("not _settled"), shared).select(*columns))
        return found.join(F.broadcast(names), "_problem").select("_g", "_s", "_key", "_value")

    def _refined(self, problems: list[Problem], rows: DataFrame, shared) -> DataFrame:
        """Values of rows whose fits further rows may improve: column generation in the tables (``pricing``)."""
        groups = {p.number: p.group for p in problems}
        tests = {p.number: p.test for p in problems}

        def judge(number, key, vec, spread, extra):
            _, fixed, keys, pool, kept, _ = next(entry for entry in shared.value[groups[number]] if entry[0] == number)
            usable = (keys > key) | (kept & (keys < key))
            always = np.ones(len(fixed), dtype=bool), np.ones(len(extra), dtype=bool)
            v = tests[number].judge(vec, np.vstack([fixed, pool, extra]), spread, 0, np.concatenate([always[0], usable, always[1]]))
            return float(v.value), v.direction, float(v.limit)

        named = _per_group_of(groups)
        targets = rows.select(
            F.col("_problem").alias("_p"), named.alias("_g"), F.col("_key").alias("_id"), "_key", "_vec", "_spread"
        )
        units = self.units.select("_g", "_key", "_vec")
        if any(p.overflow for p in problems):
            units = units.join(self._kept_rows(), ["_g", "_key"], "left")
        else:
            units = units.withColumn("_kept_by", F.lit(None).cast("array<int>"))
        known = {p.number: p.working_set()[0] for p in problems}
        sizes = {g: facts["n_fit"] for g, facts in self.groups.items()}
        return pricing.improve(targets, units, sizes, judge, known, self.d, self.two_sided).withColumnRenamed("_p", "_problem")
